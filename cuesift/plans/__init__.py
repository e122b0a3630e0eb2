"""Logic trees, their parsing and their compilation to DataFrame plans."""
