"""Functions of the selection engine."""
