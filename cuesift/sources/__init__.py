"""Sources of the selection engine."""
