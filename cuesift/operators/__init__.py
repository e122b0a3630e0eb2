"""Operators of the selection engine."""
