"""Streaming of the selection engine."""
