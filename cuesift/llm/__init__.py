"""Corpus operators for training-data pipelines.

Nothing else in ``cuesift`` imports this subpackage; it can be deleted whole.
"""
