"""Operators for large-scale training data: filtering, deduplication, packing, formatting.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
