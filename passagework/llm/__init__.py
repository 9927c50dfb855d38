"""Operators for preparing training data: deduplication, filtering, encoding.

Nothing outside this folder, ``corpus_pipeline.py`` and their tests imports it.
"""
