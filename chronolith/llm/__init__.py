"""Operators of a training-data pipeline over large text collections.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
