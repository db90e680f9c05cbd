"""Training-data operators: deduplication, scoring, counting, mixing, sharding, search and formatting.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
