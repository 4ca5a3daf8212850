"""Training-data operators: extraction, filtering, deduplication, tokenisation.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
