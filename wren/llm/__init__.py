"""Training-data operators: decontamination, extraction, deduplication,
tokenization, sharding, quality, personal data and URL rules.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; the named
queries are in ``queries.py``.
"""
