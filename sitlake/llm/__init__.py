"""Training-data operators: one module each, plus the queries that apply them.

Nothing outside this folder (but the guarded block in ``__spark_entry__.py``
and ``corpus_pipeline.py``) imports it.
"""
