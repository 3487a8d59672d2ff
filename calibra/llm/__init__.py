"""Operators of a training-data pipeline, one module each.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.  The
modules hold the operators with their own general interface;
``calibra.llm.queries`` holds the thin registered queries.
"""
