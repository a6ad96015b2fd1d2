"""Training-data operators: ten document operators and the queries that apply them.

Nothing outside this folder (and ``corpus_pipeline.py``, which belongs to it)
imports it.  Every operator takes a ``documents`` DataFrame with at least
``doc_id`` and ``text``, reads only the columns it names (extra columns, also
ones named like its results, are ignored), treats a null text as empty and
accepts an empty table.  Rows that repeat a ``doc_id`` are defined per operator.
"""
