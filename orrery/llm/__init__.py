"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``embeddings``.

Nothing outside this subpackage imports it. Every operator takes DataFrames and column names and returns a DataFrame; the
queries of the entry module are thin wrappers in :mod:`orrery.llm.queries`.
"""
