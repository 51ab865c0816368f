"""Operators for training-data pipelines (documents, pages, benchmark tables).

Nothing outside this folder imports it. Every operator is a plain function over
DataFrames; the ``opN_*`` queries in :mod:`boxweave.llm.queries` are thin
wrappers which derive the contract's columns from the operators' own results.
"""
