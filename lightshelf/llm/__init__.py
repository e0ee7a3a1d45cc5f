"""Operators for preparing text, vectors, pages and media as training data.

Nothing outside this subpackage imports it; the queries that apply the
operators to the test tables are in :mod:`lightshelf.llm.queries`.
"""
