"""Operators that prepare text and vectors for training.

Nothing outside this package imports it.  Each module holds one operator; the
thin registered queries and their SQL are in :mod:`larkspur.llm.queries`.
"""
