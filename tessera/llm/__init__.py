"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it.  ``tessera.llm.catalog`` lists the registered queries and
their SQL; each ``opNN`` module holds one operator with a general interface, and the thin query that
derives the digest columns from it.
"""
