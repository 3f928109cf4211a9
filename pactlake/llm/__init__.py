"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it; ``llm.queries`` lists the queries that the
repository's entry module registers.
"""
