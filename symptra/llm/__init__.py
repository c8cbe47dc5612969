"""Operators for preparing training text: one module per operator, their
queries and SQL in :mod:`symptra.llm.queries`. Nothing outside this subpackage
imports it."""
