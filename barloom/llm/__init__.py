"""Operators for building training corpora; their queries are in ``barloom.llm.queries``."""
