"""Relational building blocks: skew-aware joins, exact-N sampling, set operations, counts."""
