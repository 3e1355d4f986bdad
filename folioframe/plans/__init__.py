"""Compositions of operators, and the queries that run them over the given tables."""
