"""Operators: text statistics, search, star-schema queries, graphs, sparse classification."""
