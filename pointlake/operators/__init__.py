"""Operators from DataFrame to DataFrame: search, lexical retrieval, approximate search."""
