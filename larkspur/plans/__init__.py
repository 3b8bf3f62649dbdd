"""Queries bound to the given tables, and their SQL."""
