"""Relational operators over evidence-bearing records."""
