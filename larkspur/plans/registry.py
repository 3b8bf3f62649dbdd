"""Queries and their SQL, by name."""

from __future__ import annotations

from larkspur.plans import directory, evidence, forms, grammar, nested, notices, records, release, terms, text

QUERIES = text.QUERIES | directory.QUERIES | evidence.QUERIES | records.QUERIES | grammar.QUERIES | notices.QUERIES | nested.QUERIES | forms.QUERIES | terms.QUERIES | release.QUERIES
ORACLES = text.ORACLES | directory.ORACLES | evidence.ORACLES | records.ORACLES | grammar.ORACLES | notices.ORACLES | nested.ORACLES | forms.ORACLES | terms.ORACLES | release.ORACLES
