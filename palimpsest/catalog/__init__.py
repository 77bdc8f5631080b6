"""Registered queries: one per operator, run over the given tables, with an oracle where SQL can state it."""

from palimpsest.catalog.registry import MODULES, ORACLES, QUERIES  # noqa: F401
