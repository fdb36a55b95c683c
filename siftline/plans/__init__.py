"""Registered queries over the given tables, grouped as in the coverage list."""

from siftline.plans import checks, curation, joins, rules, similar, streams, structures, summaries, texts, windows  # noqa: F401
from siftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
