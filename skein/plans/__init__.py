"""Queries over the parquet carriers: importing this registers them all."""

from skein.plans import budget, catalog, coordination, render, rules, sinks, sources, text, transcript  # noqa: F401
from skein.plans.registry import QUERIES, SQL  # noqa: F401
