"""Operators for training data; nothing outside this package imports it."""

from graphlake.llm import contamination, neighbors, packing, sources, spam, splitting, syntax

_MODULES = (sources, splitting, neighbors, syntax, packing, contamination, spam)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
