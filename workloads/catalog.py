"""All registered queries by name, with the SQL that checks them."""

from __future__ import annotations

from workloads import manufacturing, matching, partner, quality

_MODULES = (manufacturing, partner, matching, quality)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
