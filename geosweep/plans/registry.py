"""Every registered query of the engine, with the SQL it must agree with."""

from __future__ import annotations

from geosweep.plans import analytics, estimates, graphs, kernels, records, tables

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (tables, analytics, graphs, kernels, records, estimates):
    for _name, (_query, _sql) in _part.PLANS.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLES[_name] = _sql
