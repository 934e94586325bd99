"""All queries of the plans and their SQL, by name."""

from __future__ import annotations

from . import batches, configs, extras, flows, groupwise, hooks, media, reports, sampling, scoring

MODULES = [scoring, groupwise, sampling, batches, reports, flows, extras, media, hooks, configs]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
