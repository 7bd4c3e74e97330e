"""Registered queries: each operator on the given tables, with the SQL that checks it."""

from __future__ import annotations

from rackpulse.catalog import experiments, features, fleet, inventory, models, series, storage, streams, text

MODULES = (fleet, text, series, features, inventory, models, experiments, storage, streams)


def queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        name: sql.strip() for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql is not None
    }
