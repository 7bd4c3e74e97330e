"""The registered queries of this folder: one for each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from rackpulse.llm import (
    chat, classifier, filter_audit, fingerprint, jaccard, line_dedup, mixing, packing, quality, resampling, secret_scan, shortest_pack, slack,
)

MODULES = (
    chat, line_dedup, secret_scan, quality, mixing, packing, fingerprint, jaccard, slack, classifier, filter_audit, shortest_pack, resampling,
)


def queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql is not None}
