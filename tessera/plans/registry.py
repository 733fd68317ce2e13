"""All queries of the core with their SQL."""

from __future__ import annotations

from tessera.plans import evaluation, expressions, pipelines, quality, records, verdicts

MODULES = [quality, expressions, evaluation, pipelines, records, verdicts]
FLAGSHIP = "eval_bundle"


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
