"""All registered queries. Importing a module registers what it defines."""

from __future__ import annotations

from scholarium.plans import aggregates, functions, relational, stores, streams, vectors  # noqa: F401
from scholarium.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
