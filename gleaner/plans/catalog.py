"""All registered queries."""

from __future__ import annotations

from gleaner.plans import (  # noqa: F401
    dedupe_queries,
    feed_queries,
    gate_queries,
    ingest_queries,
    link_queries,
    report_queries,
    source_queries,
)
from gleaner.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
