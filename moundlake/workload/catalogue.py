"""All registered queries."""

from __future__ import annotations

from moundlake.workload import raster_queries, record_queries, vector_queries  # noqa: F401
from moundlake.workload.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
