"""Registered queries of the map library, each beside its SQL."""

from __future__ import annotations

from . import edit_queries, feature_queries, file_queries, path_queries, point_queries, raster_queries, scalar_queries, stream_queries  # noqa: F401
from .fixtures import QUERIES, SQL

FLAGSHIP = "cost_grid"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
