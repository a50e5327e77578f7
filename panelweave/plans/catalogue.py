"""Every registered query and its SQL."""

from __future__ import annotations

from . import q_correspondence, q_detections, q_extras, q_geometry, q_panel, q_rates, q_scan, q_trend, q_values  # noqa: F401
from .registry import QUERIES, SQL

FLAGSHIP = "q_monthly_metrics"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
