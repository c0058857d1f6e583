"""Registered queries: operators applied to whole tables, with the same result in SQL."""

from __future__ import annotations

from .registry import ORACLE_SQL, QUERIES  # noqa: F401
from . import panels, portfolio, reports, series, statistics, zoo  # noqa: E402,F401
