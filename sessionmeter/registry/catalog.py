"""All registered queries."""

from __future__ import annotations

from . import ingest  # noqa: F401  registers its queries
from . import reports


def queries() -> dict:
    return dict(reports.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(reports.SQL)
