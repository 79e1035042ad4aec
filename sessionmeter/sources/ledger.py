"""The ledger of ingested files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import first_per_key


def latest_ledger(updates: DataFrame) -> DataFrame:
    """Current state per path: its newest update; of equal times the one that read furthest."""
    return first_per_key(updates, ["path"], [F.col("updated_at").desc(), F.col("byte_offset").desc()])


def next_ledger(files: DataFrame, now_ms: int) -> DataFrame:
    """Ledger rows for files just read: ``path, byte_offset, line_count, mtime_ms``, and ``begun_at, seen_size`` if known."""
    known = [(F.col(c) if c in files.columns else F.lit(None).cast("bigint")).alias(c) for c in ("begun_at", "seen_size")]
    return files.select("path", "byte_offset", "line_count", "mtime_ms", F.lit(now_ms).cast("bigint").alias("updated_at"),
                        *known)


def without_path(ledger: DataFrame, paths: list[str]) -> DataFrame:
    """Forget files, so that the next run reads them from the start."""
    return ledger.filter(~F.col("path").isin(*paths)) if paths else ledger
