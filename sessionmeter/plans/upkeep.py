"""Reports about the tables themselves: ingest state, data quality, daily rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, count_if, day_text
from ..functions.text import any_matches
from ..operators.ordered import clamped_balance
from ..operators.pages import page
from ..ranges import DateRange, Page
from ..sources.tables import Tables
from .activity import activity_daily
from .balances import automation_daily, worktree_daily

# Column holding the time of each fact table, and the first plausible millisecond value.
TIMES = {"session": "ts", "model_call": "ts", "tool_call": "start_ts", "message": "ts"}
EARLIEST_MS = 1_000_000_000_000
# Tables a store must have.
REQUIRED = (*TIMES, "daily_activity")


def ingest_files(ledger: DataFrame, search: str | None = None, part: Page | None = None) -> DataFrame:
    """Known files, last updated first."""
    rows = ledger.filter(any_matches(search, "path")).select("path", "byte_offset", "mtime_ms", "updated_at")
    return page(rows, [F.col("updated_at").desc(), F.col("path")], part)


def ingest_summary(ledger: DataFrame, search: str | None = None) -> DataFrame:
    return ledger.filter(any_matches(search, "path")).agg(
        F.count("*").alias("total_files"), F.max("updated_at").alias("last_updated_at"))


def last_sync(ledger: DataFrame) -> DataFrame:
    """Time of the last ingest, null if there was none."""
    return ledger.agg(F.max("updated_at").alias("last_updated_at"))


def log_status(desktop_log_event: DataFrame) -> DataFrame:
    """Whether any desktop log record with a message is stored, and how many."""
    return desktop_log_event.agg(count_if(F.col("message") != "").alias("total")).select(
        (F.col("total") > 0).alias("has_logs"), "total")


def ingest_report(ledger: DataFrame, lines: DataFrame, rejects: DataFrame, duration_ms: int | None = None) -> DataFrame:
    """One row: files in the run, lines taken, lines rejected, and how long it took if that is known."""
    tag = lambda df: df.withColumn("k", F.lit(1))
    report = (tag(ledger.agg(F.count("*").alias("files_processed")))
              .join(tag(lines.agg(F.count("*").alias("lines_ingested"))), "k")
              .join(tag(rejects.agg(F.count("*").alias("errors"))), "k").drop("k"))
    return report if duration_ms is None else report.withColumn("duration_ms", F.lit(duration_ms).cast("bigint"))


def data_checks(tables: dict[str, DataFrame | None], now_ms: int, required: tuple[str, ...] = ()) -> DataFrame:
    """A row per table: size, time range, zero, implausible and future times, verdict.

    A table that is None, or ``required`` and not given, has a row without figures and the verdict ``missing``.
    Tables without a time of their own are only counted.
    """
    names = [*dict.fromkeys([*(n for n in TIMES if n in tables or n in required), *required])]
    if not names:
        raise ValueError("no table to check")
    rows, spark = [], SparkSession.active()
    for name in names:
        df, ts = tables.get(name), TIMES.get(name)
        nothing = {"min_ts": "bigint", "max_ts": "bigint", "zero_ts": "bigint", "early_ts": "bigint", "future_ts": "bigint"}
        blank = [F.lit(None).cast(kind).alias(column) for column, kind in nothing.items()]
        if df is None:
            rows.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit(None).cast("bigint").alias("row_count"), *blank))
            continue
        if ts is None:
            rows.append(df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", *blank))
            continue
        rows.append(df.agg(
            F.lit(name).alias("table_name"), F.count("*").alias("row_count"), F.min(ts).alias("min_ts"),
            F.max(ts).alias("max_ts"), count_if(F.col(ts) == 0).alias("zero_ts"),
            count_if(F.col(ts) < EARLIEST_MS).alias("early_ts"),
            count_if(F.col(ts) > now_ms + DAY_MS).alias("future_ts")))
    checks = reduce(DataFrame.unionByName, rows)
    bad = (F.col("early_ts") > 0) | (F.col("future_ts") > 0)
    return checks.withColumn("verdict", F.when(F.col("row_count").isNull(), "missing").when(F.col("row_count") == 0, "empty")
                             .when(bad, "suspicious").otherwise("ok"))


def stored_checks(tables: Tables, now_ms: int) -> DataFrame:
    """``data_checks`` of a table store: every required table has a row, whether it was ever written or not."""
    return data_checks({n: tables.read(n) if tables.exists(n) else None for n in REQUIRED}, now_ms, REQUIRED)


def daily_activity_rollup(message: DataFrame, model_call: DataFrame, rng: DateRange = DateRange(),
                          tz: str = "UTC") -> DataFrame:
    """Rows of the daily activity table."""
    return activity_daily(message, model_call, rng, tz)


def worktree_rollup(worktree_event: DataFrame, rng: DateRange = DateRange(), tz: str = "UTC") -> DataFrame:
    return worktree_daily(worktree_event, rng, tz).select(
        "date", F.col("created").alias("created_count"), F.col("deleted").alias("deleted_count"),
        F.col("errors").alias("error_count"), F.col("active").alias("active_count"))


def automation_rollup(automation_event: DataFrame, rng: DateRange = DateRange(), tz: str = "UTC") -> DataFrame:
    """Rows of the daily automation table; a day's peak is its backlog at the end of day."""
    return automation_daily(automation_event, rng, tz).select(
        "date", F.col("queued").alias("runs_queued"), F.col("completed").alias("runs_completed"),
        F.col("failed").alias("runs_failed"), F.col("backlog").alias("backlog_peak"))


def balances_since(events: DataFrame, kinds: dict[str, list[str]], seed: int, balance: str) -> DataFrame:
    """Counts per UTC day and the running balance (first count less second, never below zero), going on from ``seed``.

    ``events`` are those of whole days from some day on, ``seed`` the balance at the end of the day before.
    """
    days = events.groupBy(day_text(F.col("ts")).alias("date")).agg(
        *[count_if(F.col("action").isin(*actions)).alias(name) for name, actions in kinds.items()])
    up, down = list(kinds)[:2]
    zero = [F.lit(0).cast("bigint").alias(n) for n in kinds]
    given = days.sparkSession.range(1).select(F.lit(None).cast("string").alias("date"), *zero, F.lit(seed).cast("bigint").alias("delta"))
    return clamped_balance(days.withColumn("delta", F.col(up) - F.col(down)).unionByName(given).withColumn("_all", F.lit(1)),
                           ["_all"], "date", "delta", balance).select("date", *kinds, F.col(balance).cast("bigint").alias(balance))


def refresh_days(rollup: DataFrame, fresh: DataFrame, dirty: DataFrame) -> DataFrame:
    """Replace the days listed in ``dirty`` by freshly computed ones."""
    days = dirty.select("date").distinct()
    return rollup.join(days, "date", "left_anti").unionByName(fresh.join(days, "date", "left_semi"))
