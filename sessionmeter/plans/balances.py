"""Worktree and automation reports: counts, failure rates and running balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_if, day_text, or_zero, ratio, ratio_or_null
from ..functions.text import any_matches
from ..operators.ordered import clamped_balance
from ..operators.pages import page
from ..ranges import DateRange, Page
from .compare import kpi_rows, with_delta

_WORKTREE = {"created": ["created"], "deleted": ["deleted", "archived"], "errors": ["error"]}
_AUTOMATION = {"queued": ["queued"], "completed": ["completed"], "failed": ["failed"]}


def _days(events: DataFrame, rng: DateRange, kinds: dict[str, list[str]], tz: str, both: bool) -> DataFrame:
    """Counts per period and day from one scan.

    A day before a period goes into that period's row with a null date, its starting point.
    """
    before = rng.previous() if both else None
    spans = {"current": rng} | ({"previous": before} if before else {})
    upto = DateRange(None, rng.end).filter(events)
    zone = F.lit("current")
    if rng.start is not None:
        zone = F.when(F.col("ts") >= rng.start, "current")
        if before:
            zone = zone.when(F.col("ts") >= before.start, "previous")
        zone = zone.otherwise("earlier")
    counts = upto.groupBy(zone.alias("zone"), day_text(F.col("ts"), tz).alias("date")).agg(
        *[count_if(F.col("action").isin(*values)).alias(name) for name, values in kinds.items()])
    place = lambda period, dated: F.struct(F.lit(period).alias("period"), (
        F.col("date") if dated else F.lit(None).cast("string")).alias("at"), *[F.col(k) for k in kinds])
    later = {"current": [place("current", True)], "previous": [place("previous", True), place("current", False)],
             "earlier": [place(p, False) for p in spans]}
    targets = F.array(place("current", True))
    for name, rows in later.items():
        targets = F.when(F.col("zone") == name, F.array(*rows)).otherwise(targets)
    return (counts.select(F.inline(targets)).groupBy("period", F.col("at").alias("date"))
            .agg(*[F.sum(k).alias(k) for k in kinds]))


def _series(days: DataFrame, up: str, down: str, out: str) -> DataFrame:
    return clamped_balance(days.withColumn("delta", F.col(up) - F.col(down)), ["period"], "date", "delta", out)


def _sum(name: str, period: str, inside: bool = True) -> Column:
    dated = F.col("date").isNotNull() if inside else F.lit(True)
    return or_zero(F.sum(F.when((F.col("period") == period) & dated, F.col(name))))


def _pairs(days: DataFrame, kinds) -> list[Column]:
    return [_sum(k, p).alias(f"{p}_{k}") for p in ("current", "previous") for k in kinds]


def worktree_kpis(worktree_event: DataFrame, rng: DateRange, inventory_count: int | None = None) -> DataFrame:
    """Created, deleted, errors, active at the end and failure rate, against the previous period.

    A known number of present worktrees replaces the derived current value.
    """
    days = _days(worktree_event, rng, _WORKTREE, "UTC", both=True)
    active = lambda p: F.greatest(F.lit(0), _sum("created", p, False) - _sum("deleted", p, False))
    totals = days.agg(*_pairs(days, _WORKTREE), active("current").alias("current_active"),
                      active("previous").alias("previous_active"))
    if inventory_count is not None:
        totals = totals.withColumn("current_active", F.lit(inventory_count))
    both = lambda name: (F.col("current_" + name), F.col("previous_" + name))
    metrics = {name: both(name) for name in ("created", "deleted", "errors", "active")}
    metrics["failure_rate"] = (ratio(F.col("current_errors"), F.col("current_created")),
                               ratio_or_null(F.col("previous_errors"), F.col("previous_created")))
    return with_delta(kpi_rows(totals, metrics, rng))


def worktree_daily(worktree_event: DataFrame, rng: DateRange, tz: str = "UTC", inventory_count: int | None = None,
                   today: str | None = None) -> DataFrame:
    """Counts per day and the number active, never below zero.

    A known inventory sets the point of ``today`` (a day of the zone; added if nothing happened
    then), unless the range has no moment of that day.
    """
    days = _series(_days(worktree_event, rng, _WORKTREE, tz, both=False), "created", "deleted", "active")
    rows = days.select("date", *_WORKTREE, F.col("active").cast("bigint"))
    if inventory_count is not None and today is not None and rng.overlaps(DateRange.of_day(today, tz)):
        point = rows.sparkSession.range(1).select(F.lit(today).alias("date"))
        rows = rows.join(point.withColumn("now", F.lit(inventory_count)), "date", "full").select(
            "date", *[or_zero(F.col(k)).alias(k) for k in _WORKTREE],
            F.coalesce("now", "active").cast("bigint").alias("active"))
    return rows.orderBy("date")


def worktree_list(worktree_event: DataFrame, rng: DateRange = DateRange(), search: str | None = None,
                  part: Page | None = None) -> DataFrame:
    rows = rng.filter(worktree_event).filter(
        any_matches(search, "worktree_path", "repo_root", "branch", "error", "action")).select(
        "id", "ts", "action", "worktree_path", "repo_root", "branch", "status", "error")
    return page(rows, [F.col("ts").desc(), F.col("id")], part)


def automation_kpis(automation_event: DataFrame, rng: DateRange, tz: str = "UTC") -> DataFrame:
    """Queued, completed, failed, backlog peak and failure rate, against the previous period.

    The peak is at least the backlog the period began with.
    """
    days = _days(automation_event, rng, _AUTOMATION, tz, both=True)
    start = lambda p: or_zero(F.sum(F.when((F.col("period") == p) & F.col("date").isNull(),
                                           F.col("queued") - F.col("completed"))))
    sums = days.agg(*_pairs(days, _AUTOMATION), start("current").alias("current_start"),
                    start("previous").alias("previous_start")).withColumn("k", F.lit(1))
    peaks = _series(days, "queued", "completed", "backlog").agg(*[
        F.max(F.when(F.col("period") == p, F.col("backlog"))).alias(p + "_top") for p in ("current", "previous")])
    totals = sums.join(peaks.withColumn("k", F.lit(1)), "k")
    both = lambda name: (F.col("current_" + name), F.col("previous_" + name))
    metrics = {name: both(name) for name in _AUTOMATION}
    metrics["backlog_peak"] = tuple(F.greatest(p + "_start", p + "_top") for p in ("current", "previous"))
    ended = lambda p: F.col(p + "_completed") + F.col(p + "_failed")
    metrics["failure_rate"] = (ratio(F.col("current_failed"), ended("current")),
                               ratio_or_null(F.col("previous_failed"), ended("previous")))
    return with_delta(kpi_rows(totals, metrics, rng))


def automation_daily(automation_event: DataFrame, rng: DateRange, tz: str = "UTC") -> DataFrame:
    """Counts per day and the backlog. A failed run stays in the backlog."""
    days = _series(_days(automation_event, rng, _AUTOMATION, tz, both=False), "queued", "completed", "backlog")
    return days.select("date", *_AUTOMATION, F.col("backlog").cast("bigint")).orderBy("date")


def automation_list(automation_event: DataFrame, rng: DateRange = DateRange(), search: str | None = None,
                    part: Page | None = None) -> DataFrame:
    rows = rng.filter(automation_event).filter(any_matches(search, "thread_id", "error", "action")).select(
        "id", "ts", "action", "thread_id", "status", "error")
    return page(rows, [F.col("ts").desc(), F.col("id")], part)
