"""Activity per day, its summary and the calendar heat map."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce
from operator import or_
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_if, day_text, or_zero
from ..ranges import DateRange


#: Stretches of missing days up to which each is a condition of its own.
FEW = 20
COUNTS = ("message_count", "call_count", "token_total")


def activity_daily(message: DataFrame, model_call: DataFrame, rng: DateRange, tz: str = "UTC",
                   rollup: DataFrame | None = None) -> DataFrame:
    """Messages, calls and tokens per day. With a rollup table, messages and calls are read only for the days it lacks."""
    if rollup is not None:
        return _with_rollup(message, model_call, rng, tz, rollup)
    said = rng.filter(message).groupBy(day_text(F.col("ts"), tz).alias("date")).agg(
        F.count("*").alias("message_count"))
    called = rng.filter(model_call).groupBy(day_text(F.col("ts"), tz).alias("date")).agg(
        F.count("*").alias("call_count"), or_zero(F.sum("total_tokens")).alias("token_total"))
    return said.join(called, "date", "full").select("date", *[or_zero(F.col(c)).alias(c) for c in COUNTS])


def _with_rollup(message: DataFrame, model_call: DataFrame, rng: DateRange, tz: str, rollup: DataFrame) -> DataFrame:
    """Stored days and, from the facts, the stretches of days between them.

    The dates stored are a calendar's worth at most and come to the driver, where they bound the scans: no day of the
    range left, no scan; otherwise one range of times per stretch (of many stretches, their hull and the dates), which
    reaches the Parquet scan.
    """
    stored = rollup.select("date", *COUNTS)
    if rng.start is not None:
        stored = stored.filter(F.col("date") >= day_text(F.lit(rng.start), tz))
    if rng.end is not None:
        stored = stored.filter(F.col("date") <= day_text(F.lit(rng.end), tz))
    held = {r.date for r in stored.select("date").distinct().collect()}
    gaps = _gaps(rng, sorted(held), tz)
    if not gaps:
        return stored
    hull = DateRange(gaps[0].start, gaps[-1].end)
    missing = reduce(or_, [g.contains(F.col("ts")) for g in gaps]) if len(gaps) <= FEW else ~day_text(F.col("ts"), tz).isin(held)
    pruned = lambda df: hull.filter(df).filter(missing)
    return stored.unionByName(activity_daily(pruned(message), pruned(model_call), DateRange(), tz))


def _gaps(rng: DateRange, held: list[str], tz: str) -> list[DateRange]:
    """Ranges of time in ``rng`` outside the dates held, in order."""
    zone = ZoneInfo(tz)
    begins = lambda day: int(datetime.combine(day, datetime.min.time(), zone).timestamp()) * 1000
    out, start = [], rng.start
    for day in map(date.fromisoformat, held):
        before = begins(day) - 1
        if start is None or start <= before:
            out.append(DateRange(start, before))
        start = begins(day + timedelta(days=1))
    if rng.end is None or start is None or start <= rng.end:
        out.append(DateRange(start, rng.end))
    return out


def activity_summary(daily: DataFrame, session: DataFrame, rng: DateRange,
                     previous_daily: DataFrame | None = None, previous_rng: DateRange | None = None) -> DataFrame:
    """Rows ``metric, value, previous``. The caller gives the days of a year earlier, if wanted."""

    def totals(days, span, tag):
        active = (F.col("message_count") > 0) | (F.col("call_count") > 0) | (F.col("token_total") > 0)
        sums = days.agg(or_zero(F.sum("message_count")).alias("messages"), or_zero(F.sum("call_count")).alias("calls"),
                        or_zero(F.sum("token_total")).alias("tokens"), count_if(active).alias("active_days"))
        rows = sums.select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("n"))
            for m in ("messages", "calls", "tokens", "active_days")])))
        held = span.filter(session).agg(F.count("*").cast("bigint").alias("n")).select(F.lit("sessions").alias("metric"), "n")
        return rows.unionByName(held).withColumn("side", F.lit(tag))

    rows = totals(daily, rng, "value")
    if previous_daily is not None:
        rows = rows.unionByName(totals(previous_daily, previous_rng or DateRange(), "previous"))
    return rows.groupBy("metric").agg(*[F.max(F.when(F.col("side") == s, F.col("n"))).alias(s)
                                        for s in ("value", "previous")])


def activity_heatmap(daily: DataFrame, year: int) -> DataFrame:
    """Every day of the year, padded to the Sunday before, with a level from 0 to 4."""
    first = date(year, 1, 1)
    first -= timedelta(days=(first.weekday() + 1) % 7)
    spine = daily.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(first.isoformat()).cast("date"), F.lit(f"{year}-12-31").cast("date"))).alias("day")).select(F.col("day").cast("string").alias("date"))
    cells = spine.withColumn("on_grid", F.lit(True)).join(daily.select("date", "token_total"), "date", "full")
    value = or_zero(F.col("token_total"))
    top = F.max(value).over(Window.partitionBy(F.lit(1)))
    level = F.when((value > 0) & (F.col("top") > 0),
                   F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(value / F.col("top") * 4)))).otherwise(F.lit(0))
    return (cells.withColumn("top", top).filter("on_grid")
            .select("date", value.cast("bigint").alias("value"), level.cast("int").alias("level"),
                    (F.substring("date", 1, 4) == str(year)).alias("in_year")).orderBy("date"))
