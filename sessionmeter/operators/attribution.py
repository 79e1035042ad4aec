"""Tool calls which carry no session id, attributed to sessions by time.

A session claims every such call that starts in its activity window, and a call may belong
to many sessions. Listing the pairs would grow with sessions times calls, so the sums per
session come from totals over hours and powers of two of hours, looked up for each window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, HOUR_MS, call_ok
from ..ranges import DateRange
from ..runtime import checkpointed


def activity_windows(session: DataFrame, calls_by_session: DataFrame) -> DataFrame:
    """``session_id, window_start, window_end`` from the session time and its model calls.

    ``calls_by_session`` has ``session_id, first_ts, last_ts``. The window opens a day before
    the earliest and closes an hour after the latest; without calls it closes 25 hours after
    the session time.
    """
    joined = session.select(F.col("id").alias("session_id"), "ts").join(calls_by_session, "session_id", "left")
    end = F.when(F.col("last_ts").isNotNull(), F.greatest("ts", "last_ts")).otherwise(F.col("ts") + DAY_MS)
    return joined.select("session_id", (F.least("ts", "first_ts") - DAY_MS).alias("window_start"),
                         (end + HOUR_MS).alias("window_end"))


SUMS = ["n", "ok", "dur", "dur_n"]


def _node_totals() -> list:
    return [*[F.sum(c).alias(c) for c in SUMS], F.min("start").alias("start"), F.max("end").alias("end")]


def _covering(levels: int) -> Column:
    """The dyadic nodes (level, node) that together are the hours from ``lo`` to ``hi``: two a level at most."""
    def pair(k):
        left = F.shiftright(F.col("lo") + F.shiftleft(F.lit(1).cast("long"), k) - 1, k)
        right = F.shiftright(F.col("hi") + 1, k)
        node = lambda used, at: F.when((left < right) & (used % 2 != 0), F.struct(F.lit(k).alias("level"), at.alias("node")))
        return [node(left, left), node(right, right - 1)]

    return F.filter(F.array(*[n for k in range(levels) for n in pair(k)]), lambda x: x.isNotNull())


def window_totals(windows: DataFrame, calls: DataFrame) -> DataFrame:
    """Per window: count, ok count, duration sum and count, first start and last end.

    Windows are at least two hours long, so both ends fall into different hours. Calls are
    summed per millisecond first; an hour then has a bounded number of rows. What lies between the
    hours of both ends comes from totals of 1, 2, 4 … hours, kept only where there are calls: a window of h
    hours needs two for each power of two up to h. So a time far off adds rows for itself and no more.
    """
    # Each of these is looked up several times; recomputing would scan the calls again each time.
    windows = checkpointed(windows)
    span = F.coalesce(F.col("duration_ms"), F.col("end_ts") - F.col("start_ts"))
    at_ms = calls.groupBy(F.col("start_ts").alias("at")).agg(
        F.count("*").alias("n"), F.sum(F.when(call_ok(), 1).otherwise(0)).alias("ok"),
        F.sum(span).alias("dur"), F.count(span).alias("dur_n"),
        F.max(F.coalesce("end_ts", "start_ts")).alias("end"))
    marks = (windows.select(F.explode(F.array("window_start", "window_end")).alias("at")).distinct()
             .withColumn("mark", F.lit(True)))
    hour = lambda c: F.floor(F.col(c) / F.lit(HOUR_MS))
    points = checkpointed(at_ms.join(marks, "at", "full").withColumn("hour", hour("at")).withColumn(
        "start", F.when(F.col("n").isNotNull(), F.col("at"))))

    # Inside the hours of both ends: from the window's start onward, up to its end.
    parts = []
    for name, order in (("onward", F.col("at").desc()), ("upto", F.col("at"))):
        frame = Window.partitionBy("hour").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        parts += [F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(f"{c}_{name}") for c in SUMS]
        parts += [F.min("start").over(frame).alias(f"start_{name}"), F.max("end").over(frame).alias(f"end_{name}")]
    edges = points.select("at", "mark", *parts).filter("mark")
    side = lambda name, key: edges.select(F.col("at").alias(key), *[F.col(f"{c}_{name}") for c in (*SUMS, "start", "end")])

    # Between them: totals of dyadic runs of hours.
    inner = windows.select("window_start", "window_end", (hour("window_start") + 1).alias("lo"), (hour("window_end") - 1).alias("hi"))
    longest = inner.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0] or 1
    levels = int(longest).bit_length()
    held = points.filter("n is not null").groupBy("hour").agg(*_node_totals())
    nodes = held.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn(
        "node", F.expr("shiftright(hour, level)")).groupBy("level", "node").agg(*_node_totals())
    spans = inner.select("lo", "hi").distinct()
    between = spans.select("lo", "hi", F.inline(_covering(levels))).join(nodes, ["level", "node"]).groupBy("lo", "hi").agg(*_node_totals())

    joined = (inner.select("window_start", "window_end", "lo", "hi").distinct().join(between, ["lo", "hi"], "left")
              .join(side("onward", "window_start"), "window_start").join(side("upto", "window_end"), "window_end"))
    total = lambda c: (F.col(f"{c}_onward") + F.col(f"{c}_upto") + F.coalesce(F.col(c), F.lit(0))).alias(c)
    totals = joined.select("window_start", "window_end", *[total(c) for c in SUMS],
                           F.least("start_onward", "start", "start_upto").alias("first_ts"),
                           F.greatest("end_onward", "end", "end_upto").alias("last_ts"))
    return windows.join(totals, ["window_start", "window_end"]).select("session_id", *SUMS, "first_ts", "last_ts")


def calls_of_session(windows: DataFrame, calls: DataFrame, session_id: str) -> DataFrame:
    """Calls of one session: its own, and those without a session inside its window.

    The window is one row, read first, so its bounds reach the scan of the calls (and choose its days).
    """
    one = windows.filter(F.col("session_id") == session_id).agg(
        F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end")).first()
    own = calls.filter(F.col("session_id") == session_id)
    if one["window_start"] is None:
        return own
    return own.unionByName(DateRange(*one).filter(calls.filter(F.col("session_id").isNull()), "start_ts"))
