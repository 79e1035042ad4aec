"""Order-dependent derivations which survive a hot key.

A window over a key alone puts all rows of that key into one task. Here the key is cut
into position buckets first; what crosses a bucket edge is computed on one row per
bucket and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import HOUR_MS
from ..runtime import checkpointed

CHUNK = 65_536
#: Rows of a key above which it is handled in buckets, and rows up to which a counted frame may be broadcast.
HOT, FEW = 1_000_000, 100_000


def carry_forward(df: DataFrame, keys: list[str], position: str, value: str, out: str,
                  include_current: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Last non-null ``value`` at an earlier position of the same key.

    Positions are unique within a key. Rows with a null key get null.
    """
    bucketed = df.withColumn("_chunk", F.floor(F.col(position) / F.lit(chunk)))
    on = [*keys, "_chunk"]
    seen = bucketed.groupBy(*on).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias("_edge"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (seen.withColumn("_carried", F.last("_edge", ignorenulls=True).over(before))
               .filter(F.col("_carried").isNotNull()).select(*on, "_carried"))
    inside = (Window.partitionBy(*on).orderBy(position)
              .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1))
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return (bucketed.join(carried, on, "left")
            .withColumn(out, F.when(known, F.coalesce(F.last(value, ignorenulls=True).over(inside),
                                                      F.col("_carried"))))
            .drop("_chunk", "_carried"))


def with_next(df: DataFrame, keys: list[str], position: str, tie: str, out: str,
              width: int = HOUR_MS, hot: int = HOT) -> DataFrame:
    """Position of the following row of the same key, ordered by position, then ``tie``.

    Keys with more than ``hot`` rows are found first, from the key columns alone; there are few of them,
    whatever the size of the table. Their rows are cut into buckets of ``width``, and what follows a bucket comes
    from a table with one row per bucket of a hot key. All other rows are shuffled once, by key, and meet no join.
    """
    heavy = checkpointed(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot")))
    amount = heavy.count()
    if amount == 0:
        return df.withColumn(out, F.lead(position).over(Window.partitionBy(*keys).orderBy(position, tie)))

    def met(left: DataFrame, right: DataFrame, names: list[str], small: bool) -> DataFrame:
        same = F.lit(True)
        for name in names:
            same = same & left[name].eqNullSafe(right[f"_hot_{name}"])
        return left.join(F.broadcast(right) if small else right, same, "left").drop(*[f"_hot_{n}" for n in names])

    bucketed = met(df, heavy, keys, amount <= FEW).withColumn(
        "_bucket", F.when(F.col("_hot"), F.floor(F.col(position) / F.lit(width))).otherwise(F.lit(0)))
    on = [*keys, "_bucket"]
    firsts = bucketed.filter("_hot").groupBy(*on).agg(F.min(position).alias("_first"))
    after = checkpointed(firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bucket"))).select(
        *[F.col(c).alias(f"_hot_{c}") for c in on], "_after"))
    inside = F.lead(position).over(Window.partitionBy(*on).orderBy(position, tie))
    return met(bucketed.withColumn("_next", inside), after, on, after.count() <= FEW).withColumn(
        out, F.coalesce("_next", "_after")).drop("_bucket", "_hot", "_next", "_after")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    Spark limits each map task to its own first row per key before the shuffle, so
    copies of one key do not travel.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Newest row per key; equal times are settled by the smallest ``tie``."""
    return first_per_key(df, keys, [F.col(ts).desc(), F.col(tie)])


def clamped_balance(days: DataFrame, keys: list[str], day: str, delta: str, out: str) -> DataFrame:
    """Running balance per day which never falls below zero.

    ``days`` holds one row per key and day. A row with a null day carries what happened
    before the range: it moves the starting point, which may be negative, and is dropped
    from the result. With S the plain running sum, the balance is S - min(0, least S so far).
    """
    order = Window.partitionBy(*keys).orderBy(F.col(day).asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0)
    summed = days.withColumn("_sum", F.sum(delta).over(order))
    floor = F.min(F.when(F.col(day).isNotNull(), F.col("_sum"))).over(order)
    return (summed.withColumn(out, F.col("_sum") - F.least(F.lit(0), floor))
            .filter(F.col(day).isNotNull()).drop("_sum"))
