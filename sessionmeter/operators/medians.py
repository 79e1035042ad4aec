"""Exact medians per group without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed
from .ordered import FEW

# Bins are even parts of the binary logarithm, 0.07 % wide at every size of number, costs of a
# fraction of a cent included; zero has its own.
_BINS = 1000
_ZERO = 1_100_000  # more than any double's logarithm below one takes
#: Parts a range is cut into, and distinct values of a range that one task puts in order, at most.
PARTS, RANKED = 1024, 10_000


def _holding(parts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Of every key's parts (with ``begin``, the count before the first, and a ``rank``) the one that holds the rank."""
    upto = Window.partitionBy(*keys, "rank").orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("begin") + F.sum("n").over(upto)
    return (parts.withColumn("end", end).withColumn("begin", F.col("end") - F.col("n"))
            .filter((F.col("begin") < F.col("rank")) & (F.col("rank") <= F.col("end")))
            .select(*keys, "rank", "begin", "lo", "hi", "distinct"))


def _first_places(counts: DataFrame, keys: list[str]) -> DataFrame:
    """A row per middle rank (two if the count is even): the bin of the logarithm that holds it."""
    size = F.floor(F.log2(F.abs("v")) * _BINS) + _ZERO
    bins = counts.groupBy(*keys, F.when(F.col("v") == 0, 0).when(F.col("v") < 0, -size).otherwise(size).cast("bigint").alias("bin")).agg(
        *_summed())
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranks = F.array_distinct(F.array(F.floor((total + 1) / 2), F.floor(total / 2) + 1))
    ranked = bins.withColumn("ranks", ranks).select("*", F.explode("ranks").alias("rank"), F.lit(0).cast("bigint").alias("begin"))
    return _holding(ranked, keys, "bin")


def _summed() -> list:
    return [F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("distinct")]


def _within(counts: DataFrame, places: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Counted values inside the ranges of their key."""
    met = counts.join(F.broadcast(places) if few else places, keys)
    return met.filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def exact_medians(df: DataFrame, group: str, values: list[str], total: str | None = None, ranked: int = RANKED) -> DataFrame:
    """Rows ``(group, measure, median)`` for every value column; nulls do not count.

    Equal values are counted first; with ``total``, a group of that name has those of all groups, made
    from the counts. The range of a middle rank is found from totals of bins and cut into even parts again
    until few distinct values are left in it: every cut is one pass for all groups and measures at once, over
    counts that are added up before they are shuffled. Only what is left is put in order. An even
    count gives the mean of the middle two.
    """
    long = df.select(group, F.explode(F.map_from_arrays(
        F.array(*[F.lit(v) for v in values]),
        F.array(*[F.col(v).cast("double") for v in values]))).alias("measure", "v")).filter("v is not null")
    counts = long.groupBy(group, "measure", "v").agg(F.count("*").alias("n"))
    if total is not None:
        counts = counts.unionByName(counts.groupBy("measure", "v").agg(F.sum("n").alias("n")).withColumn(group, F.lit(total)))
    counts, keys = checkpointed(counts), [group, "measure"]
    places = checkpointed(_first_places(counts, keys))
    while True:
        amount, widest = places.agg(F.count("*"), F.max("distinct")).first()
        if (widest or 0) <= ranked:
            break
        part = F.when(F.col("lo") < F.col("hi"), F.least(
            F.lit(PARTS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS))).otherwise(0)
        cut = (_within(counts, places.drop("distinct"), keys, amount <= FEW)
               .groupBy(*keys, "rank", "begin", part.alias("part")).agg(*_summed()))
        places = checkpointed(_holding(cut, keys, "part"))
    order = Window.partitionBy(*keys, "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = (_within(counts, places, keys, amount <= FEW).withColumn("last", F.col("begin") + F.sum("n").over(order))
             .filter((F.col("last") - F.col("n") < F.col("rank")) & (F.col("rank") <= F.col("last"))))
    return found.groupBy(*keys).agg(((F.min("v") + F.max("v")) / 2).alias("median"))
