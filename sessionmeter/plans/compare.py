"""KPI rows with the previous period beside the current one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranges import DateRange


def in_periods(df: DataFrame, rng: DateRange, ts: str = "ts") -> DataFrame:
    """Rows of the range and of the one before it, marked in ``period``, from one scan."""
    before = rng.previous()
    if before is None:
        return rng.filter(df, ts).withColumn("period", F.lit("current"))
    both = DateRange(before.start, rng.end).filter(df, ts)
    return both.withColumn("period", F.when(F.col(ts) >= rng.start, "current").otherwise("previous"))


def current(value: Column) -> Column:
    return F.when(F.col("period") == "current", value)


def previous(value: Column) -> Column:
    return F.when(F.col("period") == "previous", value)


def kpi_rows(one_row: DataFrame, metrics: dict[str, tuple[Column, Column]], rng: DateRange) -> DataFrame:
    """Turn one row of totals into rows ``metric, value, previous``."""
    known = rng.previous() is not None
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), now.cast("double").alias("value"),
                 (before if known else F.lit(None)).cast("double").alias("previous"))
        for name, (now, before) in metrics.items()])))


def with_delta(*parts: DataFrame) -> DataFrame:
    """Union of KPI rows with the change, absolute and relative."""
    rows = reduce(DataFrame.unionByName, parts)
    delta = F.col("value") - F.col("previous")
    return rows.select("metric", "value", "previous", delta.alias("delta"),
                       F.when(F.col("previous") != 0, delta / F.col("previous")).alias("delta_pct"))
