"""JSON lines: parsed documents on one side, rejects on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged
from ..functions.text import strip
from ..functions.variants import unwrapped_json, whole_json, wrapped_json


def parse_jsonl(lines: DataFrame, raw_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``. Blank lines keep their number and yield nothing.

    A reject keeps its whole line, so that it can be replayed, unless ``raw_limit`` cuts it.
    """
    raw = F.col("value") if raw_limit is None else F.substring("value", 1, raw_limit)
    filled = staged(lines, text=strip(F.col("value"))).filter(F.col("text") != "")
    wrapped = staged(filled, wrapped=wrapped_json(F.col("text"))).drop("text")
    whole = whole_json(F.col("wrapped"))
    rejects = wrapped.filter(~whole).select("file", "line", F.lit("Invalid JSON").alias("error"), raw.alias("raw"))
    return wrapped.filter(whole).withColumn("doc", unwrapped_json(F.col("wrapped"))).drop("value", "wrapped"), rejects
