"""Pieces the usage reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uncached
from ..operators.ordered import with_next

TOKENS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens"]


def of_project(df: DataFrame, session: DataFrame, project: str | None) -> DataFrame:
    """Rows whose session belongs to a project; rows without a session drop out."""
    if project is None:
        return df
    ids = session.filter(F.col("project_id") == project).select(F.col("id").alias("session_id"))
    return df.join(ids, "session_id", "left_semi")


def token_sums() -> list[Column]:
    return [F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS]


def billable_sums() -> list[Column]:
    """Sums that price a set of calls one by one."""
    return [F.sum(uncached(F.col("input_tokens"), F.col("cached_input_tokens"))).alias("fresh"),
            F.sum("cached_input_tokens").alias("cached"),
            F.sum(F.col("output_tokens") + F.col("reasoning_tokens")).alias("produced")]


def with_effective_duration(calls: DataFrame, keys: list[str], positive_only: bool) -> DataFrame:
    """Add ``effective_ms``: the recorded duration, else the time to the session's next call."""
    timed = with_next(calls, keys, "ts", "id", "next_ts")
    own = F.when(F.col("duration_ms") > 0, F.col("duration_ms")) if positive_only else F.col("duration_ms")
    waited = F.when(F.col("next_ts") > F.col("ts"), F.col("next_ts") - F.col("ts"))
    return timed.withColumn("effective_ms", F.coalesce(own, waited)).drop("next_ts")


def calls_per_session_model(model_call: DataFrame) -> DataFrame:
    """Token sums per session and model. A session with very many calls shrinks before any join."""
    return model_call.groupBy("session_id", "model").agg(F.count("*").alias("calls"), *token_sums())
