"""Model and provider lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cost, mean, or_zero, ratio, uncached
from ..operators.pages import page
from ..operators.pricing import with_price
from ..ranges import DateRange, Page
from .usage import token_sums, with_effective_duration


def _model_rows(model_call: DataFrame, price: DataFrame, rng: DateRange) -> DataFrame:
    timed = with_effective_duration(rng.filter(model_call), ["session_id"], positive_only=False)
    rows = timed.groupBy("model").agg(
        F.count("*").alias("call_count"), *token_sums(),
        mean(F.sum("effective_ms"), F.count("effective_ms")).alias("avg_duration_ms"))
    spent = cost(uncached(F.col("input_tokens"), F.col("cached_input_tokens")), F.col("cached_input_tokens"),
                 F.col("output_tokens") + F.col("reasoning_tokens"))
    return with_price(rows, price).withColumn("estimated_cost", spent)


def models_list(model_call: DataFrame, price: DataFrame, rng: DateRange, part: Page | None = None) -> DataFrame:
    """Usage per model, most tokens first. Cost is null where no price is known."""
    rows = _model_rows(model_call, price, rng).select(
        F.coalesce("model", F.lit("unknown")).alias("model"), "call_count", "input_tokens", "cached_input_tokens",
        "output_tokens", "reasoning_tokens", "total_tokens",
        ratio(F.col("cached_input_tokens"), F.col("input_tokens")).alias("cache_hit_rate"), "avg_duration_ms",
        "estimated_cost")
    return page(rows, [F.col("total_tokens").desc(), F.col("call_count").desc(), F.col("model")], part)


def models_totals(model_call: DataFrame, price: DataFrame, rng: DateRange) -> DataFrame:
    """Totals over all models; the mean duration is weighted by calls."""
    rows = _model_rows(model_call, price, rng)
    return rows.agg(or_zero(F.sum("call_count")).alias("total_calls"), or_zero(F.sum("total_tokens")).alias("total_tokens"),
                    F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("total_cost"),
                    mean(F.sum(F.col("avg_duration_ms") * F.col("call_count")), F.sum("call_count")).alias("avg_duration_ms"))


def providers_list(session: DataFrame, model_call: DataFrame, rng: DateRange, part: Page | None = None) -> DataFrame:
    """Usage per provider. With a range, only sessions with a call in it count.

    Calls are summed per session before the join, so a session appears once and needs no
    distinct count.
    """
    bounded = rng.start is not None or rng.end is not None
    calls = rng.filter(model_call).groupBy("session_id").agg(
        F.count("*").alias("calls"), *token_sums(), F.sum("duration_ms").alias("ms"),
        F.count("duration_ms").alias("ms_n"))
    joined = session.select(F.col("id").alias("session_id"),
                            F.coalesce("model_provider", F.lit("unknown")).alias("provider")).join(
        calls, "session_id", "inner" if bounded else "left")
    rows = joined.groupBy("provider").agg(
        F.count("*").alias("session_count"), or_zero(F.sum("calls")).alias("model_call_count"), *token_sums(),
        mean(or_zero(F.sum("ms")), or_zero(F.sum("ms_n"))).alias("avg_model_duration_ms"))
    rows = rows.withColumn("cache_hit_rate", ratio(F.col("cached_input_tokens"), F.col("input_tokens")))
    return page(rows, [F.col("total_tokens").desc(), F.col("provider")], part)
