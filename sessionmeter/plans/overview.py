"""Overview: KPIs against the previous period, and the daily usage series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (call_ok, cost, day_text, mean, or_zero, ratio, ratio_or_null, uncached)
from ..operators.pricing import with_price
from ..ranges import DateRange
from .compare import current, in_periods, kpi_rows, previous, with_delta
from .usage import billable_sums, of_project, with_effective_duration


def overview_kpis(session: DataFrame, model_call: DataFrame, tool_call: DataFrame, price: DataFrame,
                  rng: DateRange, project: str | None = None) -> DataFrame:
    """Rows ``metric, value, previous, delta, delta_pct``; each table is scanned once."""
    calls = of_project(in_periods(model_call, rng), session, project)
    timed = with_effective_duration(calls, ["period", "session_id"], positive_only=True)
    facts = {
        "tokens": F.col("total_tokens"), "input": F.col("input_tokens"), "cached": F.col("cached_input_tokens"),
        "fresh": uncached(F.col("input_tokens"), F.col("cached_input_tokens")),
        "produced": F.col("output_tokens") + F.col("reasoning_tokens"), "dur": F.col("effective_ms"),
    }
    by_model = timed.groupBy("model", "period").agg(
        *[F.sum(fact).alias(name) for name, fact in facts.items()], F.count("*").alias("calls"),
        F.count("effective_ms").alias("dur_n"))
    priced = with_price(by_model, price).withColumn(
        "cost", cost(F.col("fresh"), F.col("cached"), F.col("produced")))
    names = ["tokens", "input", "cached", "calls", "dur", "dur_n", "cost"]
    usage = priced.agg(*[or_zero(F.sum(side(F.col(n)))).alias(f"{tag}_{n}")
                         for tag, side in (("cur", current), ("prev", previous)) for n in names])
    pair = lambda make: (make("cur"), make("prev"))
    col = lambda name: pair(lambda tag: F.col(f"{tag}_{name}"))
    usage_rows = kpi_rows(usage, {
        "total_tokens": col("tokens"),
        "cache_hit_rate": (ratio(F.col("cur_cached"), F.col("cur_input")),
                           ratio_or_null(F.col("prev_cached"), F.col("prev_input"))),
        "model_calls": col("calls"),
        "total_cost": col("cost"),
        "avg_model_duration_ms": pair(lambda tag: mean(F.col(f"{tag}_dur"), F.col(f"{tag}_dur_n"))),
    }, rng)

    sessions = in_periods(session, rng)
    if project is not None:
        sessions = sessions.filter(F.col("project_id") == project)
    session_rows = kpi_rows(
        sessions.agg(F.count(current(F.lit(1))).alias("cur"), F.count(previous(F.lit(1))).alias("prev")),
        {"sessions": (F.col("cur"), F.col("prev"))}, rng)

    tools = of_project(in_periods(tool_call, rng, "start_ts"), session, project)
    took = (F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
            .when(F.col("end_ts") >= F.col("start_ts"), F.col("end_ts") - F.col("start_ts")))
    totals = tools.agg(*[c.alias(f"{tag}_{name}") for tag, side in (("cur", current), ("prev", previous))
                         for name, c in (("n", F.count(side(F.lit(1)))),
                                         ("ok", F.count(side(F.when(call_ok(), 1)))),
                                         ("dur", or_zero(F.sum(side(took)))),
                                         ("dur_n", F.count(side(took))))])
    tool_rows = kpi_rows(totals, {
        "tool_calls": col("n"),
        "success_rate": (ratio(F.col("cur_ok"), F.col("cur_n")), ratio_or_null(F.col("prev_ok"), F.col("prev_n"))),
        "avg_tool_duration_ms": pair(lambda tag: mean(F.col(f"{tag}_dur"), F.col(f"{tag}_dur_n"))),
    }, rng)
    return with_delta(usage_rows, session_rows, tool_rows)


def overview_daily(session: DataFrame, model_call: DataFrame, price: DataFrame, rng: DateRange,
                   project: str | None = None, tz: str = "UTC") -> DataFrame:
    """Tokens, calls, cache rate and cost per day. Total here is input + output + reasoning."""
    calls = of_project(rng.filter(model_call), session, project)
    by_model = calls.groupBy(day_text(F.col("ts"), tz).alias("date"), "model").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("reasoning_tokens").alias("reasoning_tokens"), F.count("*").alias("model_calls"), *billable_sums())
    priced = with_price(by_model, price).withColumn("cost", cost(F.col("fresh"), F.col("cached"), F.col("produced")))
    return priced.groupBy("date").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("cached").alias("cached_input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"),
        (F.sum("input_tokens") + F.sum("output_tokens") + F.sum("reasoning_tokens")).alias("total_tokens"),
        F.sum("model_calls").alias("model_calls"),
        ratio(F.sum("cached"), F.sum("input_tokens")).alias("cache_hit_rate"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("estimated_cost")).orderBy("date")
