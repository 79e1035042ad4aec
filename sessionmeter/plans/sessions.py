"""Session list, session detail and session medians."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import call_ok, count_if, cost, day_text, mean, or_zero, ratio
from ..functions.text import any_matches
from ..operators.attribution import activity_windows, calls_of_session, window_totals
from ..operators.medians import exact_medians
from ..operators.ordered import with_next
from ..operators.pages import equal_to, member_of, page
from ..operators.pricing import with_price
from ..ranges import DateRange, Page
from .usage import billable_sums, token_sums


@dataclass(frozen=True)
class SessionFilters:
    rng: DateRange = DateRange()
    search: str | None = None
    models: tuple[str, ...] = ()
    providers: tuple[str, ...] = ()
    project: str | None = None
    branch: str | None = None
    worktree: str | None = None
    originator: str | None = None
    cli_version: str | None = None


def matching_sessions(session: DataFrame, model_call: DataFrame, wanted: SessionFilters) -> DataFrame:
    found = wanted.rng.filter(session).filter(
        any_matches(wanted.search, "cwd", "originator", "git_branch", "git_commit")
        & member_of("model_provider", wanted.providers)
        & equal_to(project_id=wanted.project, git_branch=wanted.branch, project_ref_id=wanted.worktree,
                   originator=wanted.originator, cli_version=wanted.cli_version))
    if wanted.models:
        used = model_call.filter(F.col("model").isin(*wanted.models)).select(F.col("session_id").alias("id"))
        found = found.join(used, "id", "left_semi")
    return found


def _message_facts(message: DataFrame) -> DataFrame:
    return message.groupBy("session_id").agg(F.count("*").alias("message_count"), F.min("ts").alias("first_message"),
                                             F.max("ts").alias("last_message"))


def _call_facts(model_call: DataFrame) -> DataFrame:
    return model_call.groupBy("session_id").agg(
        F.count("*").alias("model_call_count"), *token_sums(), or_zero(F.sum("duration_ms")).alias("model_ms"),
        F.count("duration_ms").alias("model_ms_n"), F.min("ts").alias("first_call"), F.max("ts").alias("last_call"))


def _tool_facts(tool_call: DataFrame, took) -> DataFrame:
    return tool_call.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.count("*").alias("tool_call_count"), count_if(call_ok()).alias("ok_count"),
        or_zero(F.sum(took)).alias("tool_ms"), F.count(took).alias("tool_ms_n"),
        F.min("start_ts").alias("first_tool"), F.max(F.coalesce("end_ts", "start_ts")).alias("last_tool"))


def _stat_columns(firsts: list[str], lasts: list[str]) -> list:
    first, last = F.least(*firsts), F.greatest(*lasts)
    counts = ["message_count", "model_call_count", "tool_call_count", "input_tokens", "cached_input_tokens",
              "output_tokens", "reasoning_tokens", "total_tokens"]
    return [*[or_zero(F.col(c)).alias(c) for c in counts],
            ratio(F.col("cached_input_tokens"), F.col("input_tokens")).alias("cache_hit_rate"),
            mean(F.col("model_ms"), F.col("model_ms_n")).alias("avg_model_duration_ms"),
            mean(F.col("tool_ms"), F.col("tool_ms_n")).alias("avg_tool_duration_ms"),
            ratio(F.col("ok_count"), F.col("tool_call_count")).alias("success_rate"),
            F.when(last >= first, last - first).alias("duration_ms")]


def sessions_list(session: DataFrame, message: DataFrame, model_call: DataFrame, tool_call: DataFrame,
                  wanted: SessionFilters = SessionFilters(), part: Page | None = None) -> DataFrame:
    """Sessions, newest first, with counts, tokens, mean durations, success rate and span.

    Child rows count whether or not they lie in the range. For a page, the sessions are
    chosen first and the children are cut down to them; Spark chooses how, by their number.
    """
    chosen = page(matching_sessions(session, model_call, wanted), [F.col("ts").desc(), F.col("id")], part)
    if part is not None:
        ids = chosen.select(F.col("id").alias("session_id"))
        message, model_call, tool_call = (d.join(ids, "session_id", "left_semi")
                                          for d in (message, model_call, tool_call))
    facts = chosen.withColumnRenamed("id", "session_id")
    for child in (_message_facts(message), _call_facts(model_call), _tool_facts(tool_call, F.col("duration_ms"))):
        facts = facts.join(child, "session_id", "left")
    return facts.select(
        F.col("session_id").alias("id"), "ts", "cwd", "originator", "cli_version", "model_provider", "git_branch",
        "git_commit", *_stat_columns(["first_call", "first_message", "first_tool"],
                                     ["last_call", "last_message", "last_tool"])).orderBy(F.col("ts").desc(), "id")


def session_stats(session: DataFrame, message: DataFrame, model_call: DataFrame, tool_call: DataFrame,
                  rng: DateRange = DateRange(), ids: list[str] | None = None) -> DataFrame:
    """Detail statistics for the given sessions, or for all at once.

    Tool calls without a session count for every session whose activity window holds them.
    """
    if ids is not None:
        session = session.filter(F.col("id").isin(*ids))
        message, model_call = (d.filter(F.col("session_id").isin(*ids)) for d in (message, model_call))
    calls = _call_facts(rng.filter(model_call))
    tools = rng.filter(tool_call, "start_ts")
    took = F.coalesce(F.col("duration_ms"), F.col("end_ts") - F.col("start_ts"))
    windows = activity_windows(session, calls.select("session_id", F.col("first_call").alias("first_ts"),
                                                     F.col("last_call").alias("last_ts")))
    nearby = window_totals(windows, tools.filter(F.col("session_id").isNull()))
    facts = session.select(F.col("id").alias("session_id"))
    for child in (_message_facts(rng.filter(message)), calls, _tool_facts(tools, took), nearby):
        facts = facts.join(child, "session_id", "left")
    facts = facts.select(
        "session_id", "message_count", "model_call_count", "input_tokens", "cached_input_tokens", "output_tokens",
        "reasoning_tokens", "total_tokens", "model_ms", "model_ms_n", "first_call", "last_call",
        *[(or_zero(F.col(a)) + or_zero(F.col(b))).alias(a) for a, b in
          (("tool_call_count", "n"), ("ok_count", "ok"), ("tool_ms", "dur"), ("tool_ms_n", "dur_n"))],
        F.least("first_tool", "first_ts").alias("first_tool"), F.greatest("last_tool", "last_ts").alias("last_tool"))
    return facts.select(F.col("session_id").alias("id"),
                        *_stat_columns(["first_call", "first_tool"], ["last_call", "last_tool"]))


def session_items(session_id: str, kind: str, session: DataFrame, message: DataFrame, model_call: DataFrame,
                  tool_call: DataFrame, session_context: DataFrame | None = None, rng: DateRange = DateRange(),
                  part: Page | None = None) -> DataFrame:
    """One page of a session's ``messages``, ``model_calls``, ``tool_calls`` or all of its ``contexts``."""
    mine = lambda df: rng.filter(df.filter(F.col("session_id") == session_id))
    order = [F.col("ts"), F.col("id")]
    if kind == "messages":
        return page(mine(message).select("id", "ts", "role", "content"), order, part)
    if kind == "contexts":
        return mine(session_context).select("id", "ts", "model", "model_provider").orderBy(*order)
    if kind == "model_calls":
        timed = with_next(mine(model_call), ["session_id"], "ts", "id", "next_ts")
        wait = F.when(F.col("next_ts") > F.col("ts"), F.col("next_ts") - F.col("ts"))
        return page(timed.select("id", "ts", "model", "input_tokens", "cached_input_tokens", "output_tokens",
                                 "reasoning_tokens", "total_tokens",
                                 F.coalesce("duration_ms", wait).alias("duration_ms")), order, part)
    if kind == "tool_calls":
        held = session.filter(F.col("id") == session_id)
        calls = mine(model_call).groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        found = calls_of_session(activity_windows(held, calls), rng.filter(tool_call, "start_ts"), session_id)
        return page(found.select("id", "tool_name", "command", "status", "start_ts", "end_ts",
                                 F.coalesce(F.col("duration_ms"), F.col("end_ts") - F.col("start_ts")).alias("duration_ms"),
                                 "exit_code", "error", "stdout_bytes", "stderr_bytes", "correlation_key"),
                    [F.col("start_ts"), F.col("id")], part)
    raise ValueError(f"unknown kind of session item: {kind}")


def session_medians(session: DataFrame, model_call: DataFrame, price: DataFrame, rng: DateRange) -> DataFrame:
    """Medians per UTC day of the session, and overall in the row whose date is null.

    Cost counts the calls in range; calls, tokens and duration count all of a session's calls.
    """
    usage = model_call.groupBy("session_id").agg(
        F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"),
        (F.max("ts") - F.min("ts")).alias("duration"))
    spent = rng.filter(model_call).groupBy("session_id", "model").agg(*billable_sums())
    spent = (with_price(spent, price).groupBy("session_id")
             .agg(F.sum(cost(F.col("fresh"), F.col("cached"), F.col("produced"))).alias("cost")))
    facts = (rng.filter(session).select(F.col("id").alias("session_id"), day_text(F.col("ts")).alias("date"))
             .join(usage, "session_id", "left").join(spent, "session_id", "left")
             .select("date", or_zero(F.col("calls")).alias("calls"), or_zero(F.col("tokens")).alias("tokens"), F.coalesce("cost", F.lit(0.0)).alias("cost"), "duration"))
    measures = ["calls", "tokens", "cost", "duration"]
    medians = exact_medians(facts, "date", measures, total="all")
    return medians.groupBy(F.when(F.col("date") != "all", F.col("date")).alias("date")).agg(*[
        F.coalesce(F.max(F.when(F.col("measure") == m, F.col("median"))), F.lit(0.0)).alias(f"median_{m}")
        for m in measures])
