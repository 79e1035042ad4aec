"""Tool-call list, summary and breakdowns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import call_failed, call_ok, count_if, mean, or_zero, ratio
from ..functions.text import any_matches
from ..operators.pages import equal_to, member_of, page
from ..ranges import DateRange, Page
from .compare import current, in_periods, previous
from .usage import of_project

STATUSES = ("ok", "failed", "unknown")


@dataclass(frozen=True)
class ToolFilters:
    rng: DateRange = DateRange()
    session_id: str | None = None
    status: tuple[str, ...] = ()
    tools: tuple[str, ...] = ()
    search: str | None = None
    exit_code: int | None = None
    has_error: bool = False
    min_duration_ms: int | None = None
    max_duration_ms: int | None = None
    project: str | None = None


def _has_error() -> Column:
    return F.coalesce(F.col("error") != "", F.lit(False))


def _apart_from_range(tool_call: DataFrame, session: DataFrame | None, wanted: ToolFilters) -> DataFrame:
    found = tool_call.filter(
        equal_to(session_id=wanted.session_id, exit_code=wanted.exit_code)
        & member_of("status", wanted.status) & member_of("tool_name", wanted.tools)
        & any_matches(wanted.search, "command"))
    if wanted.has_error:
        found = found.filter(_has_error())
    if wanted.min_duration_ms is not None:
        found = found.filter(F.col("duration_ms") >= wanted.min_duration_ms)
    if wanted.max_duration_ms is not None:
        found = found.filter(F.col("duration_ms") <= wanted.max_duration_ms)
    return of_project(found, session, wanted.project)


def matching_calls(tool_call: DataFrame, session: DataFrame | None, wanted: ToolFilters) -> DataFrame:
    return _apart_from_range(wanted.rng.filter(tool_call, "start_ts"), session, wanted)


def tool_calls_list(tool_call: DataFrame, session: DataFrame | None = None, wanted: ToolFilters = ToolFilters(),
                    part: Page | None = None) -> DataFrame:
    """Tool calls, newest first."""
    rows = matching_calls(tool_call, session, wanted).select(
        "id", "session_id", "tool_name", "command", "status", "start_ts", "end_ts", "duration_ms", "exit_code",
        "error", "stdout_bytes", "stderr_bytes", "correlation_key")
    return page(rows, [F.col("start_ts").desc(), F.col("id")], part)


def tool_calls_summary(tool_call: DataFrame, session: DataFrame | None = None,
                       wanted: ToolFilters = ToolFilters()) -> DataFrame:
    """Counts, mean duration and success rate, with the previous period in ``prev_*``.

    Unknown status counts as ok as well as unknown, and a call may be both ok and failed.
    """
    calls = _apart_from_range(in_periods(tool_call, wanted.rng, "start_ts"), session, wanted)
    totals = calls.agg(*[c.alias(prefix + name) for prefix, side in (("", current), ("prev_", previous))
                         for name, c in (("total", F.count(side(F.lit(1)))),
                                         ("ok", F.count(side(F.when(call_ok(), 1)))),
                                         ("failed", F.count(side(F.when(call_failed(), 1)))),
                                         ("unknown", F.count(side(F.when(F.col("status") == "unknown", 1)))),
                                         ("ms", or_zero(F.sum(side(F.col("duration_ms"))))),
                                         ("ms_n", F.count(side(F.col("duration_ms")))))])
    known = wanted.rng.previous() is not None
    out = []
    for prefix in ("", "prev_"):
        columns = [F.col(prefix + n).alias(prefix + n) for n in ("total", "ok", "failed", "unknown")]
        columns.append(mean(F.col(prefix + "ms"), F.col(prefix + "ms_n")).alias(prefix + "avg_duration_ms"))
        columns.append(ratio(F.col(prefix + "ok"), F.col(prefix + "total")).alias(prefix + "success_rate"))
        out += columns
    row = totals.select(*out)
    if known:
        return row
    return row.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name.startswith("prev_") else F.col(f.name)
                        for f in row.schema.fields])


def tool_breakdown(tool_call: DataFrame, session: DataFrame | None = None, wanted: ToolFilters = ToolFilters(),
                   k: int | None = 20) -> DataFrame:
    """Most used tools with mean duration and success rate."""
    rows = matching_calls(tool_call, session, wanted).groupBy(F.col("tool_name").alias("tool")).agg(
        F.count("*").alias("count"), mean(or_zero(F.sum("duration_ms")), F.count("duration_ms")).alias("avg_duration_ms"),
        ratio(count_if(call_ok()), F.count("*")).alias("success_rate"))
    ordered = rows.orderBy(F.col("count").desc(), "tool")
    return ordered if k is None else ordered.limit(k)


def failure_breakdown(tool_call: DataFrame, session: DataFrame | None = None, wanted: ToolFilters = ToolFilters(),
                      k: int | None = 10) -> DataFrame:
    """Most frequent error texts of failed calls, with one of the tools."""
    rows = matching_calls(tool_call, session, wanted).filter(call_failed() & _has_error()).groupBy("error").agg(
        F.count("*").alias("count"), F.max("tool_name").alias("tool"))
    ordered = rows.orderBy(F.col("count").desc(), "error")
    return ordered if k is None else ordered.limit(k)


def strict_success_rate(tool_call: DataFrame, rng: DateRange = DateRange()) -> DataFrame:
    """Share of calls with status ok, 0 without calls."""
    return rng.filter(tool_call, "start_ts").agg(
        ratio(count_if(F.col("status") == "ok"), F.count("*")).alias("success_rate"))


def avg_tool_duration(tool_call: DataFrame, rng: DateRange = DateRange()) -> DataFrame:
    """Mean of the recorded durations, 0 without any."""
    return rng.filter(tool_call, "start_ts").agg(
        mean(or_zero(F.sum("duration_ms")), F.count("duration_ms")).alias("avg_duration_ms"))


def calls_by_status(tool_call: DataFrame) -> DataFrame:
    """Number of calls for each of the three states, 0 included."""
    row = tool_call.agg(*[count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return row.select(F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("count")) for s in STATUSES])))


def top_failing_commands(tool_call: DataFrame, k: int | None, rng: DateRange = DateRange()) -> DataFrame:
    """Commands that failed most, with the error of their newest failure (which may be null)."""
    newest = F.max_by(F.struct("error"), F.struct("start_ts", "id"))
    rows = (rng.filter(tool_call, "start_ts").filter((F.col("status") == "failed") & F.col("command").isNotNull())
            .groupBy("command").agg(F.count("*").alias("fail_count"), newest.alias("newest"),
                                    F.max("start_ts").alias("last_ts")))
    ordered = rows.orderBy(F.col("fail_count").desc(), F.col("last_ts").desc(), "command").select(
        "command", "fail_count", F.col("newest.error").alias("last_error"))
    return ordered if k is None else ordered.limit(k)
