"""The ingest job: log files to tables, all or only what is new."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.scalars import DAY_MS, day_text
from .operators import correlation, desktoplog, merging, records
from .operators.toollog import TIMED_LINE, tool_log_events, tool_log_records
from .plans import upkeep
from .ranges import DateRange
from .runtime import checkpointed
from .sources.jsonl import parse_jsonl
from .sources.ledger import latest_ledger, next_ledger
from .sources.lines import discover
from .sources.tables import DAY_OF, Tables
from .sources.tail import changed_files, read_new


@dataclass(frozen=True)
class LogSources:
    """Where the logs lie. ``remotes`` maps folders to remotes, ``inventory`` lists present worktrees."""

    sessions: str | None = None
    tool_log: str | None = None
    desktop_logs: tuple[str, ...] = ()
    desktop_glob: str = "*-desktop-*.log"
    remotes: DataFrame | None = None
    inventory: DataFrame | None = None


@dataclass(frozen=True)
class IngestOptions:
    full: bool = False
    keep_content: bool = False
    tz: str = "UTC"
    home: str | None = None


class Touched:
    """Days, per table, of all rows a run has read, stored already or not: a repeated run touches the same ones.

    They are days of a calendar, however many rows there are.
    """

    def __init__(self):
        self.days: dict[str, set[str]] = {}

    def note(self, name: str, batch: DataFrame) -> None:
        found = batch.select(day_text(F.col(DAY_OF[name])).alias("day")).distinct().collect()
        self.days.setdefault(name, set()).update(r.day for r in found)

    def of(self, *names: str) -> list[str]:
        return sorted(set().union(*(self.days.get(n, ()) for n in names)))


#: Rollups with a running balance: source table, column of the balance, counts (the first two add and take away).
BALANCES = {
    "worktree_daily": ("worktree_event", "active_count", {
        "created_count": ["created"], "deleted_count": ["deleted", "archived"], "error_count": ["error"]}),
    "automation_daily": ("automation_event", "backlog_peak", {
        "runs_queued": ["queued"], "runs_completed": ["completed"], "runs_failed": ["failed"]}),
}


def refresh_rollups(tables: Tables, touched: Touched) -> None:
    """Compute anew the touched days of the daily tables, and of balances the days after them; only their partitions are read and written."""
    if days := touched.of("message", "model_call"):
        dated = lambda name: tables.read(name, keep_day=True).filter(F.col("day").isin(days))
        tables.write_days("daily_activity", upkeep.daily_activity_rollup(dated("message"), dated("model_call")))
    for name, (source, balance, kinds) in BALANCES.items():
        if days := touched.of(source):
            events = tables.read(source, keep_day=True).filter(F.col("day") >= days[0])
            last = tables.read(name).filter(F.col("date") < days[0]).orderBy(F.col("date").desc()).limit(1).collect()
            tables.write_days(name, checkpointed(upkeep.balances_since(events, kinds, last[0][balance] if last else 0, balance)))


def _near(tables: Tables, name: str, batch: DataFrame) -> DataFrame:
    """Stored rows of the days a batch touches. Equal dedup keys imply equal times."""
    ts = "ts" if "ts" in batch.columns else DAY_OF[name]
    low, high = batch.agg(F.min(ts), F.max(ts)).first()
    return tables.read(name, DateRange(low, high)) if low is not None else tables.read(name).limit(0)


def _store(tables: Tables, name: str, batch: DataFrame, order: list[Column], touched: Touched | None = None) -> DataFrame | None:
    """Append what is new by dedup key and id; return rejects for ids that are taken.

    Ids that are the dedup key itself need no further look; only native ids are compared with
    the whole table.
    """
    batch = checkpointed(batch)
    if touched is not None and name in ("message", "model_call"):
        touched.note(name, batch)
    fresh = merging.append_new(_near(tables, name, batch), batch, ("dedup_key",), order)
    own, native = fresh.filter("id = dedup_key"), fresh.filter("id <> dedup_key")
    stored = tables.read(name).filter("id <> dedup_key").select("id", "dedup_key")
    valid, rejects = merging.split_unique(native, stored, order)
    valid = checkpointed(own.unionByName(valid))
    rejects = checkpointed(rejects)
    tables.append(name, valid)
    return rejects


def _context_before(tables: Tables, changed: DataFrame) -> DataFrame:
    """Session and models in force where reading goes on, for files that are not read from their start.

    What a run left that broke off before its ledger lies behind that place and does not count.
    """
    places = changed.filter("from_line > 0").select("path", "begun_at", "from_line")
    left = tables.read("carried_context").join(places, ["path", "begun_at"]).filter("line <= from_line")
    return left.groupBy(F.col("path").alias("file"), "session_id").agg(
        F.max("line").alias("line"), F.max_by("value", "line").alias("value"))


def ingest_sessions(tables: Tables, changed: DataFrame, now_ms: int, options: IngestOptions = IngestOptions(),
                    remotes: DataFrame | None = None, touched: Touched | None = None) -> tuple[DataFrame, int]:
    """Read what is new in session files (``tail.changed_files``); returns the ledger rows and the number of lines taken."""
    lines, files = read_new(changed, now_ms)
    good, bad = parse_jsonl(lines)
    typed = checkpointed(records.typed_lines(good, options.keep_content))
    context = checkpointed(records.with_context(typed, _context_before(tables, changed)))
    begun = files.select(F.col("path").alias("file"), "begun_at")
    tables.append("carried_context", records.context_left(context).join(begun, "file").withColumnRenamed("file", "path"))
    context = context.filter("is_new")
    # Rows arrive by time of their file, then by line.
    updates = checkpointed(next_ledger(files, now_ms))
    file_times = changed.select(F.col("path").alias("source_file"), "mtime_ms")
    arrived = lambda rows: checkpointed(rows.join(file_times, "source_file"))
    arrival = F.struct("mtime_ms", "source_file", "source_line")
    order = [arrival]

    sessions = arrived(merging.with_project(records.sessions(context), remotes))
    tables.replace("project", merging.merge_projects(tables.read("project"), merging.project_rows(sessions, arrival)))
    tables.replace("project_ref", merging.merge_refs(tables.read("project_ref"), merging.ref_rows(sessions, arrival)))
    rejects = _store(tables, "session", sessions.drop("git_remote", "project_name"), order)
    known = tables.read("session").select("id")
    for name, rows in (("message", records.messages(context)), ("model_call", records.model_calls(context)),
                       ("session_context", records.contexts(context))):
        valid, orphans = merging.split_valid(arrived(rows), known)
        rejects = rejects.unionByName(_store(tables, name, valid, order, touched)).unionByName(orphans)
    tables.append("reject", rejects.unionByName(_new(bad, lines)))
    return updates, typed.filter("is_new").count()


def _new(rejects: DataFrame, lines: DataFrame) -> DataFrame:
    return rejects.join(lines.filter("is_new").select("file", "line"), ["file", "line"], "left_semi")


#: What tells rows of the tool log apart: the key has 64 bits, so what it is made of is compared too.
TOOL_LOG_KEYS = {"tool_call": ("dedup_key", "source_file", "source_line", "start_ts"),
                 "tool_call_event": ("dedup_key", "source_file", "source_line", "event_type", "ts")}


def _pending_starts(tables: Tables, events: DataFrame) -> DataFrame:
    """Stored starts that still wait for their end when the given events begin, as events."""
    low = events.agg(F.min("ts")).first()[0]
    if low is None:
        return events.withColumn("carried", F.lit(True)).limit(0)
    near = DateRange(low - correlation.WINDOW_MS, low + correlation.WINDOW_MS)
    files = events.select(F.col("file").alias("source_file")).distinct()
    waiting = tables.read("tool_call", near).filter("end_ts is null").join(files, "source_file", "left_semi").select("source_file", "source_line")
    starts = tables.read("tool_call_event", near).filter("event_type = 'start'").join(waiting, ["source_file", "source_line"], "left_semi")
    said = lambda name: F.get_json_object("payload", f"$.{name}")
    given = {"file": F.col("source_file"), "line": F.col("source_line"), "ts": F.col("ts"), "rank": F.lit(0), "event_type": F.lit("start"),
             "tool_name": F.col("tool_name"), "command": said("command"), "signature": said("signature")}
    return starts.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in events.dtypes], F.lit(True).alias("carried"))


def ingest_tool_log(tables: Tables, changed: DataFrame, now_ms: int, options: IngestOptions = IngestOptions()) -> tuple[DataFrame, int]:
    """Read what is new in tool logs, from the last record on, which may have gone on.

    New ends may belong to starts that earlier runs stored without one; those take part as they were left.
    """
    lines, files = read_new(changed, now_ms, whole_lines_only=True, hold=F.col("value").rlike(TIMED_LINE))
    read = checkpointed(tool_log_events(tool_log_records(lines, options.tz)))
    key = ["file", "line", "event_type", "ts"]
    stored = _near(tables, "tool_call_event", read).select(F.col("source_file").alias("file"), F.col("source_line").alias("line"), "event_type", "ts")
    fresh = checkpointed(read.join(stored, key, "left_anti"))
    pairs = checkpointed(correlation.correlate(
        fresh.withColumn("carried", F.lit(False)).unionByName(_pending_starts(tables, fresh))))
    order = [F.col("source_file"), F.col("source_line")]
    calls, events = checkpointed(correlation.tool_calls(pairs)), checkpointed(correlation.tool_call_events(pairs))
    _finish_calls(tables, calls)
    for name, rows in (("tool_call", calls), ("tool_call_event", events)):
        tables.append(name, merging.append_new(_near(tables, name, rows), rows, (TOOL_LOG_KEYS[name],), order))
    return next_ledger(files, now_ms), pairs.count()


def _finish_calls(tables: Tables, calls: DataFrame) -> None:
    """Give stored calls the end they lacked when an earlier run read the log.

    Only the days of such calls are written anew.
    """
    stored, key = _near(tables, "tool_call", calls), list(TOOL_LOG_KEYS["tool_call"])
    waiting = stored.filter(F.col("end_ts").isNull()).select(*key)
    ended = checkpointed(calls.filter(F.col("end_ts").isNotNull()).join(waiting, key, "left_semi"))
    if ended.isEmpty():
        return
    low, high = ended.agg(F.min("start_ts"), F.max("start_ts")).first()
    days = DateRange(low // DAY_MS * DAY_MS, high // DAY_MS * DAY_MS + DAY_MS - 1)
    rest = tables.read("tool_call", days).join(ended, key, "left_anti")
    tables.rewrite("tool_call", checkpointed(rest.unionByName(ended)))


def ingest_desktop_logs(tables: Tables, changed: DataFrame, now_ms: int, options: IngestOptions = IngestOptions(),
                        touched: Touched | None = None) -> tuple[DataFrame, int]:
    """Read what is new in desktop logs: stored records, worktree events and automation events."""
    lines, files = read_new(changed, now_ms, whole_lines_only=True)
    found, bad = desktoplog.desktop_records(lines)
    safe = checkpointed(desktoplog.safe_records(found, now_ms, options.home))
    batches = (("desktop_log_event", safe.drop("said"), [F.col("file_path"), F.col("line_number")]),
               ("worktree_event", desktoplog.worktree_events(safe, options.home), [F.col("ts")]),
               ("automation_event", desktoplog.automation_events(safe, options.home), [F.col("ts")]))
    for name, rows, order in batches:
        rows = checkpointed(rows)
        if touched is not None:
            touched.note(name, rows)
        tables.append(name, merging.append_new(_near(tables, name, rows), rows, ("dedup_key",), order))
    tables.append("reject", _new(bad, lines))
    return next_ledger(files, now_ms), safe.count()


def ingest(tables: Tables, sources: LogSources, now_ms: int, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Run all sources; one row ``files_processed, lines_ingested, errors, duration_ms``.

    The daily tables follow the days the run read, and the ledger is written last. A run that breaks off is repeated whole, and its rows are
    recognised by their keys.
    """
    spark, began = tables.spark, time.monotonic()
    ledger = checkpointed(latest_ledger(tables.read("ingest_state")))
    seen = ledger.limit(0) if options.full else ledger
    rejects_before = tables.read("reject").count()
    updates, taken, touched = [], 0, Touched()

    def done(result):
        nonlocal taken
        updates.append(checkpointed(result[0]))
        taken += result[1]

    def changes(roots: list[str], glob: str) -> DataFrame | None:
        found = checkpointed(changed_files(discover(spark, roots, glob), seen))
        return None if found.isEmpty() else found

    if sources.sessions and (changed := changes([sources.sessions], "*.jsonl")):
        done(ingest_sessions(tables, changed, now_ms, options, sources.remotes, touched))
    if sources.tool_log and (changed := changes([sources.tool_log], "*")):
        done(ingest_tool_log(tables, changed, now_ms, options))
    if sources.desktop_logs and (changed := changes(list(sources.desktop_logs), sources.desktop_glob)):
        done(ingest_desktop_logs(tables, changed, now_ms, options, touched))
    if sources.inventory is not None:
        archived = checkpointed(desktoplog.archived_events(tables.read("worktree_event"), sources.inventory, now_ms))
        touched.note("worktree_event", archived)
        tables.append("worktree_event", archived)
    refresh_rollups(tables, touched)
    files = 0
    for rows in updates:
        tables.append("ingest_state", rows)
        files += rows.count()
    errors = tables.read("reject").count() - rejects_before
    return spark.range(1).select(F.lit(files).alias("files_processed"), F.lit(taken).alias("lines_ingested"),
                                 F.lit(errors).alias("errors"),
                                 F.lit(round((time.monotonic() - began) * 1000)).cast("bigint").alias("duration_ms"))


def backfill(tables: Tables, remotes: DataFrame | None = None, everything: bool = False) -> None:
    """Derive missing project ids of stored sessions, or all of them again.

    Sessions are the one fact table that changes in place: it is written anew, once.
    """
    sessions = checkpointed(merging.backfill_projects(tables.read("session"), remotes, everything))
    derived = checkpointed(merging.with_project(sessions.filter("changed"), remotes))
    arrival = F.struct("ts", "source_file", "source_line")
    tables.replace("project", merging.merge_projects(tables.read("project"), merging.project_rows(derived, arrival)))
    tables.replace("project_ref", merging.merge_refs(tables.read("project_ref"), merging.ref_rows(derived, arrival)))
    tables.rewrite("session", sessions.drop("changed"))
