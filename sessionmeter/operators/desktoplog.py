"""Desktop application logs: records, privacy filter, worktree and automation events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dedup_key
from ..functions.staging import staged
from ..functions.text import ALERT_LEVELS, extract, may_store, redact, strip, strip_escapes
from .ordered import carry_forward, latest_per_key

# Forms of the log and of its file names.
RECORD_START = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\s"
HEADER = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z)\s+([a-zA-Z]+)\s+(.*)$"
PAYLOAD = r"^(.*?)(\s\{[\s\S]*)$"
FILE_NAME = r"(?i)desktop-([a-f0-9-]+)-(\d+)-t(\d+)-i(\d+)-\d{6}-(\d+)\.log$"
PATHS = (r"""["'](/[^"']+)["']""", r"""["']([A-Za-z]:\\[^"']+)["']""", r"""(/[^\s'"`]+)""", r"""([A-Za-z]:\\[^\s'"`]+)""")
BRANCH = r"(?i)branch[:=\s]+([A-Za-z0-9._/-]+)"
THREAD = r"(?i)thread(?:_id)?[:=\s]+([A-Za-z0-9-]+)"
WORKTREE_FOLDERS = ("/.codex/worktrees/", "\\.codex\\worktrees\\")
WATCHER_STARTED = r"starting git repo watcher\b"
WORKTREE_WORDS = {"created": r"(create|created|creating)\b", "archived": r"(delete|deleted|remove|removed)\b",
                  "error": r"(error|failed|fatal|exception)\b"}
AUTOMATION_WORDS = {"queued": r"(queued|enqueue|enqueued)\b", "completed": r"(completed|complete|finished|succeeded)\b",
                    "failed": r"(failed|error|exception)\b"}


def desktop_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` from ``file, line, value``. Lines before the first record drop out."""
    clean = staged(lines.select("file", "line", "value"), text=strip_escapes(F.col("value"))).drop("value")
    marked = clean.withColumn("opens", F.when(F.col("text").rlike(RECORD_START), F.col("line")))
    owned = carry_forward(marked, ["file"], "line", "opens", "start", include_current=True).filter("start is not null")
    whole = owned.groupBy("file", F.col("start").alias("line")).agg(
        F.sort_array(F.collect_list(F.struct("line", "text"))).alias("parts"))
    first = F.col("parts")[0]["text"]
    rest = F.transform(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(1))), lambda p: p["text"])
    split = staged(whole, first=first, more=F.when(F.size("parts") > 1, F.array_join(rest, "\n")),
                   ts=F.unix_millis(extract(first, HEADER, 1).try_cast("timestamp")),
                   level=F.lower(extract(first, HEADER, 2)), head=strip(extract(first, HEADER, 3)))
    rejects = split.filter(F.col("ts").isNull()).select(
        "file", "line", F.lit("Failed to parse log record").alias("error"), F.col("first").alias("raw"))
    bracket = r"^\[([^\]]*)\]([\s\S]*)$"
    named = F.col("head").rlike(bracket)
    split = staged(split.filter(F.col("ts").isNotNull()),
                   component=F.when(named, F.regexp_extract("head", bracket, 1)),
                   said=F.concat_ws("\n", F.when(named, strip(F.regexp_extract("head", bracket, 2))).otherwise(F.col("head")),
                                    F.col("more")))
    has_payload = F.col("said").rlike(PAYLOAD)
    split = staged(split,
                   message=F.when(has_payload, strip(F.regexp_extract("said", PAYLOAD, 1))).otherwise(F.col("said")),
                   payload=F.when(has_payload, strip(F.regexp_extract("said", PAYLOAD, 2))))
    return split.select("file", "line", "ts", "level", "component", "message", "payload"), rejects


def safe_records(records: DataFrame, now_ms: int, home: str | None = None) -> DataFrame:
    """Records that may be stored, redacted, as rows of the desktop log table.

    ``said`` keeps the text before redaction for the extraction of events.
    """
    kept = records.filter(F.coalesce(may_store(F.col("level"), F.col("component"), F.col("message")), F.lit(False)))
    number = lambda group: extract(F.col("file"), FILE_NAME, group).cast("bigint")
    kept = staged(kept.withColumnRenamed("message", "said"),
                  message=redact(F.col("said"), home), payload_text=redact(F.col("payload"), home))
    key = dedup_key(F.col("file"), F.col("line"), {
        "ts": F.col("ts"), "level": F.col("level"), "component": F.col("component"), "message": F.col("message"),
        "payload": F.col("payload_text")})
    kept = staged(kept, dedup_key=key)
    return kept.select(
        F.col("dedup_key").alias("id"), extract(F.col("file"), FILE_NAME, 1).alias("app_session_id"), "ts", "level",
        "component", "message", "payload_text", number(2).alias("process_id"), number(3).alias("thread_id"),
        number(4).alias("instance_id"), number(5).alias("segment_index"), F.col("file").alias("file_path"),
        F.col("line").alias("line_number"), "dedup_key", F.lit(now_ms).cast("bigint").alias("created_at"), "said")


def _by_words(words: dict[str, str], lowered: Column, fallback: str) -> Column:
    chain = None
    for action, pattern in words.items():
        test = lowered.rlike(pattern)
        chain = F.when(test, action) if chain is None else chain.when(test, action)
    return chain.when(F.col("level").isin(*ALERT_LEVELS), fallback)


def _about(topic: str, component_topic: str) -> Column:
    return F.lower("said").contains(topic) | F.coalesce(F.lower("component").contains(component_topic), F.lit(False))


def first_path(text: Column) -> Column:
    """A path named in a text, quoted ones first."""
    return F.coalesce(*[extract(text, p) for p in PATHS])


def _event_rows(events: DataFrame, failed: str, home: str | None, hashed: dict[str, Column], *columns) -> DataFrame:
    events = staged(events, key=dedup_key(F.col("id"), F.lit(0), hashed))
    bad = F.col("action") == failed
    return events.select(
        F.col("key").alias("id"), "ts", "action", *columns, F.when(bad, "failed").otherwise("ok").alias("status"),
        F.when(bad, redact(F.col("said"), home)).alias("error"), "app_session_id", F.col("id").alias("source_log_id"),
        F.col("key").alias("dedup_key"))


def worktree_events(safe: DataFrame, home: str | None = None) -> DataFrame:
    """Worktrees created, archived or in error, from stored records."""
    found = staged(safe.filter(_about("worktree", "git")), lowered=F.lower("said"), path=first_path(F.col("said")),
                   branch=extract(F.col("said"), BRANCH))
    managed = F.lit(False)
    for folder in WORKTREE_FOLDERS:
        managed = managed | F.lower("path").contains(folder)
    watched = F.coalesce(F.col("lowered").rlike(WATCHER_STARTED) & managed, F.lit(False))
    action = F.when(watched, "created").otherwise(_by_words(WORKTREE_WORDS, F.col("lowered"), "error"))
    found = staged(found, action=action).filter(F.col("action").isNotNull())
    hashed = {"ts": F.col("ts"), "action": F.col("action"), "pathValue": F.col("path"), "branch": F.col("branch")}
    shown = redact(F.col("path"), home)
    return _event_rows(found, "error", home, hashed, shown.alias("worktree_path"), shown.alias("repo_root"), "branch")


def automation_events(safe: DataFrame, home: str | None = None) -> DataFrame:
    """Automation runs queued, completed or failed, from stored records."""
    found = staged(safe.filter(_about("automation", "automation")), lowered=F.lower("said"),
                   thread=F.coalesce(extract(F.col("said"), THREAD), F.col("thread_id").cast("string")))
    found = staged(found, action=_by_words(AUTOMATION_WORDS, F.col("lowered"), "failed")).filter(
        F.col("action").isNotNull())
    hashed = {"ts": F.col("ts"), "action": F.col("action"), "threadId": F.col("thread")}
    return _event_rows(found, "failed", home, hashed, F.col("thread").alias("thread_id"))


def archived_events(worktree_event: DataFrame, inventory: DataFrame, now_ms: int) -> DataFrame:
    """Archive events for worktrees last seen alive which the inventory (``path``) lacks."""
    last = latest_per_key(worktree_event.filter(F.coalesce(F.col("worktree_path"), F.lit("")) != ""),
                          ["worktree_path"], "ts", "id")
    gone = last.filter(~F.lower("action").isin("archived", "deleted")).join(
        inventory.select(F.col("path").alias("worktree_path")), "worktree_path", "left_anti")
    now = F.lit(now_ms).cast("bigint")
    key = dedup_key(F.lit("worktree_archive"), F.lit(0), {
        "path": F.col("worktree_path"), "action": F.lit("archived"), "lastSeenTs": F.col("ts"), "archivedAt": now})
    none = F.lit(None).cast("string")
    return gone.select(key.alias("id"), now.alias("ts"), F.lit("archived").alias("action"), "worktree_path",
                       F.col("worktree_path").alias("repo_root"), none.alias("branch"), F.lit("ok").alias("status"),
                       none.alias("error"), none.alias("app_session_id"), none.alias("source_log_id"),
                       key.alias("dedup_key"))
