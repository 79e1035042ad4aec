"""Declared schemas of the stored tables. Times are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_DDL = {
    "ingest_state": "path string not null, byte_offset bigint not null, line_count bigint, mtime_ms bigint, updated_at bigint not null, begun_at bigint, seen_size bigint",
    "carried_context": "path string not null, session_id string, value string not null, line bigint not null, begun_at bigint not null",
    "project": "id string not null, name string not null, root_path string, git_remote string, first_seen_ts bigint, last_seen_ts bigint",
    "project_ref": "id string not null, project_id string not null, branch string, commit string, cwd string, first_seen_ts bigint, last_seen_ts bigint",
    "session": "id string not null, ts bigint not null, cwd string, originator string, cli_version string, model_provider string, git_branch string, git_commit string, project_id string, project_ref_id string, source_file string not null, source_line bigint not null, dedup_key string not null",
    "message": "id string not null, session_id string not null, role string not null, ts bigint not null, content string, source_file string not null, source_line bigint not null, dedup_key string not null",
    "model_call": "id string not null, session_id string not null, ts bigint not null, model string, input_tokens bigint not null, cached_input_tokens bigint not null, output_tokens bigint not null, reasoning_tokens bigint not null, total_tokens bigint not null, duration_ms bigint, source_file string not null, source_line bigint not null, dedup_key string not null",
    "tool_call": "id string not null, session_id string, tool_name string not null, command string, status string not null, start_ts bigint not null, end_ts bigint, duration_ms bigint, exit_code bigint, error string, stdout_bytes bigint, stderr_bytes bigint, source_file string not null, source_line bigint not null, correlation_key string not null, dedup_key string not null",
    "tool_call_event": "id string not null, session_id string, tool_name string not null, event_type string not null, ts bigint not null, payload string, exit_code bigint, source_file string not null, source_line bigint not null, correlation_key string not null, dedup_key string not null",
    "session_context": "id string not null, session_id string not null, ts bigint not null, model string, model_provider string, source_file string not null, source_line bigint not null, dedup_key string not null",
    "desktop_log_event": "id string not null, app_session_id string, ts bigint not null, level string, component string, message string, payload_text string, process_id bigint, thread_id bigint, instance_id bigint, segment_index bigint, file_path string not null, line_number bigint not null, dedup_key string not null, created_at bigint not null",
    "worktree_event": "id string not null, ts bigint not null, action string not null, worktree_path string, repo_root string, branch string, status string, error string, app_session_id string, source_log_id string, dedup_key string not null",
    "automation_event": "id string not null, ts bigint not null, action string not null, thread_id string, status string, error string, app_session_id string, source_log_id string, dedup_key string not null",
    "daily_activity": "date string not null, message_count bigint not null, call_count bigint not null, token_total bigint not null",
    "worktree_daily": "date string not null, created_count bigint not null, deleted_count bigint not null, error_count bigint not null, active_count bigint not null",
    "automation_daily": "date string not null, runs_queued bigint not null, runs_completed bigint not null, runs_failed bigint not null, backlog_peak bigint not null",
    "reject": "file string not null, line bigint not null, error string not null, raw string",
}

_TYPES = {"string": StringType(), "bigint": LongType()}


def _struct(ddl: str) -> StructType:
    """Read the declarations above; Spark's own reader needs a running session."""
    columns = [column.split() for column in ddl.split(", ")]
    return StructType([StructField(c[0], _TYPES[c[1]], nullable=len(c) == 2) for c in columns])


SCHEMAS: dict[str, StructType] = {name: _struct(ddl) for name, ddl in _DDL.items()}

# Rows that go when their parent goes, and rows that only lose the reference.
CASCADE = {
    "session": {"message": "session_id", "model_call": "session_id", "session_context": "session_id"},
    "project": {"project_ref": "project_id"},
    "project_ref": {},
}
SET_NULL = {
    "session": {"tool_call": "session_id", "tool_call_event": "session_id"},
    "project": {"session": "project_id"},
    "project_ref": {"session": "project_ref_id"},
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A typed empty table, used where a table has not been written yet."""
    return spark.createDataFrame([], SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project a frame onto a table's columns; columns it lacks become null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SCHEMAS[table].fields
    ])
