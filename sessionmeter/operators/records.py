"""Typed records from parsed session lines.

Input has ``file, line, doc, mtime_ms``. :func:`read_records` types every line and adds what
the lines before it established; the four extractors are filtered projections of its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dedup_key
from ..functions.staging import staged
from ..functions.variants import (field, first_container, first_present, instant_of, let, members, number_of, raw_text,
                                  text_of)
from ..runtime import checkpointed
from .ordered import carry_forward

TIME_KEYS = ("ts", "timestamp", "time", "created_at", "createdAt")
SESSION_KEYS = ("session_id", "sessionId", "session.id", "session.session_id", "id")
TYPE_KEYS = ("type", "kind", "event_type", "eventType")
ROLES = ("user", "assistant", "system")

# Key synonyms of the token counts.
TOKEN_KEYS = {
    "input_tokens": ("input_tokens", "input", "prompt_tokens"),
    "cached_input_tokens": ("cached_input_tokens", "cached_input", "cache_read_tokens", "cached_prompt_tokens"),
    "output_tokens": ("output_tokens", "output", "completion_tokens"),
    "reasoning_tokens": ("reasoning_tokens", "reasoning"),
    "total_tokens": ("total_tokens", "total", "tokens"),
}


# Key synonyms of a session line's fields.
META_KEYS = {
    "cwd": ("cwd", "working_dir", "workingDirectory", "project", "repo"),
    "originator": ("originator", "user", "actor", "owner"),
    "cli_version": ("cli_version", "cliVersion", "version", "client_version", "clientVersion"),
    "model_provider": ("model_provider", "modelProvider", "provider"),
    "git_branch": ("git_branch", "gitBranch", "git.branch"),
    "git_commit": ("git_commit", "gitCommit", "git.commit", "git.sha"),
}
META = ("ts", *META_KEYS)
PARTS = {"session_meta": ("session_meta", "meta", "session", "payload"), "turn_context": ("context", "turn_context", "payload"),
         "response_item": ("item",), "event_msg": ("payload", "event.payload", "message.payload")}
_COUNTS = tuple(key for keys in TOKEN_KEYS.values() for key in keys)
#: Keys that are read of a line and of the object holding its fields.
_SHARED = (*TYPE_KEYS, *SESSION_KEYS, *TIME_KEYS, *_COUNTS, "model", "model_name", "model_provider", "role", "content", "message",
           "message_id", "duration_ms")
_heads = lambda *paths: tuple(dict.fromkeys(p.partition(".")[0] for p in paths))
TOP = _heads(*_SHARED, *[path for paths in PARTS.values() for path in paths])
BODY = _heads(*_SHARED, *[path for paths in META_KEYS.values() for path in paths], "modelId", "info", "usage")


def _read(of: str, *paths: str) -> list[Column]:
    """Values by path; the first keys are members of a struct."""
    def one(path):
        head, _, rest = path.partition(".")
        return field(F.col(of)[head], rest) if rest else F.col(of)[head]
    return [one(p) for p in paths]


def routed(good: DataFrame) -> DataFrame:
    """Add ``kind``, the extractor a line belongs to, and the members of ``top``, the line, and ``body``, the object
    holding its fields.

    ``part`` is the nested object, null where the fields stand in the line itself. Steps are plain projections, which
    are compiled; the optimizer keeps them apart, since each result is named more than once.
    """
    chain, part = F.lit(None).cast("string"), F.lit(None).cast("variant")
    for name in reversed(tuple(PARTS)):
        chain = F.when(F.col("type").contains(name), F.lit(name)).otherwise(chain)
        part = F.when(F.col("kind") == name, first_container(*_read("top", *PARTS[name]))).otherwise(part)
    lines = good.withColumn("top", members(F.col("doc"), *TOP))
    lines = lines.withColumn("type", F.lower(F.coalesce(*[text_of(v) for v in _read("top", *TYPE_KEYS)])))
    lines = lines.withColumn("kind", chain).drop("type").withColumn("part", part)
    return lines.withColumn("body", members(F.coalesce("part", "doc"), *BODY)).drop("doc")


def typed_lines(good: DataFrame, keep_content: bool = False) -> DataFrame:
    """Everything the JSON of a line says, as typed columns; the document itself is dropped.

    ``meta``, ``turn``, ``message`` and ``call`` are structs, each filled for its kind of line. Values are picked
    in one step and converted in the next, so that each is looked up once.
    """
    kind, kept = F.col("kind"), ["file", "line", "mtime_ms", "kind", *(["is_new"] if "is_new" in good.columns else [])]
    told = F.lower(F.coalesce(*[text_of(v) for v in _read("body", "type", "event_type", "kind")])).contains("token_count")
    lines = routed(good).withColumn("told", F.when((kind == "event_msg") & F.col("part").isNotNull(), told))
    counted = lambda value, path="$": F.when(F.col("told"), members(value, *_COUNTS, path=path))
    lines = lines.withColumns({
        "last": counted(F.col("body")["info"], "$.last_token_usage"), "total": counted(F.col("body")["info"], "$.total_token_usage"),
        "usage": counted(F.col("body")["usage"])})
    picked = lines.select(
        *kept, first_present(*_read("body", *SESSION_KEYS)).alias("own"), first_present(*_read("top", *SESSION_KEYS)).alias("outer"),
        first_present(*_read("body", *TIME_KEYS)).alias("time"), first_present(*_read("top", *TIME_KEYS)).alias("outer_time"),
        F.when(kind == "session_meta", _meta_values()).alias("meta"), F.when(kind == "turn_context", _turn_values()).alias("turn"),
        F.when(kind == "response_item", _message_values()).alias("message"), F.when(F.col("told"), _call_values()).alias("call"))
    ts = F.coalesce(instant_of(F.col("time")), instant_of(F.col("outer_time")), F.col("mtime_ms")).alias("ts")
    filled = lambda name, *values: F.when(F.col(name).isNotNull(), F.struct(*values)).alias(name)
    content = message_text(F.col("message")["content"]) if keep_content else F.lit(None).cast("string")
    counts = [F.coalesce(number_of(F.col("call")[n]), F.lit(0)).cast("bigint").alias(n) for n in TOKEN_KEYS]
    return picked.select(
        "file", "line", "mtime_ms", "kind", F.coalesce(text_of(F.col("own")), text_of(F.col("outer"))).alias("own_session"),
        filled("meta", ts, *_texts("meta", *META_KEYS)), filled("turn", *_texts("turn", "model", "model_provider")),
        filled("message", F.lower(text_of(F.col("message")["role"])).alias("role"), ts, *_texts("message", "native_id"),
               content.alias("content")),
        filled("call", ts, *_texts("call", "model"), number_of(F.col("call")["took"]).cast("bigint").alias("took"),
               *_texts("call", "native_id"), *counts), *kept[4:])


def _texts(of: str, *names: str) -> list[Column]:
    return [text_of(F.col(of)[n]).alias(n) for n in names]


def _sets_session() -> Column:
    return (F.when(F.col("kind") == "session_meta", F.coalesce("own_session", "meta_key"))
            .when(F.col("kind") == "turn_context", F.col("own_session")))


def _context_key() -> Column:
    return F.when(F.col("kind") == "turn_context", F.coalesce("own_session", "running_session")).otherwise(F.col("running_session"))


def with_context(typed: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Add the session in force before a line and that session's model.

    ``earlier`` is what :func:`context_left` said of the lines before those given: ``file, line, session_id,
    value``, a session in force (null session_id) or a session's model.

    Session and context lines set the session for the lines after them. A context line sets
    the model of the session it names, or of the session in force. Give a materialised frame:
    it is read once for the lines and again for the few columns that decide the context.
    """
    kind = F.col("kind")
    lines = typed.withColumn("meta_key", F.when(kind == "session_meta", dedup_key(F.col("file"), F.col("line"), {
        "sessionId": F.col("own_session"), **{n: F.col("meta")[n] for n in META}})))
    narrow = staged(lines.filter(kind.isNotNull()), sets_session=_sets_session(), sets_model=F.col("turn.model")).select(
        "file", "line", "kind", "own_session", "sets_session", "sets_model")
    if earlier is not None:
        narrow = narrow.unionByName(earlier.filter("session_id is null").select(
            "file", "line", F.col("value").alias("sets_session")), allowMissingColumns=True)
    narrow = carry_forward(narrow, ["file"], "line", "sets_session", "running_session").withColumn("context_key", _context_key())
    if earlier is not None:
        narrow = narrow.unionByName(earlier.filter("session_id is not null").select(
            "file", "line", F.col("session_id").alias("context_key"), F.col("value").alias("sets_model")), allowMissingColumns=True)
    narrow = carry_forward(narrow, ["file", "context_key"], "line", "sets_model", "running_model").filter("kind is not null")
    return lines.join(narrow.select("file", "line", "running_session", "running_model"), ["file", "line"]).withColumn(
        "session_id", F.coalesce("own_session", "running_session"))


def context_left(context: DataFrame) -> DataFrame:
    """What the lines given leave in force behind them: ``file, line, session_id, value``.

    One row per file with the last session (session_id null), one per file and session with its last model;
    ``line`` is the line that said so.
    """
    said = context.select("file", "line", _sets_session().alias("session"), _context_key().alias("of"), F.col("turn.model").alias("model"))
    each = said.select("file", "line", F.inline(F.array(
        F.struct(F.lit(None).cast("string").alias("session_id"), F.col("session").alias("value")),
        F.struct(F.col("of").alias("session_id"), F.when(F.col("of").isNotNull(), F.col("model")).alias("value"))))).filter("value is not null")
    return each.groupBy("file", "session_id").agg(F.max("line").alias("line"), F.max_by("value", "line").alias("value"))


def _meta_values() -> Column:
    return F.struct(*[first_present(*_read("body", *paths)).alias(n) for n, paths in META_KEYS.items()])


def _turn_values() -> Column:
    model = first_present(*_read("body", "model", "model_name", "modelId"), *_read("top", "model"))
    provider = first_present(*_read("body", "model_provider", "modelProvider", "provider", "model.provider"),
                             *_read("top", "model_provider"))
    return F.struct(model.alias("model"), provider.alias("model_provider"))


def message_text(content: Column) -> Column:
    """Text of a message: a string, the texts of a list joined by blanks, or an object's text."""
    held = lambda v: F.coalesce(raw_text(field(v, "text")), raw_text(field(v, "text.value")))
    entry = lambda v: F.coalesce(raw_text(v), held(v), raw_text(field(v, "content")))
    parts = lambda c: F.filter(F.transform(F.try_variant_get(c, "$", "array<variant>"), entry), lambda p: p.isNotNull())
    joined = lambda c: let(parts(c), lambda p: F.when(F.size(p) > 0, F.array_join(p, " ")))
    return let(content, lambda c: F.coalesce(raw_text(c), joined(c), held(c)))


def _message_values() -> Column:
    role = first_present(*_read("body", "role"), *_read("top", "role", "payload.role"))
    said = first_present(*_read("body", "content"), *_read("top", "content", "payload.content"),
                         *_read("body", "message.content"), *_read("top", "message.content"))
    native = first_present(*_read("body", "message_id", "id"), *_read("top", "message_id"))
    return F.struct(role.alias("role"), native.alias("native_id"), said.alias("content"))


def _call_values() -> Column:
    """Values of a token-count message.

    The first source which has one of a count's keys decides it, even if the value is unusable.
    """
    either = lambda key: first_present(*_read("body", key), *_read("top", key))
    counts = {name: F.coalesce(*[F.col(source)[key] for source in ("last", "total", "usage", "body", "top") for key in keys])
              for name, keys in TOKEN_KEYS.items()}
    return F.struct(first_present(*_read("body", "model"), *_read("top", "model", "model_name")).alias("model"),
                    either("duration_ms").alias("took"), either("id").alias("native_id"),
                    *[c.alias(n) for n, c in counts.items()])


def _sourced(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns, F.col("file").alias("source_file"), F.col("line").alias("source_line"), "dedup_key")


def _keyed(rows: DataFrame, **hashed: Column) -> DataFrame:
    return rows.withColumn("dedup_key", dedup_key(F.col("file"), F.col("line"), hashed))


def _record_id() -> Column:
    """The native id, unless it only repeats the session's."""
    return F.when(F.col("native_id") != F.col("session_id"), F.col("native_id")).otherwise(F.col("dedup_key"))


def sessions(context: DataFrame) -> DataFrame:
    rows = context.filter(F.col("kind") == "session_meta").select(
        "file", "line", "own_session", "meta.*", F.col("meta_key").alias("dedup_key"))
    return _sourced(rows, F.coalesce("own_session", "dedup_key").alias("id"), *META)


def contexts(context: DataFrame) -> DataFrame:
    """Model and provider a turn runs with; its time is that of the file."""
    rows = context.filter((F.col("kind") == "turn_context") & F.col("session_id").isNotNull()).select(
        "file", "line", "session_id", F.col("mtime_ms").alias("ts"), "turn.*")
    rows = _keyed(rows, sessionId=F.col("session_id"), ts=F.col("ts"), model=F.col("model"),
                  modelProvider=F.col("model_provider"))
    return _sourced(rows, F.col("dedup_key").alias("id"), "session_id", "ts", "model", "model_provider")


def messages(context: DataFrame) -> DataFrame:
    """Messages of users, assistants and the system."""
    rows = context.filter(F.col("message.role").isin(*ROLES) & F.col("session_id").isNotNull()).select(
        "file", "line", "session_id", "message.*")
    rows = _keyed(rows, sessionId=F.col("session_id"), role=F.col("role"), ts=F.col("ts"))
    return _sourced(rows, _record_id().alias("id"), "session_id", "role", "ts", "content")


def model_calls(context: DataFrame) -> DataFrame:
    """Model calls; without a model of its own a call has that of the session in force."""
    rows = context.filter(F.col("call").isNotNull() & F.col("session_id").isNotNull()).select(
        "file", "line", "session_id", "running_model", "call.*")
    parts = F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens")
    total = F.when((F.col("total_tokens") == 0) & (parts > 0), parts).otherwise(F.col("total_tokens"))
    rows = rows.withColumn("total_tokens", total).withColumn("model", F.coalesce("model", "running_model"))
    rows = _keyed(rows, sessionId=F.col("session_id"), ts=F.col("ts"), model=F.col("model"),
                  **{n: F.col(n) for n in TOKEN_KEYS})
    return _sourced(rows, _record_id().alias("id"), "session_id", "ts", "model", *TOKEN_KEYS,
                    F.when(F.col("took") > 0, F.col("took")).alias("duration_ms"))


def read_records(good: DataFrame, keep_content: bool = False) -> DataFrame:
    """Typed lines with context. The typed lines are materialised, so the JSON is read once."""
    return with_context(checkpointed(typed_lines(good, keep_content)))
