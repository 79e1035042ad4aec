"""Queries over logs: lines are made from the sample tables in memory and extracted as records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import git, text as tx
from ..functions.staging import staged
from ..operators import correlation, desktoplog, merging, records
from ..operators.toollog import tool_log_events, tool_log_records
from ..sources.jsonl import parse_jsonl
from . import views as v
from .reports import query

_json = lambda **parts: F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))
_cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
_struct = lambda **parts: F.struct(*[c.alias(n) for n, c in parts.items()])


# ---------------------------------------------------------------- session files

def session_log(spark, d) -> DataFrame:
    """A session line per order, then per line item a context line (for some) and an event line.

    Lines use all the key spellings; quantity 13 gives a broken line and 17 a blank one.
    """
    key = F.col("o_orderkey")
    orders = v.session(spark, d).withColumn("o_orderkey", F.col("id").cast("bigint"))
    iso = F.concat(F.translate(F.substring((F.timestamp_add("SECOND", (F.col("ts") / 1000).cast("int"),
                   F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))).cast("string"), 1, 19), " ", "T"), F.lit("Z"))
    kind = lambda name: F.lit(name)
    meta = (F.when(key % 4 == 0, _json(type=kind("session_meta"), id=F.col("id"), ts=F.col("ts"), cwd=F.col("cwd"),
                                       originator=F.col("originator"), cli_version=F.col("cli_version"),
                                       model_provider=F.col("model_provider"),
                                       git=_struct(branch=F.col("git_branch"), commit=F.col("git_commit"))))
            .when(key % 4 == 1, _json(kind=kind("SESSION_META"), payload=_struct(
                session_id=key, timestamp=iso, working_dir=F.col("cwd"), user=F.col("originator"),
                version=F.col("cli_version"), provider=F.col("model_provider"), git_branch=F.col("git_branch"),
                gitCommit=F.col("git_commit"))))
            .when(key % 4 == 2, _json(event_type=kind("x_session_meta_v2"), session=_struct(id=F.col("id")), meta=_struct(
                time=F.col("ts").cast("string"), workingDirectory=F.col("cwd"), actor=F.col("originator"),
                clientVersion=F.col("cli_version"), modelProvider=F.col("model_provider"),
                git=_struct(branch=F.col("git_branch"), sha=F.col("git_commit")))))
            .otherwise(_json(type=kind("session_meta"), created_at=F.col("ts"), repo=F.col("cwd"),
                             owner=F.col("originator"), client_version=F.col("cli_version"),
                             provider=F.col("model_provider"))))
    place = lambda k: (F.concat(F.lit("log-"), (k % 500).cast("string")), F.floor(k / 500) * 128)
    file, base = place(key)
    # Lines are staged: a filter on them would else repeat all of their JSON, in methods too long to be compiled.
    heads = staged(orders, value=meta).select(file.alias("file"), base.alias("line"), "value")

    calls = v.table(spark, d, "lineitem")
    from pyspark.sql import Window
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    calls = calls.withColumn("rn", F.row_number().over(order))
    n = lambda c: F.round(c).cast("bigint")
    i, c, o, r = (n(F.col("l_quantity") * 100), n(F.col("l_quantity") * 100 * F.col("l_discount")),
                  n(F.col("l_quantity") * 10), n(F.col("l_tax") * 100))
    stamp = v.millis_of(F.col("l_shipdate")) + F.col("rn") * 1000
    four, count = F.col("l_linenumber") % 4, F.lit("token_count")
    event = (F.when(F.col("l_quantity") == 13, F.lit('{"type":"event_msg","payload":'))
             .when(F.col("l_quantity") == 17, F.lit("  \t"))
             .when(four == 0, _json(type=kind("event_msg"), ts=stamp, payload=_struct(
                 type=count, input_tokens=i, cached_input_tokens=c, output_tokens=o, reasoning_tokens=r,
                 duration_ms=F.lit(0))))
             .when(four == 1, _json(type=kind("event_msg"), payload=_struct(
                 type=count, timestamp=stamp, info=_struct(last_token_usage=_struct(input=i, cached_input=c, output=o,
                 reasoning=r, total=F.lit(5)), total_token_usage=_struct(input=i + 1)), duration_ms=F.col("l_quantity"))))
             .when(four == 2, _json(type=kind("event_msg"), message=_struct(payload=_struct(
                 kind=count, createdAt=stamp.cast("string"), usage=_struct(prompt_tokens=i.cast("string"), cache_read_tokens=c,
                 completion_tokens=o), reasoning_tokens=r, tokens=F.lit(0)))))
             .otherwise(_json(type=kind("event_msg"), payload=_struct(type=count, ts=stamp, model=F.lit("own-model"),
                 info=_struct(total_token_usage=_struct(input_tokens=i, cached_prompt_tokens=c, output_tokens=o,
                 reasoning_tokens=r)), id=_cat("call-", F.col("l_orderkey"), "-", F.col("rn"))))))
    file, base = place(F.col("l_orderkey"))
    events = staged(calls, value=event).select(file.alias("file"), (base + F.col("rn") * 2).alias("line"), "value")
    context = _json(type=kind("turn_context"), turn_context=_struct(model_name=F.col("l_returnflag"), provider=F.lit("acme")))
    contexts = calls.filter("l_returnflag <> 'N'").select(file.alias("file"), (base + F.col("rn") * 2 - 1).alias("line"),
                                                          context.alias("value"))
    return heads.unionByName(events).unionByName(contexts).withColumn("mtime_ms", F.lit(v.BASE_MS))


def _context(spark, d) -> DataFrame:
    return records.read_records(parse_jsonl(session_log(spark, d))[0])


_LOG = {
    "heads": """SELECT *, CAST(id AS BIGINT) AS k, 'log-' || (CAST(id AS BIGINT) % 500) AS source_file,
        CAST(id AS BIGINT) // 500 * 128 AS source_line, CASE WHEN CAST(id AS BIGINT) % 4 <> 3 THEN id END AS sid,
        CASE WHEN CAST(id AS BIGINT) % 4 <> 3 THEN git_branch END AS gb, CASE WHEN CAST(id AS BIGINT) % 4 <> 3 THEN git_commit END AS gc FROM v_session""",
    "keyed": """SELECT *, substr(sha256(source_file || ':' || source_line || ':' || substr(sha256('{"cli_version":"' || cli_version || '","cwd":"' || cwd
        || '","git_branch":' || coalesce('"' || gb || '"', 'null') || ',"git_commit":' || coalesce('"' || gc || '"', 'null')
        || ',"model_provider":' || coalesce('"' || model_provider || '"', 'null') || ',"originator":"' || originator
        || '","sessionId":' || coalesce('"' || sid || '"', 'null') || ',"ts":' || ts || '}'), 1, 24)), 1, 24) AS dedup_key FROM heads""",
    "named": "SELECT *, coalesce(sid, dedup_key) AS session_id FROM keyed",
    "items": """SELECT *, 'log-' || (l_orderkey % 500) AS source_file, l_orderkey // 500 * 128 + rn * 2 AS source_line FROM
        (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)""",
    "calls": """SELECT n.session_id, i.source_file, i.source_line, epoch_us(l_shipdate) // 1000 + rn * 1000 AS ts,
        CASE WHEN l_linenumber % 4 = 3 THEN 'own-model' ELSE last_value(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END IGNORE NULLS)
            OVER (PARTITION BY l_orderkey ORDER BY rn) END AS model,
        CAST(round(l_quantity * 100) AS BIGINT) AS input_tokens, CAST(round(l_quantity * 100 * l_discount) AS BIGINT) AS cached_input_tokens,
        CAST(round(l_quantity * 10) AS BIGINT) AS output_tokens, CAST(round(l_tax * 100) AS BIGINT) AS reasoning_tokens,
        CASE WHEN l_linenumber % 4 = 1 THEN 5 ELSE CAST(round(l_quantity * 100) AS BIGINT) + CAST(round(l_quantity * 10) AS BIGINT)
            + CAST(round(l_tax * 100) AS BIGINT) END AS total_tokens,
        CASE WHEN l_linenumber % 4 = 1 THEN CAST(l_quantity AS BIGINT) END AS duration_ms, l_quantity, l_linenumber, l_orderkey, rn
        FROM items i JOIN named n ON n.k = i.l_orderkey""",
}


@query("jsonl_sessions", """SELECT session_id AS id, ts, cwd, originator, cli_version, model_provider, gb AS git_branch, gc AS git_commit,
    source_file, source_line, dedup_key FROM named""", _LOG)
def _(spark, d):
    return records.sessions(_context(spark, d))


# A payload's own id is read as session id where no other key names one.
@query("jsonl_model_calls", """SELECT CASE WHEN l_linenumber % 4 = 3 THEN 'call-' || l_orderkey || '-' || rn ELSE session_id END AS session_id,
    source_file, source_line, ts, model, input_tokens, cached_input_tokens, output_tokens, reasoning_tokens, total_tokens, duration_ms
    FROM calls WHERE l_quantity NOT IN (13, 17)""", _LOG)
def _(spark, d):
    return records.model_calls(_context(spark, d)).drop("id", "dedup_key")


@query("jsonl_contexts", """SELECT n.session_id, i.source_file, i.source_line - 1 AS source_line, 865123200000 AS ts, l_returnflag AS model,
    'acme' AS model_provider, substr(sha256(i.source_file || ':' || (i.source_line - 1) || ':' || substr(sha256('{"model":"' || l_returnflag
    || '","modelProvider":"acme","sessionId":"' || n.session_id || '","ts":865123200000}'), 1, 24)), 1, 24) AS dedup_key
    FROM items i JOIN named n ON n.k = i.l_orderkey WHERE l_returnflag <> 'N'""", _LOG)
def _(spark, d):
    return records.contexts(_context(spark, d)).drop("id")


@query("jsonl_rejects", """SELECT source_file AS file, source_line AS line, '{"type":"event_msg","payload":' AS raw FROM items WHERE l_quantity = 13""", _LOG)
def _(spark, d):
    return parse_jsonl(session_log(spark, d))[1].select("file", "line", "raw")


def chat_log(spark, d) -> DataFrame:
    """Conversations as message lines, the content in the shapes the format knows."""
    key, turn, said = F.col("conv_id"), F.col("turn"), F.col("text")
    item = lambda content: _json(type=F.lit("response_item"), session_id=key, item=_struct(
        role=F.upper("role"), content=content, timestamp=F.lit(v.BASE_MS) + turn))
    value = (F.when(turn % 4 == 0, item(said))
             .when(turn % 4 == 1, item(F.array(_struct(text=said), _struct(text=F.lit("end")))))
             .when(turn % 4 == 2, item(_struct(text=_struct(value=said))))
             .otherwise(_json(type=F.lit("response_item"), sessionId=key, payload=_struct(role=F.col("role")),
                              time=F.lit(v.BASE_MS) + turn, message=_struct(content=F.array(_struct(content=said))))))
    return v.table(spark, d, "conversations").select(
        _cat("chat-", key % 50).alias("file"), (F.floor(key / 50) * 64 + turn).alias("line"), value.alias("value"),
        F.lit(v.BASE_MS).alias("mtime_ms"))


@query("jsonl_messages", """SELECT CAST(conv_id AS VARCHAR) AS session_id, role, 865123200000 + turn AS ts,
    CASE WHEN turn % 4 = 1 THEN text || ' end' ELSE text END AS content, 'chat-' || (conv_id % 50) AS source_file, conv_id // 50 * 64 + turn AS source_line,
    substr(sha256('chat-' || (conv_id % 50) || ':' || (conv_id // 50 * 64 + turn) || ':' || substr(sha256('{"role":"' || role || '","sessionId":"' || conv_id
    || '","ts":' || (865123200000 + turn) || '}'), 1, 24)), 1, 24) AS dedup_key FROM conversations""")
def _(spark, d):
    return records.messages(records.read_records(parse_jsonl(chat_log(spark, d))[0], keep_content=True)).drop("id")


# ---------------------------------------------------------------- projects

def _remotes(spark, d) -> DataFrame:
    folders = v.session(spark, d).select("cwd").distinct()
    key = F.regexp_extract("cwd", "u([0-9]+)", 1).cast("bigint")
    return folders.filter(key % 3 == 0).select("cwd", git.normalize_git_url(
        _cat("git@Git.Example.com:Org", key % 7, "/Repo", key % 50, ".git")).alias("git_remote"))


def _moved(spark, d) -> DataFrame:
    """Sessions of which some lie in workspace folders."""
    key = F.regexp_extract("cwd", "u([0-9]+)", 1).cast("bigint")
    return v.session(spark, d).withColumn("cwd", F.when(key % 3 == 1, F.concat(
        _cat("/x/conductor/workspaces/space", key % 9), F.lit("/w"), key.cast("string"))).otherwise(F.col("cwd")))


_DERIVED = {
    "u": "SELECT *, CAST(regexp_extract(cwd, 'u([0-9]+)', 1) AS BIGINT) AS n FROM v_session",
    "p": """SELECT id, git_branch, CASE WHEN n % 3 = 1 THEN '/x/conductor/workspaces/space' || (n % 9) || '/w' || n ELSE cwd END AS cwd,
        CASE WHEN n % 3 = 0 THEN 'https://git.example.com/org' || (n % 7) || '/repo' || (n % 50) END AS git_remote,
        CASE n % 3 WHEN 0 THEN 'repo' || (n % 50) WHEN 1 THEN 'space' || (n % 9) ELSE regexp_extract(cwd, '([^/]+)$', 1) END AS project_name, n FROM u""",
    "q": """SELECT *, substr(sha256(CASE n % 3 WHEN 0 THEN '{"git_remote":"' || git_remote || '"}' WHEN 1 THEN '{"conductor_project":"' || project_name || '"}'
        ELSE '{"name":"' || project_name || '","root_path":"' || cwd || '"}' END), 1, 16) AS project_id FROM p""",
}


@query("session_projects", """SELECT id, cwd, git_remote, project_name, project_id, substr(sha256('{"branch":"' || git_branch || '","cwd":"' || cwd
    || '","project_id":"' || project_id || '"}'), 1, 16) AS project_ref_id FROM q""", _DERIVED)
def _(spark, d):
    return merging.with_project(_moved(spark, d), _remotes(spark, d)).select(
        "id", "cwd", "git_remote", "project_name", "project_id", "project_ref_id")


@query("backfilled_projects", """SELECT s.id, s.project_id IS NULL AS changed, coalesce(s.project_id, q.project_id) AS project_id
    FROM v_session s JOIN q USING (id)""", _DERIVED)
def _(spark, d):
    return merging.backfill_projects(_moved(spark, d), _remotes(spark, d)).select("id", "changed", "project_id")


@query("git_urls", r"""SELECT id, url, n AS normalized, CASE WHEN n ~ '^https?://' AND regexp_matches(path, '[^/]+/+[^/]') THEN regexp_extract(path, '([^/]+)/*$', 1) END AS strict_name,
    nullif(regexp_extract(path, '([^/]*)$', 1), '') AS name, nullif(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/*([^?#]*)', 1), '\.git$', '', 'i'), '') AS label
    FROM (SELECT *, regexp_replace(regexp_extract(n, '^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '^/+|/+$', '', 'g') AS path FROM (SELECT *,
        nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '/+$', ''), '\.git$', ''),
        '^git@([^:]*):', 'https://\1/'), '^ssh://git@', 'https://'), '') AS n FROM (
        SELECT 'p' || page_id AS id, url FROM pages UNION ALL SELECT 'c' || id, git_remote FROM v_project UNION ALL SELECT 'n' || id, name FROM v_project)))""")
def _(spark, d):
    projects = v.project(spark, d)
    urls = (v.table(spark, d, "pages").select(_cat("p", F.col("page_id")).alias("id"), "url")
            .unionByName(projects.select(_cat("c", F.col("id")).alias("id"), F.col("git_remote").alias("url")))
            .unionByName(projects.select(_cat("n", F.col("id")).alias("id"), F.col("name").alias("url"))))
    url = F.col("url")
    return urls.select("id", "url", git.normalize_git_url(url).alias("normalized"),
                       git.repo_name(url, strict=True).alias("strict_name"), git.repo_name(url).alias("name"),
                       git.remote_label(url).alias("label"))


# ---------------------------------------------------------------- text

_HIDE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({x}, '/home/ann', '~'), '/Users/[^/\s]+', '/Users/[redacted]', 'g'),
    '/home/[^/\s]+', '/home/[redacted]', 'g'), '[A-Za-z]:\\Users\\[^\\\s]+', 'C:\\Users\\[redacted]', 'g'), '[A-Za-z]:/Users/[^/\s]+', 'C:/Users/[redacted]', 'g'),
    '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[redacted]', 'g')"""


@query("redacted_texts", f"""SELECT doc_id, {_HIDE.format(x="'/home/ann/a /home/bob/b /Users/cy/c ' || text")} AS redacted FROM documents""")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.redact(
        F.concat(F.lit("/home/ann/a /home/bob/b /Users/cy/c "), "text"), "/home/ann").alias("redacted"))


@query("storable_texts", r"""SELECT doc_id, coalesce(NOT regexp_matches(t, '^\s*user:|^\s*assistant:|system prompt|\bprompt\b') AND (
    coalesce(lower(source) IN ('sparkle', 'git', 'main', 'worker', 'router'), false) OR lang IN ('warn', 'error')
    OR regexp_matches(t, 'codex_app_|launching app|sparkle|git\b|worktree|automation|desktop notification|app server|skills?/')), false) AS storable
    FROM (SELECT *, lower(text) AS t FROM documents)""")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.coalesce(
        tx.may_store(F.col("lang"), F.col("source"), F.col("text")), F.lit(False)).alias("storable"))


@query("signatures", r"""SELECT doc_id, CASE WHEN source IS NULL THEN s WHEN s = '' THEN source ELSE source || '|' || s END AS signature
    FROM (SELECT *, substr(trim(regexp_replace(coalesce(text, ''), '[\s\v]+', ' ', 'g')), 1, 200) AS s FROM documents)""")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.signature(F.col("source"), F.col("text")).alias("signature"))


@query("plain_texts", "SELECT doc_id, text AS plain FROM documents")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.strip_escapes(F.concat(
        F.lit("\u001b]0;title\u0007\u001b[1;32m"), "text", F.lit("\u001b[0m"))).alias("plain"))


@query("masked_emails", """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'example.com@x' END AS email_domain,
    CASE WHEN event_id % 5 = 0 THEN substr(sha256('user' || user_id), 1, 12) WHEN event_id % 5 = 1 THEN NULL ELSE substr(sha256('User' || user_id), 1, 12) END AS email_hash FROM events""")
def _(spark, d):
    key, user = F.col("event_id"), F.col("user_id")
    email = (F.when(key % 5 == 0, _cat("user", user)).when(key % 5 == 1, F.lit("@Example.COM@x"))
             .otherwise(_cat("User", user, "@Example.COM@X")))
    return v.table(spark, d, "events").select("event_id", tx.mask_email(email).alias("m")).select("event_id", "m.*")


# ---------------------------------------------------------------- tool log

def tool_log(spark, d) -> DataFrame:
    """Events as log lines in sixteen files; one kind spreads its arguments over three lines."""
    kind, key, k = F.col("event_type"), F.col("event_id"), F.col("k")
    # A column file holds many more rows to a split than a log has lines.
    spread = v.table(spark, d, "events").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    events = spread.select(
        "*", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"), F.round(F.col("value") * 100).cast("bigint").alias("took"))
    stamp = F.substring(F.col("ts").cast("string"), 1, 23)
    first = (F.when(kind == "view", _cat(stamp, ' [info] FunctionCall: view {"cmd":"run ', k, '"}'))
             .when(kind == "click", _cat("\u001b[32m", stamp, " [info] FunctionCall: click\u001b[0m"))
             .when(kind == "signup", _cat(stamp, " [info] ToolCall: signup status=ok exit_code=0 duration_ms=", F.col("took"), ' cmd="run ', k, '"'))
             .when(kind == "purchase", _cat(stamp, ' [info] ToolCall: view ({"state":"Completed","code":', k % 3, ',"durationMs":', F.col("took"), ',"cmd":"run ', k, '"})'))
             .otherwise(_cat(stamp, " [warn] BackgroundEvent: Execution failed: exit code=", k, " tool=click command=run ", k)))
    more = F.when(kind == "click", F.array(_cat('{"cmd":"run ', k, '",'), F.lit(' "note": "2020-01-01 00:00:00 ToolCall: none"}')))
    lines = F.concat(F.array(first), F.coalesce(more, F.array().cast("array<string>")))
    return events.select(_cat("tool-", F.col("user_id") % 16).alias("file"), F.posexplode(lines).alias("i", "value"), "event_id").select(
        "file", (F.col("event_id") * 4 + F.col("i")).alias("line"), "value")


_TOOL_EVENTS = """SELECT 'tool-' || (user_id % 16) AS file, event_id * 4 AS line, epoch_us(ts) // 1000 AS ts,
    CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type = 'error' THEN 2 ELSE 1 END AS rank,
    CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'start' WHEN 'error' THEN 'failure' ELSE 'exit' END AS event_type,
    CASE event_type WHEN 'purchase' THEN 'view' WHEN 'error' THEN 'click' ELSE event_type END AS tool_name, 'run ' || k AS command,
    CASE event_type WHEN 'purchase' THEN 'view' WHEN 'error' THEN 'click' ELSE event_type END || '|run ' || k AS signature,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN k % 3 WHEN 'error' THEN k END AS exit_code,
    CASE WHEN event_type IN ('signup', 'purchase') THEN took END AS duration_ms,
    CASE WHEN event_type = 'error' THEN 'exit code=' || k || ' tool=click command=run ' || k END AS error FROM v_event"""


@query("tool_log_events", _TOOL_EVENTS)
def _(spark, d):
    return tool_log_events(tool_log_records(tool_log(spark, d))).drop("stdout_bytes", "stderr_bytes")


@query("log_segments", """SELECT file, line, last_value(CASE WHEN prev IS NULL OR ts - prev > 300000 THEN ts END IGNORE NULLS) OVER (
    PARTITION BY file ORDER BY ts, line) AS segment FROM (SELECT *, lag(ts) OVER (PARTITION BY file ORDER BY ts, line) AS prev FROM e)""",
       {"e": _TOOL_EVENTS})
def _(spark, d):
    return correlation.segmented(tool_log_events(tool_log_records(tool_log(spark, d)))).select("file", "line", "segment")


def _pairs(spark, d):
    return correlation.correlate(tool_log_events(tool_log_records(tool_log(spark, d))))


# The matching rule event by event, with the pending starts of a file as a list.
_PAIRED = {
    "o": _TOOL_EVENTS,
    "e": "SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts, rank, line) AS i FROM o",
    "r": """SELECT DISTINCT file, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(line BIGINT, ts BIGINT, sig VARCHAR, tool VARCHAR)[]) AS pending,
            CAST(NULL AS BIGINT) AS s_line, CAST(NULL AS BIGINT) AS line, false AS kept FROM e
        UNION ALL SELECT file, i, CASE WHEN is_start AND NOT again THEN list_append(alive, {'line': line, 'ts': ts, 'sig': signature, 'tool': tool_name})
            WHEN is_start THEN alive ELSE list_filter(alive, lambda x: x.line IS DISTINCT FROM best) END, best, line, is_start AND NOT again
        FROM (SELECT *, is_start AND len(list_filter(alive, lambda x: x.sig = signature AND ts - x.ts <= 1000)) > 0 AS again,
            CASE WHEN NOT is_start THEN list_sort(list_transform(alive, lambda x, n: {
                'points': CASE WHEN x.sig = signature THEN 2 ELSE 0 END + CASE WHEN x.tool = tool_name THEN 1 ELSE 0 END,
                'near': CASE WHEN x.sig = signature OR x.tool = tool_name THEN x.ts ELSE 0 END, 'first': -n, 'line': x.line}), 'DESC')[1].line END AS best
            FROM (SELECT e.*, e.event_type = 'start' AS is_start, list_filter(r.pending, lambda x: e.ts - x.ts <= 300000) AS alive
                FROM r JOIN e ON e.file = r.file AND e.i = r.i + 1))""",
    "pairs": """SELECT file, s_line, line AS e_line FROM r WHERE i > 0 AND line IN (SELECT line FROM e WHERE event_type <> 'start')
        UNION ALL SELECT file, line, NULL FROM r WHERE kept AND line NOT IN (SELECT s_line FROM r WHERE s_line IS NOT NULL)""",
    "matched": """SELECT p.file, coalesce(s.line, x.line) AS source_line, coalesce(s.tool_name, x.tool_name) AS tool_name, coalesce(s.command, x.command) AS command,
        CASE WHEN x.line IS NULL THEN 'unknown' WHEN x.event_type = 'failure' OR coalesce(x.exit_code <> 0, false) THEN 'failed' ELSE 'ok' END AS status,
        coalesce(s.ts, x.ts - coalesce(x.duration_ms, 0)) AS start_ts, x.ts AS end_ts, x.duration_ms AS given, x.exit_code, x.error,
        coalesce(s.signature, x.signature) AS signature, s.ts AS s_ts, s.line AS s_line, x.line AS e_line, x.event_type
        FROM pairs p LEFT JOIN e s ON s.line = p.s_line LEFT JOIN e x ON x.line = p.e_line""",
}


@query("correlated_tool_calls", """SELECT substr(sha256(file || ':' || source_line || ':' || signature || ':' || start_ts), 1, 16) AS id, tool_name, command, status,
    start_ts, end_ts, coalesce(given, end_ts - start_ts) AS duration_ms, exit_code, error, file AS source_file, source_line,
    substr(sha256(signature || ':' || start_ts), 1, 16) AS correlation_key FROM matched""", _PAIRED)
def _(spark, d):
    return correlation.tool_calls(_pairs(spark, d)).drop("session_id", "stdout_bytes", "stderr_bytes", "dedup_key")


@query("correlated_tool_call_events", """SELECT e.tool_name, e.event_type, e.ts, e.exit_code, e.file AS source_file, e.line AS source_line,
    substr(sha256(b.signature || ':' || coalesce(b.s_ts, e.ts)), 1, 16) AS correlation_key,
    substr(sha256(e.file || ':' || e.line || ':' || e.event_type || ':' || e.ts || ':' || e.signature), 1, 16) AS dedup_key
    FROM matched b JOIN e ON e.line IN (b.s_line, b.e_line)""", _PAIRED)
def _(spark, d):
    return correlation.tool_call_events(_pairs(spark, d)).drop("id", "session_id", "payload")


# ---------------------------------------------------------------- desktop log

def desktop_log(spark, d) -> DataFrame:
    """Events as desktop log records, some over two lines."""
    kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
    events = v.table(spark, d, "events").select("*", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))
    iso = F.concat(F.translate(F.rpad(F.substring(F.col("ts").cast("string"), 1, 23), 23, "0"), " ", "T"), F.lit("Z"))
    iso = F.regexp_replace(iso, "T(..:..:..)0000Z", "T$1.000Z")
    first = (F.when(kind == "signup", _cat(iso, " INFO [git] created worktree /home/u", user, "/wt", k, " branch: b/", k, ' {"mail":"a@b.org"}'))
             .when(kind == "purchase", _cat(iso, ' warn [core] removed worktree "/Users/u', user, '/my wt"'))
             .when(kind == "error", _cat(iso, " error [automation] automation broke thread_id=t", k))
             .when(kind == "click", _cat(iso, " info [main] enqueued automation"))
             .otherwise(_cat(iso, " error [main] user: secret")))
    second = F.when(kind == "error", F.lit(" exception for ann@example.org"))
    lines = F.filter(F.array(first, second), lambda x: x.isNotNull())
    return events.select(_cat("/logs/app-desktop-", F.conv(user.cast("string"), 10, 16), "-", user, "-t", user % 7, "-i1-000000-", user % 3, ".log").alias("file"),
                         F.posexplode(lines).alias("i", "value"), "event_id").select(
        "file", (F.col("event_id") * 2 + F.col("i") + 1).alias("line"), "value")


def _safe(spark, d):
    return desktoplog.safe_records(desktoplog.desktop_records(desktop_log(spark, d))[0], v.NOW_MS)


_DESKTOP = {
    "dl": """SELECT '/logs/app-desktop-' || printf('%X', user_id) || '-' || user_id || '-t' || (user_id % 7) || '-i1-000000-' || (user_id % 3) || '.log' AS file_path,
        event_id * 2 + 1 AS line_number, epoch_us(ts) // 1000 AS ts, printf('%X', user_id) AS app_session_id, user_id AS process_id, user_id % 7 AS thread_id,
        CAST(1 AS BIGINT) AS instance_id, user_id % 3 AS segment_index,
        CASE event_type WHEN 'purchase' THEN 'warn' WHEN 'error' THEN 'error' ELSE 'info' END AS level,
        CASE event_type WHEN 'signup' THEN 'git' WHEN 'purchase' THEN 'core' WHEN 'error' THEN 'automation' ELSE 'main' END AS component,
        CASE event_type WHEN 'signup' THEN 'created worktree /home/[redacted]/wt' || k || ' branch: b/' || k
            WHEN 'purchase' THEN 'removed worktree "/Users/[redacted]/my wt"'
            WHEN 'error' THEN 'automation broke thread_id=t' || k || chr(10) || ' exception for [redacted]' ELSE 'enqueued automation' END AS message,
        CASE WHEN event_type = 'signup' THEN '{"mail":"[redacted]"}' END AS payload_text, event_type, k, user_id FROM v_event WHERE event_type <> 'view'""",
    "dk": """SELECT *, substr(sha256(file_path || ':' || line_number || ':' || substr(sha256('{"component":"' || component || '","level":"' || level || '","message":"'
        || replace(replace(message, '"', '\\"'), chr(10), '\\n') || '","payload":' || coalesce('"' || replace(payload_text, '"', '\\"') || '"', 'null') || ',"ts":' || ts || '}'), 1, 24)), 1, 24) AS dedup_key FROM dl""",
}


@query("desktop_log_events", """SELECT dedup_key AS id, app_session_id, ts, level, component, message, payload_text, process_id, thread_id, instance_id, segment_index,
    file_path, line_number, dedup_key, 1735689600000 AS created_at FROM dk""", _DESKTOP)
def _(spark, d):
    return _safe(spark, d).drop("said")


_WT_KEY = """substr(sha256(dedup_key || ':0:' || substr(sha256('{"action":"' || action || '","branch":' || coalesce('"' || branch || '"', 'null')
    || ',"pathValue":"' || raw_path || '","ts":' || ts || '}'), 1, 24)), 1, 24)"""


@query("desktop_worktree_events", f"""SELECT {_WT_KEY} AS id, ts, action, worktree_path, worktree_path AS repo_root, branch, 'ok' AS status,
    CAST(NULL AS VARCHAR) AS error, app_session_id, dedup_key AS source_log_id, {_WT_KEY} AS dedup_key FROM (SELECT *,
    CASE event_type WHEN 'signup' THEN 'created' ELSE 'archived' END AS action, CASE WHEN event_type = 'signup' THEN 'b/' || k END AS branch,
    CASE event_type WHEN 'signup' THEN '/home/u' || user_id || '/wt' || k ELSE '/Users/u' || user_id || '/my wt' END AS raw_path,
    CASE event_type WHEN 'signup' THEN '/home/[redacted]/wt' || k ELSE '/Users/[redacted]/my wt' END AS worktree_path
    FROM dk WHERE event_type IN ('signup', 'purchase'))""", _DESKTOP)
def _(spark, d):
    return desktoplog.worktree_events(_safe(spark, d))


@query("desktop_automation_events", """SELECT ts, CASE event_type WHEN 'click' THEN 'queued' ELSE 'failed' END AS action,
    CASE event_type WHEN 'click' THEN CAST(thread_id AS VARCHAR) ELSE 't' || k END AS thread_id, CASE event_type WHEN 'click' THEN 'ok' ELSE 'failed' END AS status,
    CASE WHEN event_type = 'error' THEN message END AS error, app_session_id, dedup_key AS source_log_id FROM dk WHERE event_type IN ('click', 'error')""", _DESKTOP)
def _(spark, d):
    return desktoplog.automation_events(_safe(spark, d)).drop("id", "dedup_key")


@query("archived_worktrees", """SELECT worktree_path, 'archived' AS action, 1735689600000 AS ts, substr(sha256('worktree_archive:0:' || substr(sha256(
    '{"action":"archived","archivedAt":1735689600000,"lastSeenTs":' || ts || ',"path":"' || worktree_path || '"}'), 1, 24)), 1, 24) AS dedup_key
    FROM (SELECT *, row_number() OVER (PARTITION BY worktree_path ORDER BY ts DESC, id) AS rn FROM v_worktree)
    WHERE rn = 1 AND action NOT IN ('archived', 'deleted') AND worktree_path NOT LIKE '%wt1' AND worktree_path NOT LIKE '%wt3'""")
def _(spark, d):
    events = v.worktree_event(spark, d)
    inventory = events.filter(F.col("worktree_path").rlike("wt[13]$")).select(F.col("worktree_path").alias("path")).distinct()
    return desktoplog.archived_events(events, inventory, v.NOW_MS).select("worktree_path", "action", "ts", "dedup_key")


# ---------------------------------------------------------------- writing rules

def _batch(spark, d) -> DataFrame:
    """Events read twice, once under a file that sorts later; a quarter is stored already."""
    rows = v.tool_call(spark, d).select("id", "tool_name", F.concat(F.lit("d"), F.col("id")).alias("dedup_key"), F.col("start_ts").alias("source_line"))
    return rows.withColumn("source_file", F.lit("a")).unionByName(rows.withColumn("source_file", F.lit("b")))


@query("appended_calls", "SELECT id, tool_name, 'd' || id AS dedup_key, start_ts AS source_line, 'a' AS source_file FROM v_tool WHERE CAST(id AS BIGINT) % 4 <> 0")
def _(spark, d):
    batch = _batch(spark, d)
    return merging.append_new(batch.filter("cast(id as bigint) % 4 = 0"), batch, ("dedup_key",))


@query("appended_calls_by_id", """SELECT id, dedup_key FROM (SELECT CAST(CAST(id AS BIGINT) // 2 AS VARCHAR) AS id, id AS dedup_key, row_number() OVER (
    PARTITION BY CAST(id AS BIGINT) // 2 ORDER BY start_ts, id) AS rn FROM v_tool) WHERE rn = 1""")
def _(spark, d):
    rows = v.tool_call(spark, d).select(F.floor(F.col("id").cast("bigint") / 2).cast("string").alias("id"),
                                        F.col("id").alias("dedup_key"), "start_ts")
    return merging.append_new(rows.limit(0), rows, ("dedup_key", "id"), [F.col("start_ts"), F.col("dedup_key")]).drop("start_ts")


@query("rejected_ids", """SELECT CAST(start_ts AS VARCHAR) AS file, CAST(id AS BIGINT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY CAST(id AS BIGINT) // 2
    ORDER BY start_ts, id) AS rn FROM v_tool) WHERE rn > 1""")
def _(spark, d):
    rows = v.tool_call(spark, d).select(
        F.floor(F.col("id").cast("bigint") / 2).cast("string").alias("id"), F.col("id").alias("dedup_key"), "start_ts",
        F.col("start_ts").cast("string").alias("source_file"), F.col("id").cast("bigint").alias("source_line"))
    return merging.split_unique(rows, rows.limit(0), [F.col("start_ts"), F.col("dedup_key")])[1].select("file", "line")


def _calls_by_half(spark, d) -> DataFrame:
    """Calls in pairs of one id; the pairs with an even id are stored, their other rows arrive again under other keys."""
    return v.tool_call(spark, d).select(
        F.floor(F.col("id").cast("bigint") / 2).cast("string").alias("id"), F.col("id").alias("dedup_key"), "start_ts",
        F.col("start_ts").cast("string").alias("source_file"), F.col("id").cast("bigint").alias("source_line"))


_HALVES = """SELECT CAST(CAST(id AS BIGINT) // 2 AS VARCHAR) AS id, id AS dedup_key, start_ts, CAST(id AS BIGINT) AS n,
    CAST(id AS BIGINT) // 2 % 3 = 0 AND CAST(id AS BIGINT) % 2 = 0 AS stored FROM v_tool"""
_STORED = "cast(id as bigint) % 3 = 0 and source_line % 2 = 0"


@query("appended_calls_to_stored", f"""SELECT id, dedup_key FROM (SELECT *, bool_or(stored) OVER (PARTITION BY id) AS taken,
    row_number() OVER (PARTITION BY id ORDER BY start_ts, dedup_key) AS rn FROM ({_HALVES})) WHERE NOT taken AND rn = 1""")
def _(spark, d):
    rows = _calls_by_half(spark, d)
    return merging.append_new(rows.filter(_STORED), rows, ("dedup_key", "id"), [F.col("start_ts"), F.col("dedup_key")]).select("id", "dedup_key")


@query("rejected_ids_of_stored", f"""SELECT CAST(start_ts AS VARCHAR) AS file, n AS line FROM (SELECT *, bool_or(stored) OVER (PARTITION BY id) AS taken,
    row_number() OVER (PARTITION BY id ORDER BY start_ts, dedup_key) AS rn FROM ({_HALVES})) WHERE NOT stored AND (taken OR rn > 1)""")
def _(spark, d):
    # Stored rows read again are no rejects: they repeat their dedup key too.
    rows = _calls_by_half(spark, d)
    return merging.split_unique(rows, rows.filter(_STORED), [F.col("start_ts"), F.col("dedup_key")])[1].select("file", "line")


@query("orphaned_messages", """SELECT 'c' AS file, turn AS line, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) GROUP BY turn""")
def _(spark, d):
    said = v.message(spark, d).select("id", "session_id", F.lit("c").alias("source_file"),
                                      F.substring_index("id", "-", -1).cast("bigint").alias("source_line"))
    held = v.session(spark, d).filter("cast(id as bigint) % 3 <> 0")
    return merging.split_valid(said, held)[1].groupBy("file", "line").agg(F.count("*").alias("n"))


@query("merged_projects", """SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(o_orderpriority, o_orderkey) AS name,
    arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 'p' || o_orderkey END, o_orderkey) FILTER (o_orderkey % 3 = 0) AS root_path,
    arg_max('g' || o_orderkey, o_orderkey) FILTER (o_orderkey % 7 = 0) AS git_remote,
    min(epoch_us(o_orderdate) // 1000) AS first_seen_ts, max(epoch_us(o_orderdate) // 1000) AS last_seen_ts FROM orders GROUP BY o_custkey""")
def _(spark, d):
    key, ts = F.col("o_orderkey"), v.millis_of(F.col("o_orderdate"))
    rows = v.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"),
        F.when(key % 3 == 0, _cat("p", key)).alias("root_path"), F.when(key % 7 == 0, _cat("g", key)).alias("git_remote"),
        ts.alias("first_seen_ts"), ts.alias("last_seen_ts"), key.alias("arrival"))
    # Every order is one arrival; the stored table is empty.
    return merging.merge_projects(rows.drop("arrival").limit(0), rows)


@query("merged_refs", """SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(any_value(o_custkey % 10) AS VARCHAR) AS project_id, arg_max(o_orderstatus, o_orderkey) AS branch,
    arg_max('c' || o_orderkey, o_orderkey) FILTER (o_orderkey % 3 = 0) AS "commit", '/w' AS cwd,
    min(epoch_us(o_orderdate) // 1000) AS first_seen_ts, max(epoch_us(o_orderdate) // 1000) AS last_seen_ts FROM orders GROUP BY o_custkey""")
def _(spark, d):
    key, ts = F.col("o_orderkey"), v.millis_of(F.col("o_orderdate"))
    rows = v.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), (F.col("o_custkey") % 10).cast("string").alias("project_id"),
        F.col("o_orderstatus").alias("branch"), F.when(key % 3 == 0, _cat("c", key)).alias("commit"), F.lit("/w").alias("cwd"),
        ts.alias("first_seen_ts"), ts.alias("last_seen_ts"), key.alias("arrival"))
    return merging.merge_refs(rows.drop("arrival").limit(0), rows)


def _half_merged(merge, spark, d, **columns) -> DataFrame:
    """Odd orders are merged first, into a stored table; the even ones then arrive on top of it."""
    key, ts = F.col("o_orderkey"), v.millis_of(F.col("o_orderdate"))
    rows = v.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), *[c.alias(n) for n, c in columns.items()],
                                              ts.alias("first_seen_ts"), ts.alias("last_seen_ts"), key.alias("arrival"))
    stored = merge(rows.drop("arrival").limit(0), rows.filter("arrival % 2 = 1"))
    return merge(stored, rows.filter("arrival % 2 = 0"))


# Stored rows arrived first, so an even order counts as later than any odd one.
_TURN = "o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 1000000000000 ELSE 0 END"


@query("merged_projects_with_stored", f"""SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(o_orderpriority, {_TURN}) AS name,
    arg_max('p' || o_orderkey, {_TURN}) FILTER (o_orderkey % 3 = 0) AS root_path, arg_max('g' || o_orderkey, {_TURN}) FILTER (o_orderkey % 7 = 0) AS git_remote,
    min(epoch_us(o_orderdate) // 1000) AS first_seen_ts, max(epoch_us(o_orderdate) // 1000) AS last_seen_ts FROM orders GROUP BY o_custkey""")
def _(spark, d):
    key = F.col("o_orderkey")
    return _half_merged(merging.merge_projects, spark, d, name=F.col("o_orderpriority"),
                        root_path=F.when(key % 3 == 0, _cat("p", key)), git_remote=F.when(key % 7 == 0, _cat("g", key)))


@query("merged_refs_with_stored", f"""SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(any_value(o_custkey % 10) AS VARCHAR) AS project_id, arg_max(o_orderstatus, {_TURN}) AS branch,
    arg_max('c' || o_orderkey, {_TURN}) FILTER (o_orderkey % 3 = 0) AS "commit", '/w' AS cwd,
    min(epoch_us(o_orderdate) // 1000) AS first_seen_ts, max(epoch_us(o_orderdate) // 1000) AS last_seen_ts FROM orders GROUP BY o_custkey""")
def _(spark, d):
    key = F.col("o_orderkey")
    return _half_merged(merging.merge_refs, spark, d, project_id=(F.col("o_custkey") % 10).cast("string"), branch=F.col("o_orderstatus"),
                        commit=F.when(key % 3 == 0, _cat("c", key)), cwd=F.lit("/w"))


@query("deleted_sessions", """SELECT 'session' AS table_name, id, CAST(NULL AS VARCHAR) AS session_id FROM v_session WHERE CAST(id AS BIGINT) % 5 <> 0
    UNION ALL SELECT 'message', id, session_id FROM v_message WHERE CAST(session_id AS BIGINT) % 5 <> 0
    UNION ALL SELECT 'model_call', id, session_id FROM v_call WHERE CAST(session_id AS BIGINT) % 5 <> 0
    UNION ALL SELECT 'tool_call', id, CASE WHEN CAST(session_id AS BIGINT) % 5 <> 0 THEN session_id END FROM v_tool""")
def _(spark, d):
    tables = {"session": v.session(spark, d), "message": v.message(spark, d), "model_call": v.model_call(spark, d), "tool_call": v.tool_call(spark, d)}
    after = merging.delete_cascade(tables, "session", tables["session"].filter("cast(id as bigint) % 5 = 0"))
    out = None
    for name, df in after.items():
        rows = df.select(F.lit(name).alias("table_name"), "id", (
            F.col("session_id") if name != "session" else F.lit(None).cast("string")).alias("session_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("session_by_id", "SELECT id, ts, cwd FROM v_session WHERE id = '42'")
def _(spark, d):
    return merging.by_id(v.session(spark, d), "42").select("id", "ts", "cwd")


@query("latest_ledger", """SELECT path, byte_offset, line_count, mtime_ms, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY path
    ORDER BY updated_at DESC, byte_offset DESC) AS rn FROM v_ledger) WHERE rn = 1""")
def _(spark, d):
    from ..sources.ledger import latest_ledger
    return latest_ledger(v.ingest_state(spark, d))


# ---------------------------------------------------------------- odds and ends

@query("ingest_report", """SELECT (SELECT count(DISTINCT o_orderkey % 500) FROM orders) AS files_processed,
    (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem WHERE l_quantity NOT IN (13, 17)) + (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'N')
        AS lines_ingested, (SELECT count(*) FROM lineitem WHERE l_quantity = 13) AS errors""")
def _(spark, d):
    from ..plans.upkeep import ingest_report
    lines = session_log(spark, d)
    good, rejects = parse_jsonl(lines)
    return ingest_report(lines.select("file").distinct(), good, rejects)


@query("session_contexts", """SELECT conv_id || '-' || turn AS id, 865123200000 + turn * 1000 AS ts, text AS model, role AS model_provider
    FROM conversations WHERE conv_id = 7 ORDER BY ts, id""")
def _(spark, d):
    from ..plans.sessions import session_items
    contexts = v.table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"),
        (F.lit(v.BASE_MS) + F.col("turn") * 1000).alias("ts"), F.col("text").alias("model"),
        F.col("role").alias("model_provider"))
    return session_items("7", "contexts", v.session(spark, d), v.message(spark, d), v.model_call(spark, d),
                         v.tool_call(spark, d), contexts)


@query("priced_models", """SELECT p_partkey, model, CAST(CASE p_size % 6 WHEN 0 THEN 3.0 WHEN 1 THEN 3.0 WHEN 2 THEN 2.5 WHEN 5 THEN 4.0 END AS DOUBLE) AS input_price,
    CAST(CASE p_size % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 2 THEN 2.5 WHEN 5 THEN 4.0 END AS DOUBLE) AS cache_price FROM (SELECT *, CASE p_size % 6
    WHEN 0 THEN 'gpt-5.3-codex' WHEN 1 THEN 'x/gpt-5.3-codex' WHEN 2 THEN ' gpt-5.1-mini ' WHEN 3 THEN 'unknown' WHEN 4 THEN p_brand ELSE 'claude.1' END AS model FROM part)""")
def _(spark, d):
    from ..operators.pricing import with_price
    size = F.col("p_size") % 6
    rows = v.table(spark, d, "part").select("p_partkey", F.when(size == 0, "gpt-5.3-codex").when(size == 1, "x/gpt-5.3-codex")
        .when(size == 2, " gpt-5.1-mini ").when(size == 3, "unknown").when(size == 4, F.col("p_brand")).otherwise("claude.1").alias("model"))
    price = spark.createDataFrame([("gpt-5.2-codex", 3.0, 9.0, 0.5), ("openai/gpt-5-1-mini", 2.5, 9.0, None),
                                   ("anthropic/claude.1", 4.0, 9.0, None), ("unknown", 1.0, 1.0, 1.0), ("openai/claude-1", 7.0, 7.0, 7.0)],
                                  "model string, input_price double, output_price double, cache_price double")
    return with_price(rows, price).select("p_partkey", "model", "input_price", "cache_price")


@query("prices_shadowed", """SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN NULL ELSE p_size END AS DOUBLE) AS input_price,
    CAST(CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 2 THEN p_size END AS DOUBLE) AS cache_price FROM part""")
def _(spark, d):
    """A map of prices made of the parts, read as a price file.

    Of three models one has an entry of its own, one has an entry without prices, which hides the provider's
    entry behind it, and one is known under a provider's name alone and has no cache price.
    """
    from ..operators.pricing import with_price
    from ..sources.prices import prices_of
    key, size, price = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    parts = v.table(spark, d, "part")
    name = _cat("m-", key)
    entry = lambda model, cost, cache: F.to_json(F.create_map(model, F.struct(
        cost.alias("input_cost_per_token"), cost.alias("output_cost_per_token"), cache.alias("cache_read_input_token_cost"))))
    unpriced = F.to_json(F.create_map(name, F.struct(F.lit("image_generation").alias("mode"))))
    none = F.lit(None).cast("double")
    own = parts.select(F.when(key % 3 == 0, entry(name, price, size)).when(key % 3 == 1, unpriced).alias("value")).filter("value is not null")
    others = parts.filter(key % 3 > 0).select(entry(F.concat(F.lit("openai/"), name), size, none).alias("value"))
    return with_price(parts.select("p_partkey", name.alias("model")), prices_of(own.unionByName(others))).select(
        "p_partkey", "input_price", "cache_price")


@query("refreshed_rollup", """SELECT date, CASE WHEN date LIKE '%-01' THEN n ELSE 0 END AS created_count FROM (SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS date,
    CAST(sum(CASE WHEN action = 'created' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM v_worktree GROUP BY 1)""")
def _(spark, d):
    from ..plans.upkeep import refresh_days, worktree_rollup
    fresh = worktree_rollup(v.worktree_event(spark, d)).select("date", "created_count")
    stale = fresh.withColumn("created_count", F.lit(0).cast("bigint"))
    return refresh_days(stale, fresh, fresh.filter("date like '%-01'"))


@query("json_coercion", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN ' ' || k WHEN 4 THEN k || '.5' END AS as_text,
    CAST(CASE event_id % 6 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN 0 WHEN 4 THEN k + 0.5 END AS DOUBLE) AS as_number,
    CASE event_id % 6 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN 0 WHEN 4 THEN k END AS as_instant FROM v_event""")
def _(spark, d):
    from ..functions import variants as vr
    key = F.col("event_id") % 6
    k = F.regexp_extract("props", "([0-9]+)", 1)
    value = (F.when(key == 0, k).when(key == 1, F.concat(F.lit('" '), k, F.lit('"'))).when(key == 2, F.lit('"  "'))
             .when(key == 3, F.lit("true")).when(key == 4, F.concat(k, F.lit(".5"))).otherwise(F.concat(F.lit('{"x":'), k, F.lit("}"))))
    docs = v.table(spark, d, "events").select("event_id", vr.parse_json(value).alias("doc"))
    doc = F.col("doc")
    return docs.select("event_id", vr.to_text(doc).alias("as_text"), vr.to_number(doc).alias("as_number"),
                       vr.to_instant(doc).alias("as_instant"))
