"""The same projections as SQL, for the checks."""

VIEWS = {
    "v_session": """SELECT CAST(o_orderkey AS VARCHAR) AS id,
        epoch_us(o_orderdate) // 1000 + (o_orderkey * 7919) % 86400 * 1000 AS ts,
        '/home/u' || o_custkey || '/repo' || (o_custkey % 40) AS cwd,
        CASE WHEN o_orderkey % 3 = 0 THEN 'cli' ELSE 'ide' END AS originator,
        '0.' || (o_orderkey % 7) AS cli_version,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS model_provider,
        o_orderstatus AS git_branch, 'c' || (o_orderkey % 97) AS git_commit,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS project_id,
        CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 13 <> 0 THEN o_custkey || '-' || o_orderstatus END AS project_ref_id
        FROM orders""",
    "v_call": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
        CAST(l_orderkey AS VARCHAR) AS session_id,
        epoch_us(l_shipdate) // 1000 + (l_linenumber * 3600 + l_partkey % 3600) * 1000 AS ts,
        CASE WHEN l_returnflag = 'A' THEN 'gpt-5' WHEN l_returnflag = 'R' THEN 'gpt-5.1-mini'
             WHEN l_linenumber > 1 THEN 'local-llama' END AS model,
        CAST(round(l_quantity * 100) AS BIGINT) AS input_tokens,
        CAST(round(l_quantity * 100 * l_discount) AS BIGINT) AS cached_input_tokens,
        CAST(round(l_quantity * 10) AS BIGINT) AS output_tokens,
        CAST(round(l_tax * 100) AS BIGINT) AS reasoning_tokens,
        CAST(round(l_quantity * 100) AS BIGINT) + CAST(round(l_quantity * 10) AS BIGINT) AS total_tokens,
        CASE WHEN l_linestatus = 'F' THEN CAST(round((l_quantity - 1) * 1000) AS BIGINT) END AS duration_ms
        FROM lineitem""",
    "v_message": """SELECT conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS session_id, role,
        865123200000 + conv_id * 2220000 + turn * 45000 AS ts, text AS content FROM conversations""",
    "v_event": """SELECT *, epoch_us(ts) // 1000 - 838944000000 AS ms,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS took
        FROM events""",
    "v_tool": """SELECT CAST(event_id AS VARCHAR) AS id,
        CASE WHEN event_id % 2 = 1 THEN CAST(user_id AS VARCHAR) END AS session_id, event_type AS tool_name,
        CASE WHEN k % 10 <> 0 THEN 'run ' || k END AS command,
        CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('purchase', 'click') THEN 'ok' ELSE 'unknown' END AS status,
        ms AS start_ts, CASE WHEN event_id % 3 <> 0 THEN ms + took END AS end_ts,
        CASE WHEN event_id % 3 = 1 THEN took END AS duration_ms,
        CASE WHEN event_type = 'error' THEN k % 3 WHEN event_type IN ('purchase', 'click') THEN 0 END AS exit_code,
        CASE WHEN event_type = 'error' THEN CASE WHEN k % 25 = 0 THEN '' ELSE 'err ' || (k % 25) END END AS error,
        event_id % 1000 AS stdout_bytes, CAST(0 AS BIGINT) AS stderr_bytes, 'c' || event_id AS correlation_key
        FROM v_event""",
    "v_worktree": """SELECT CAST(event_id AS VARCHAR) AS id, ms AS ts,
        CASE WHEN event_type = 'signup' THEN 'created' WHEN event_type = 'error' THEN 'error'
             WHEN event_id % 2 = 1 THEN 'archived' ELSE 'deleted' END AS action,
        '/home/u' || user_id || '/wt' || (k % 5) AS worktree_path, '/home/u' || user_id || '/wt' || (k % 5) AS repo_root,
        'b' || (k % 7) AS branch, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
        CASE WHEN event_type = 'error' THEN 'boom ' || k END AS error
        FROM v_event WHERE event_type IN ('signup', 'purchase', 'error')""",
    "v_automation": """SELECT CAST(event_id AS VARCHAR) AS id, ms AS ts,
        CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS action,
        CAST(user_id AS VARCHAR) AS thread_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
        CASE WHEN event_type = 'error' THEN 'boom ' || k END AS error
        FROM v_event WHERE event_type IN ('signup', 'purchase', 'error')""",
    "v_project": """SELECT CAST(c_custkey AS VARCHAR) AS id, 'Repo' || (c_custkey % 90) AS name,
        '/home/' || lower(c_mktsegment) || '/' || c_custkey AS root_path,
        CASE c_custkey % 4
            WHEN 1 THEN 'https://Git.Example.com/Org' || (c_nationkey % 5) || '/Repo' || (c_custkey % 60) || '.git'
            WHEN 2 THEN 'git@git.example.com:Org' || (c_nationkey % 5) || '/repo' || (c_custkey % 60)
            WHEN 3 THEN 'ssh://git@git.example.com/Org' || (c_nationkey % 5) || '/Repo' || (c_custkey % 60) || '/' END AS git_remote,
        865123200000 - c_custkey * 60000 AS first_seen_ts,
        CASE WHEN c_custkey % 17 <> 0 THEN 865123200000 + c_custkey * 7919 % 5000 * 60000 END AS last_seen_ts
        FROM customer""",
    "v_ref": """SELECT o_custkey || '-' || o_orderstatus AS id, CAST(o_custkey AS VARCHAR) AS project_id,
        CASE WHEN o_custkey % 5 <> 0 OR o_orderstatus <> 'P' THEN o_orderstatus END AS branch,
        CASE WHEN o_custkey % 3 = 0 THEN 'r' || o_custkey END AS "commit", '/home/u' || o_custkey AS cwd,
        max(epoch_us(o_orderdate) // 1000) AS last_seen_ts
        FROM orders GROUP BY o_custkey, o_orderstatus""",
    "v_ledger": """SELECT '/logs/' || coalesce(source, 'none') || '/' || (doc_id % 300) || '.jsonl' AS path,
        CAST(n_chars AS BIGINT) AS byte_offset, doc_id % 50 AS line_count,
        CASE WHEN doc_id % 9 <> 0 THEN 865123200000 + doc_id * 1000 END AS mtime_ms,
        865123200000 + doc_id * 7919 % 100000 * 1000 AS updated_at FROM documents""",
    "v_price": """SELECT * FROM (VALUES ('gpt-5', 1.25e-06::DOUBLE, 1.0e-05::DOUBLE, 1.25e-07::DOUBLE),
        ('gpt-5.1-mini', 2.5e-07::DOUBLE, 2.0e-06::DOUBLE, 2.5e-07::DOUBLE)) p(model, pi, po, pc)""",
    # One row per call with its cost, priced singly.
    "v_cost": """SELECT c.*, p.pi, p.pc, p.po, greatest(0, input_tokens - cached_input_tokens) * pi + cached_input_tokens * pc
            + (output_tokens + reasoning_tokens) * po AS cost FROM v_call c LEFT JOIN v_price p USING (model)""",
    "v_merge": """SELECT *, CASE WHEN remote_norm IS NOT NULL THEN remote_norm ELSE lower(name) END AS merge_key,
        CASE WHEN remote_norm IS NOT NULL THEN regexp_extract(remote_norm, '([^/]+)$', 1) ELSE lower(name) END AS canonical
        FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            lower(git_remote), '/+$', ''), '\\.git$', ''), '^git@([^:]+):', 'https://\\1/'), '^ssh://git@', 'https://') AS remote_norm
            FROM v_project)""",
}

_NEEDS = {"v_tool": ["v_event"], "v_worktree": ["v_event"], "v_automation": ["v_event"],
          "v_cost": ["v_call", "v_price"], "v_merge": ["v_project"]}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a SELECT with the views it names, in order of need."""
    named: list[str] = []

    def add(view):
        for need in _NEEDS.get(view, []):
            add(need)
        if view not in named:
            named.append(view)

    everything = body + " ".join((extra or {}).values())
    for view in VIEWS:
        if view in everything:
            add(view)
    parts = [f"{v} AS ({VIEWS[v]})" for v in named] + [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body if parts else body
