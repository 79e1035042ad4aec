"""Report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.ordered import clamped_balance, latest_per_key
from ..operators.pages import top_k, total
from ..plans import activity, balances, models, overview, projects, sessions, tools, upkeep
from ..plans.sessions import SessionFilters
from ..plans.tools import ToolFilters
from ..plans.usage import with_effective_duration
from ..ranges import DateRange, Page
from . import views as v
from .sql_views import with_views

S, E = v.RANGE.start, v.RANGE.end
P = v.RANGE.previous().start
JS, JE, JP = v.JUNE.start, v.JUNE.end, v.JUNE.previous().start
YEAR_BEFORE = v.RANGE.previous_year()
COST_DIGITS = 10

QUERIES: dict = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Round sums of costs, so that a different order of addition does not show.

    Ratios and means come from whole numbers and need no rounding.
    """
    is_cost = F.col("metric") == "total_cost" if "metric" in df.columns else F.lit(False)

    def shown(field):
        column = F.col(field.name)
        if not isinstance(field.dataType, DoubleType):
            return column
        rounded = F.round(column, COST_DIGITS)
        return (rounded if "cost" in field.name else F.when(is_cost, rounded).otherwise(column)).alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def query(name: str, body: str | None = None, extra: dict[str, str] | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if body is not None:
            SQL[name] = with_views(body, extra)
        return fn
    return register


def _kpis(metrics: dict[str, str], source: str) -> str:
    """Rows metric/value/previous/delta/delta_pct; ``source`` has one row per period 'c'/'p'."""
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS metric, CAST((SELECT {expr.replace('@', '0.0')} FROM {source} WHERE period = 'c') AS DOUBLE) AS v, "
        f"CAST((SELECT {expr.replace('@', 'NULL')} FROM {source} WHERE period = 'p') AS DOUBLE) AS p"
        for name, expr in metrics.items())
    shown = lambda x: f"CASE WHEN metric = 'total_cost' THEN round({x}, {COST_DIGITS}) ELSE {x} END"
    return (f"SELECT metric, {shown('v')} AS value, {shown('p')} AS previous, {shown('v - p')} AS delta, "
            f"{shown('CASE WHEN p <> 0 THEN (v - p) / p END')} AS delta_pct FROM ({rows})")


def _period(ts: str, start: int) -> str:
    return f"CASE WHEN {ts} >= {start} THEN 'c' ELSE 'p' END"


# ---------------------------------------------------------------- overview

_OVERVIEW = lambda project: {
    "w": f"SELECT *, {_period('ts', S)} AS period FROM v_cost WHERE ts BETWEEN {P} AND {E}"
         + (f" AND session_id IN (SELECT id FROM v_session WHERE project_id = '{project}')" if project else ""),
    "d": "SELECT *, lead(ts) OVER (PARTITION BY period, session_id ORDER BY ts, id) AS nxt FROM w",
    "e": "SELECT *, CASE WHEN duration_ms > 0 THEN duration_ms WHEN nxt > ts THEN nxt - ts END AS eff FROM d",
    "u": "SELECT q.period, coalesce(sum(total_tokens), 0) AS tokens, coalesce(sum(input_tokens), 0) AS i, "
         "coalesce(sum(cached_input_tokens), 0) AS c, count(e.id) AS n, coalesce(avg(eff), 0) AS dur, "
         "coalesce(sum(cost), 0) AS cost FROM (VALUES ('c'), ('p')) q(period) LEFT JOIN e ON e.period = q.period GROUP BY 1",
    "t": f"SELECT q.period, count(x.id) AS n, coalesce(sum(CASE WHEN status IN ('ok', 'unknown') OR exit_code = 0 THEN 1 ELSE 0 END), 0) AS ok, "
         f"coalesce(avg(CASE WHEN duration_ms > 0 THEN duration_ms WHEN end_ts >= start_ts THEN end_ts - start_ts END), 0) AS dur "
         f"FROM (VALUES ('c'), ('p')) q(period) LEFT JOIN (SELECT *, {_period('start_ts', S)} AS period FROM v_tool "
         f"WHERE start_ts BETWEEN {P} AND {E}"
         + (f" AND session_id IN (SELECT id FROM v_session WHERE project_id = '{project}')" if project else "")
         + ") x ON x.period = q.period GROUP BY 1",
    "s": f"SELECT q.period, count(x.id) AS n FROM (VALUES ('c'), ('p')) q(period) LEFT JOIN (SELECT *, {_period('ts', S)} AS period "
         f"FROM v_session WHERE ts BETWEEN {P} AND {E}" + (f" AND project_id = '{project}'" if project else "")
         + ") x ON x.period = q.period GROUP BY 1",
    "k": "SELECT u.period, u.tokens, u.i, u.c, u.n AS calls, u.dur AS mdur, u.cost, t.n AS tn, t.ok, t.dur AS tdur, s.n AS sn "
         "FROM u JOIN t USING (period) JOIN s USING (period)",
}
_OVERVIEW_METRICS = {
    "total_tokens": "tokens", "cache_hit_rate": "CASE WHEN i > 0 THEN c / i ELSE @ END", "model_calls": "calls",
    "total_cost": "cost", "avg_model_duration_ms": "mdur", "sessions": "sn", "tool_calls": "tn",
    "success_rate": "CASE WHEN tn > 0 THEN ok / tn ELSE @ END", "avg_tool_duration_ms": "tdur"}


@query("overview_kpis", _kpis(_OVERVIEW_METRICS, "k"), _OVERVIEW(None))
def _(spark, d):
    return overview.overview_kpis(v.session(spark, d), v.model_call(spark, d), v.tool_call(spark, d), v.price(spark), v.RANGE)


@query("overview_kpis_of_project", _kpis(_OVERVIEW_METRICS, "k"), _OVERVIEW("17"))
def _(spark, d):
    return overview.overview_kpis(v.session(spark, d), v.model_call(spark, d), v.tool_call(spark, d), v.price(spark),
                                  v.RANGE, project="17")


_DAILY = """SELECT date, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens,
    CAST(sum(input_tokens + output_tokens + reasoning_tokens) AS BIGINT) AS total_tokens, count(*) AS model_calls,
    CASE WHEN sum(input_tokens) > 0 THEN sum(cached_input_tokens) / sum(input_tokens) ELSE 0 END AS cache_hit_rate,
    round(coalesce(sum(cost), 0), 10) AS estimated_cost
    FROM (SELECT *, strftime(make_timestamp({ts} * 1000), '%Y-%m-%d') AS date FROM v_cost WHERE ts BETWEEN {S} AND {E} {more})
    GROUP BY date"""


@query("overview_daily", _DAILY.format(ts="ts", S=S, E=E, more=""))
def _(spark, d):
    return overview.overview_daily(v.session(spark, d), v.model_call(spark, d), v.price(spark), v.RANGE)


@query("overview_daily_of_project_in_zone", _DAILY.format(
    ts="(ts + 20700000)", S=S, E=E, more="AND session_id IN (SELECT id FROM v_session WHERE project_id = '17')"))
def _(spark, d):
    return overview.overview_daily(v.session(spark, d), v.model_call(spark, d), v.price(spark), v.RANGE, "17",
                                   tz="Asia/Kathmandu")


@query("kpi_trend", "SELECT metric, CAST(sign(delta) AS INTEGER) AS trend FROM (" + _kpis(_OVERVIEW_METRICS, "k") + ")",
       _OVERVIEW(None))
def _(spark, d):
    from ..functions.scalars import trend
    return overview.overview_kpis(v.session(spark, d), v.model_call(spark, d), v.tool_call(spark, d), v.price(spark),
                                  v.RANGE).select("metric", trend(F.col("delta")).alias("trend"))


# ---------------------------------------------------------------- activity

_DAYS = lambda a, b: f"""SELECT date, coalesce(message_count, 0) AS message_count, coalesce(call_count, 0) AS call_count,
    CAST(coalesce(token_total, 0) AS BIGINT) AS token_total FROM
    (SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS date, count(*) AS message_count FROM v_message WHERE ts BETWEEN {a} AND {b} GROUP BY 1) m
    FULL JOIN (SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS date, count(*) AS call_count, sum(total_tokens) AS token_total
               FROM v_call WHERE ts BETWEEN {a} AND {b} GROUP BY 1) c USING (date)"""


@query("activity_daily", _DAYS(S, E))
def _(spark, d):
    return activity.activity_daily(v.message(spark, d), v.model_call(spark, d), v.RANGE)


@query("activity_daily_from_rollup", "SELECT * FROM (" + _DAYS(0, 9_000_000_000_000) + ") WHERE date BETWEEN '1997-01-01' AND '1998-12-31'")
def _(spark, d):
    message, calls = v.message(spark, d), v.model_call(spark, d)
    return activity.activity_daily(message, calls, v.RANGE, rollup=upkeep.daily_activity_rollup(message, calls))


@query("activity_daily_from_half_rollup", "SELECT * FROM (" + _DAYS(0, 9_000_000_000_000) + ") WHERE date BETWEEN '1997-01-01' AND '1998-12-31'")
def _(spark, d):
    message, calls = v.message(spark, d), v.model_call(spark, d)
    half = upkeep.daily_activity_rollup(message, calls).filter("date like '%-_0' or date like '%-_3' or date < '1997-06-01'")
    return activity.activity_daily(message, calls, v.RANGE, rollup=half)


def _activity_totals(a, b, side):
    return f"""SELECT 'messages' AS metric, CAST(sum(message_count) AS BIGINT) AS n, '{side}' AS side FROM ({_DAYS(a, b)})
        UNION ALL SELECT 'calls', CAST(sum(call_count) AS BIGINT), '{side}' FROM ({_DAYS(a, b)})
        UNION ALL SELECT 'tokens', CAST(sum(token_total) AS BIGINT), '{side}' FROM ({_DAYS(a, b)})
        UNION ALL SELECT 'active_days', count(*), '{side}' FROM ({_DAYS(a, b)})
        UNION ALL SELECT 'sessions', (SELECT count(*) FROM v_session WHERE ts BETWEEN {a} AND {b}), '{side}'"""


@query("activity_summary", f"""SELECT metric, max(CASE WHEN side = 'v' THEN n END) AS value, max(CASE WHEN side = 'p' THEN n END) AS previous
    FROM ({_activity_totals(S, E, 'v')} UNION ALL {_activity_totals(YEAR_BEFORE.start, YEAR_BEFORE.end, 'p')}) GROUP BY metric""")
def _(spark, d):
    message, calls, session = v.message(spark, d), v.model_call(spark, d), v.session(spark, d)
    return activity.activity_summary(activity.activity_daily(message, calls, v.RANGE), session, v.RANGE,
                                     activity.activity_daily(message, calls, YEAR_BEFORE), YEAR_BEFORE)


@query("activity_heatmap", f"""SELECT strftime(g.day, '%Y-%m-%d') AS date, coalesce(a.token_total, 0) AS value,
    CAST(CASE WHEN coalesce(a.token_total, 0) <= 0 OR t.top = 0 THEN 0
         ELSE least(4, greatest(1, ceil(a.token_total / t.top * 4))) END AS INTEGER) AS level, year(g.day) = 1998 AS in_year
    FROM (SELECT unnest(generate_series(DATE '1997-12-28', DATE '1998-12-31', INTERVAL 1 DAY)) AS day) g
    LEFT JOIN ({_DAYS(S, E)}) a ON a.date = strftime(g.day, '%Y-%m-%d'), (SELECT max(token_total) AS top FROM ({_DAYS(S, E)})) t""")
def _(spark, d):
    return activity.activity_heatmap(activity.activity_daily(v.message(spark, d), v.model_call(spark, d), v.RANGE), 1998)


# ---------------------------------------------------------------- sessions

_SESSION_COLUMNS = """coalesce(m.n, 0) AS message_count, coalesce(c.n, 0) AS model_call_count, coalesce(t.n, 0) AS tool_call_count,
    CAST(coalesce(c.i, 0) AS BIGINT) AS input_tokens, CAST(coalesce(c.ca, 0) AS BIGINT) AS cached_input_tokens,
    CAST(coalesce(c.o, 0) AS BIGINT) AS output_tokens, CAST(coalesce(c.r, 0) AS BIGINT) AS reasoning_tokens,
    CAST(coalesce(c.tt, 0) AS BIGINT) AS total_tokens, CASE WHEN c.i > 0 THEN c.ca / c.i ELSE 0 END AS cache_hit_rate,
    coalesce(c.dur, 0) AS avg_model_duration_ms, coalesce(t.dur, 0) AS avg_tool_duration_ms,
    CASE WHEN t.n > 0 THEN t.ok / t.n ELSE 0 END AS success_rate"""
_CALLS_OF = lambda where: f"""(SELECT session_id, count(*) AS n, sum(input_tokens) AS i, sum(cached_input_tokens) AS ca, sum(output_tokens) AS o,
    sum(reasoning_tokens) AS r, sum(total_tokens) AS tt, avg(duration_ms) AS dur, min(ts) AS a, max(ts) AS b FROM v_call {where} GROUP BY 1)"""
_OK = "CASE WHEN status IN ('ok', 'unknown') OR exit_code = 0 THEN 1 ELSE 0 END"
_SESSIONS = f"""SELECT s.id, s.ts, s.cwd, s.originator, s.cli_version, s.model_provider, s.git_branch, s.git_commit, {_SESSION_COLUMNS},
    greatest(c.b, m.b, t.b) - least(c.a, m.a, t.a) AS duration_ms FROM v_session s
    LEFT JOIN (SELECT session_id, count(*) AS n, min(ts) AS a, max(ts) AS b FROM v_message GROUP BY 1) m ON m.session_id = s.id
    LEFT JOIN {_CALLS_OF('')} c ON c.session_id = s.id
    LEFT JOIN (SELECT session_id, count(*) AS n, sum({_OK}) AS ok, avg(duration_ms) AS dur, min(start_ts) AS a,
        max(coalesce(end_ts, start_ts)) AS b FROM v_tool WHERE session_id IS NOT NULL GROUP BY 1) t ON t.session_id = s.id"""


@query("sessions_list", f"{_SESSIONS} WHERE s.ts BETWEEN {S} AND {E}")
def _(spark, d):
    return sessions.sessions_list(v.session(spark, d), v.message(spark, d), v.model_call(spark, d), v.tool_call(spark, d),
                                  SessionFilters(v.RANGE), part=None)


@query("sessions_page", f"""{_SESSIONS} WHERE s.ts BETWEEN {S} AND {E} AND (s.cwd ILIKE '%REPO_%' OR s.originator ILIKE '%REPO_%')
    AND s.model_provider IN ('1-URGENT', '2-HIGH') AND s.originator = 'ide'
    AND EXISTS (SELECT 1 FROM v_call x WHERE x.session_id = s.id AND x.model IN ('gpt-5'))
    ORDER BY s.ts DESC, s.id LIMIT 40 OFFSET 20""")
def _(spark, d):
    wanted = SessionFilters(v.RANGE, search="REPO_", models=("gpt-5",), providers=("1-URGENT", "2-HIGH"), originator="ide")
    return sessions.sessions_list(v.session(spark, d), v.message(spark, d), v.model_call(spark, d), v.tool_call(spark, d),
                                  wanted, Page(40, 20))


@query("sessions_total", f"SELECT count(*) AS total FROM v_session WHERE ts BETWEEN {S} AND {E} AND git_branch = 'O' AND cli_version = '0.3'")
def _(spark, d):
    return total(sessions.matching_sessions(v.session(spark, d), v.model_call(spark, d),
                                            SessionFilters(v.RANGE, branch="O", cli_version="0.3")))


@query("session_stats", f"""SELECT s.id, {_SESSION_COLUMNS}, greatest(c.b, t.b) - least(c.a, t.a) AS duration_ms FROM v_session s
    LEFT JOIN (SELECT session_id, count(*) AS n FROM v_message GROUP BY 1) m ON m.session_id = s.id
    LEFT JOIN {_CALLS_OF('')} c ON c.session_id = s.id
    LEFT JOIN (SELECT w.id, count(*) AS n, sum({_OK}) AS ok, avg(coalesce(duration_ms, end_ts - start_ts)) AS dur, min(start_ts) AS a,
        max(coalesce(end_ts, start_ts)) AS b FROM w JOIN v_tool ON v_tool.session_id = w.id
            OR (v_tool.session_id IS NULL AND v_tool.start_ts BETWEEN w.lo AND w.hi) GROUP BY 1) t ON t.id = s.id""",
       {"w": f"""SELECT s.id, least(s.ts, coalesce(c.a, s.ts)) - 86400000 AS lo,
        CASE WHEN c.b IS NULL THEN s.ts + 86400000 ELSE greatest(s.ts, c.b) END + 3600000 AS hi
        FROM v_session s LEFT JOIN {_CALLS_OF('')} c ON c.session_id = s.id"""})
def _(spark, d):
    return sessions.session_stats(v.session(spark, d), v.message(spark, d), v.model_call(spark, d), v.tool_call(spark, d))


@query("session_messages", "SELECT id, ts, role, content FROM v_message WHERE session_id = '7' ORDER BY ts, id LIMIT 50")
def _(spark, d):
    return sessions.session_items("7", "messages", v.session(spark, d), v.message(spark, d), v.model_call(spark, d), v.tool_call(spark, d), part=Page())


@query("session_model_calls", """SELECT id, ts, model, input_tokens, cached_input_tokens, output_tokens, reasoning_tokens, total_tokens,
    coalesce(duration_ms, CASE WHEN nxt > ts THEN nxt - ts END) AS duration_ms FROM
    (SELECT *, lead(ts) OVER (ORDER BY ts, id) AS nxt FROM v_call WHERE session_id = '7') ORDER BY ts, id LIMIT 50""")
def _(spark, d):
    return sessions.session_items("7", "model_calls", v.session(spark, d), v.message(spark, d), v.model_call(spark, d), v.tool_call(spark, d), part=Page())


@query("session_tool_calls", f"""SELECT id, tool_name, command, status, start_ts, end_ts, coalesce(duration_ms, end_ts - start_ts) AS duration_ms,
    exit_code, error, stdout_bytes, stderr_bytes, correlation_key FROM v_tool, w
    WHERE session_id = '7' OR (session_id IS NULL AND start_ts BETWEEN lo AND hi) ORDER BY start_ts, id LIMIT 100 OFFSET 5""",
       {"w": """SELECT least(min(s.ts), coalesce(min(c.ts), min(s.ts))) - 86400000 AS lo,
            CASE WHEN max(c.ts) IS NULL THEN min(s.ts) + 86400000 ELSE greatest(max(s.ts), max(c.ts)) END + 3600000 AS hi
            FROM v_session s LEFT JOIN v_call c ON c.session_id = s.id WHERE s.id = '7'"""})
def _(spark, d):
    return sessions.session_items("7", "tool_calls", v.session(spark, d), v.message(spark, d), v.model_call(spark, d),
                                  v.tool_call(spark, d), part=Page(100, 5))


@query("session_medians", """SELECT date, coalesce(median(calls), 0) AS median_calls, coalesce(median(tokens), 0) AS median_tokens,
    round(coalesce(median(cost), 0), 10) AS median_cost, coalesce(median(duration), 0) AS median_duration FROM f GROUP BY date
    UNION ALL SELECT NULL, median(calls), median(tokens), round(median(cost), 10), coalesce(median(duration), 0) FROM f""",
       {"f": f"""SELECT strftime(make_timestamp(s.ts * 1000), '%Y-%m-%d') AS date, CAST(coalesce(c.n, 0) AS DOUBLE) AS calls,
        CAST(coalesce(c.t, 0) AS DOUBLE) AS tokens, coalesce(k.cost, 0) AS cost, CAST(c.b - c.a AS DOUBLE) AS duration
        FROM v_session s LEFT JOIN (SELECT session_id, count(*) AS n, sum(total_tokens) AS t, min(ts) AS a, max(ts) AS b FROM v_call GROUP BY 1) c
            ON c.session_id = s.id
        LEFT JOIN (SELECT session_id, sum(cost) AS cost FROM v_cost WHERE ts BETWEEN {S} AND {E} GROUP BY 1) k ON k.session_id = s.id
        WHERE s.ts BETWEEN {S} AND {E}"""})
def _(spark, d):
    return sessions.session_medians(v.session(spark, d), v.model_call(spark, d), v.price(spark), v.RANGE)


@query("effective_durations", """SELECT id, session_id, ts, coalesce(duration_ms, CASE WHEN nxt > ts THEN nxt - ts END) AS effective_ms
    FROM (SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, id) AS nxt FROM v_call)""")
def _(spark, d):
    return with_effective_duration(v.model_call(spark, d), ["session_id"], False).select("id", "session_id", "ts", "effective_ms")


# ---------------------------------------------------------------- models and providers

_MODELS = f"""SELECT coalesce(model, 'unknown') AS model, count(*) AS call_count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
    sum(cached_input_tokens) / sum(input_tokens) AS cache_hit_rate, coalesce(avg(eff), 0) AS avg_duration_ms,
    round(greatest(0, sum(input_tokens) - sum(cached_input_tokens)) * max(pi) + sum(cached_input_tokens) * max(pc)
        + sum(output_tokens + reasoning_tokens) * max(po), 10) AS estimated_cost
    FROM (SELECT *, coalesce(duration_ms, CASE WHEN nxt > ts THEN nxt - ts END) AS eff FROM
        (SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, id) AS nxt FROM v_cost WHERE ts BETWEEN {S} AND {E})) GROUP BY 1"""


@query("models_list", _MODELS)
def _(spark, d):
    return models.models_list(v.model_call(spark, d), v.price(spark), v.RANGE)


@query("models_totals", f"""SELECT CAST(sum(call_count) AS BIGINT) AS total_calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
    round(sum(estimated_cost), 10) AS total_cost, round(sum(avg_duration_ms * call_count) / sum(call_count), 3) AS avg_duration_ms FROM ({_MODELS})""")
def _(spark, d):
    return models.models_totals(v.model_call(spark, d), v.price(spark), v.RANGE).withColumn(
        "avg_duration_ms", F.round("avg_duration_ms", 3))


@query("top_models_by_cost", f"SELECT model, estimated_cost FROM ({_MODELS}) ORDER BY estimated_cost DESC NULLS LAST, model LIMIT 3")
def _(spark, d):
    return top_k(models.models_list(v.model_call(spark, d), v.price(spark), v.RANGE, part=None)
                 .select("model", "estimated_cost"), "estimated_cost", "model", 3)


_PROVIDERS = """SELECT coalesce(s.model_provider, 'unknown') AS provider, count(DISTINCT s.id) AS session_count, count(c.id) AS model_call_count,
    CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(cached_input_tokens), 0) AS BIGINT) AS cached_input_tokens,
    CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(reasoning_tokens), 0) AS BIGINT) AS reasoning_tokens,
    CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, coalesce(avg(duration_ms), 0) AS avg_model_duration_ms,
    CASE WHEN sum(input_tokens) > 0 THEN sum(cached_input_tokens) / sum(input_tokens) ELSE 0 END AS cache_hit_rate
    FROM v_session s LEFT JOIN v_call c ON c.session_id = s.id {where} GROUP BY 1"""


@query("providers_list", _PROVIDERS.format(where=f"WHERE c.ts BETWEEN {S} AND {E}"))
def _(spark, d):
    return models.providers_list(v.session(spark, d), v.model_call(spark, d), v.RANGE)


@query("providers_list_all_time", _PROVIDERS.format(where=""))
def _(spark, d):
    return models.providers_list(v.session(spark, d), v.model_call(spark, d), DateRange())


# ---------------------------------------------------------------- projects

_PROJECT_VIEWS = {
    "used": f"SELECT * FROM v_merge WHERE id IN (SELECT project_id FROM v_session WHERE project_id IS NOT NULL AND ts BETWEEN {S} AND {E})",
    "g1": """SELECT merge_key, arg_min(canonical, rn) AS entity, arg_min(rn, rn) AS best FROM (SELECT *, row_number() OVER (
        ORDER BY (git_remote IS NOT NULL) DESC, last_seen_ts DESC NULLS LAST, id) AS rn FROM used) GROUP BY merge_key""",
    "member": "SELECT u.*, g1.entity FROM used u JOIN g1 USING (merge_key)",
    "shown": """SELECT * FROM (SELECT m.entity, m.name, m.root_path, m.git_remote, row_number() OVER (PARTITION BY m.entity
        ORDER BY (git_remote IS NOT NULL) DESC, last_seen_ts DESC NULLS LAST, id) AS rn FROM member m) WHERE rn = 1""",
    "pc": f"""SELECT entity, sum(n) AS calls, sum(t) AS t, sum(i) AS i, sum(c) AS c, sum(greatest(0, i - c) * pi + c * pc + o * po) AS cost FROM
        (SELECT m.entity, s.project_id, c.model, count(*) AS n, sum(total_tokens) AS t, sum(input_tokens) AS i, sum(cached_input_tokens) AS c,
            sum(output_tokens + reasoning_tokens) AS o FROM v_call c JOIN v_session s ON s.id = c.session_id JOIN member m ON m.id = s.project_id
            WHERE c.ts BETWEEN {S} AND {E} GROUP BY ALL) LEFT JOIN v_price USING (model) GROUP BY entity""",
    "pt": f"""SELECT m.entity, count(*) AS n, sum({_OK}) AS ok FROM v_tool t JOIN v_session s ON s.id = t.session_id JOIN member m ON m.id = s.project_id
        WHERE t.start_ts BETWEEN {S} AND {E} GROUP BY 1""",
    "ps": f"SELECT m.entity, count(*) AS n FROM v_session s JOIN member m ON m.id = s.project_id WHERE s.ts BETWEEN {S} AND {E} GROUP BY 1",
    "plist": """SELECT min(m.id) AS id, any_value(sh.name) AS name, CASE WHEN count(*) = 1 THEN any_value(sh.root_path) END AS root_path,
        any_value(sh.git_remote) AS git_remote, min(m.first_seen_ts) AS first_seen_ts, max(m.last_seen_ts) AS last_seen_ts,
        CAST(any_value(ps.n) AS BIGINT) AS session_count, CAST(coalesce(any_value(pc.calls), 0) AS BIGINT) AS model_call_count,
        CAST(coalesce(any_value(pt.n), 0) AS BIGINT) AS tool_call_count, CAST(coalesce(any_value(pc.t), 0) AS BIGINT) AS total_tokens,
        CASE WHEN any_value(pc.i) > 0 THEN any_value(pc.c) / any_value(pc.i) ELSE 0 END AS cache_hit_rate,
        round(coalesce(any_value(pc.cost), 0), 10) AS estimated_cost,
        CASE WHEN any_value(pt.n) > 0 THEN any_value(pt.ok) / any_value(pt.n) ELSE 0 END AS tool_success_rate
        FROM member m JOIN shown sh USING (entity) LEFT JOIN ps USING (entity) LEFT JOIN pc USING (entity) LEFT JOIN pt USING (entity) GROUP BY entity""",
}


def _all(spark, d):
    return (v.project(spark, d), v.session(spark, d), v.model_call(spark, d), v.tool_call(spark, d), v.price(spark))


@query("projects_list", "SELECT * FROM plist", _PROJECT_VIEWS)
def _(spark, d):
    return projects.projects_list(*_all(spark, d), v.RANGE, part=None)


@query("projects_page_by_tokens", """SELECT * FROM plist ORDER BY total_tokens DESC, id LIMIT 7 OFFSET 3""",
       {**_PROJECT_VIEWS, "used": _PROJECT_VIEWS["used"] + " AND (name ILIKE '%repo1%' OR root_path ILIKE '%repo1%' OR git_remote ILIKE '%repo1%')"})
def _(spark, d):
    return projects.projects_list(*_all(spark, d), v.RANGE, search=" REPO1", sort_by="total_tokens", part=Page(7, 3))


@query("projects_totals", f"""SELECT 'total_projects' AS metric, CAST(count(*) AS DOUBLE) AS value FROM plist
    UNION ALL SELECT 'distinct_project_ids', count(DISTINCT project_id) FROM v_session WHERE project_id IS NOT NULL AND ts BETWEEN {S} AND {E}
    UNION ALL SELECT 'total_sessions', count(*) FROM v_session WHERE project_id IS NOT NULL AND ts BETWEEN {S} AND {E}
    UNION ALL SELECT 'total_tokens', sum(total_tokens) FROM v_call c JOIN v_session s ON s.id = c.session_id WHERE s.project_id IS NOT NULL AND c.ts BETWEEN {S} AND {E}
    UNION ALL SELECT 'total_cost', round(sum(greatest(0, i - c) * pi + c * pc + o * po), 10) FROM (SELECT model, sum(input_tokens) AS i, sum(cached_input_tokens) AS c,
        sum(output_tokens + reasoning_tokens) AS o FROM v_call c JOIN v_session s ON s.id = c.session_id WHERE s.project_id IS NOT NULL AND c.ts BETWEEN {S} AND {E} GROUP BY 1)
        JOIN v_price USING (model)
    UNION ALL SELECT 'avg_success_rate', sum({_OK}) / count(*) FROM v_tool t JOIN v_session s ON s.id = t.session_id
        WHERE s.project_id IS NOT NULL AND t.start_ts BETWEEN {S} AND {E}""", _PROJECT_VIEWS)
def _(spark, d):
    return projects.projects_totals(*_all(spark, d), v.RANGE)


@query("project_entities", """SELECT u.id AS project_id, g1.entity FROM v_merge u JOIN g1 USING (merge_key)""",
       {"used": "SELECT * FROM v_merge", "g1": _PROJECT_VIEWS["g1"]})
def _(spark, d):
    return projects.merge_entities(v.project(spark, d))[0]


_GROUP = "SELECT * FROM v_merge WHERE canonical = (SELECT canonical FROM v_merge WHERE id = '17')"


@query("project_group", "SELECT id, name, git_remote FROM grp", {"grp": _GROUP})
def _(spark, d):
    return projects.project_group(v.project(spark, d), "17").select("id", "name", "git_remote")


@query("project_branches", f"""SELECT pr.id, pr.branch, coalesce(pr."commit", max(s.git_commit)) AS "commit", count(s.id) AS session_count
    FROM v_ref pr LEFT JOIN v_session s ON (s.project_ref_id = pr.id OR (s.project_ref_id IS NULL AND s.project_id = pr.project_id
        AND (pr.branch IS NULL OR s.git_branch = pr.branch))) AND s.ts BETWEEN {S} AND {E} GROUP BY pr.id, pr.branch, pr."commit" """)
def _(spark, d):
    everything = v.project(spark, d)
    return projects.project_branches(everything, v.project_ref(spark, d), v.session(spark, d), v.RANGE)


@query("project_models", f"""SELECT coalesce(nullif(model, ''), 'Unknown') AS model, CAST(t AS BIGINT) AS tokens,
    round(coalesce(greatest(0, i - c) * pi + c * pc + o * po, 0), 10) AS cost FROM (SELECT model, sum(total_tokens) AS t, sum(input_tokens) AS i,
    sum(cached_input_tokens) AS c, sum(output_tokens + reasoning_tokens) AS o FROM v_call c JOIN v_session s ON s.id = c.session_id
    WHERE s.project_id IN (SELECT id FROM grp) AND c.ts BETWEEN {S} AND {E} GROUP BY 1) LEFT JOIN v_price USING (model)""", {"grp": _GROUP})
def _(spark, d):
    group = projects.project_group(v.project(spark, d), "17")
    return projects.project_models(group, v.session(spark, d), v.model_call(spark, d), v.price(spark), v.RANGE)


@query("project_history", f"""SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS date, count(*) AS session_count FROM v_session
    WHERE project_id IN (SELECT id FROM grp) AND ts BETWEEN {S} AND {E} GROUP BY 1""", {"grp": _GROUP})
def _(spark, d):
    return projects.project_history(projects.project_group(v.project(spark, d), "17"), v.session(spark, d), v.RANGE)


@query("project_header", f"""SELECT '17' AS id, h.name, CASE WHEN g.n = 1 THEN h.root_path END AS root_path, h.git_remote, g.first_seen_ts, g.last_seen_ts,
    (SELECT count(*) FROM mine WHERE ts BETWEEN {S} AND {E}) AS session_count, u.n AS model_call_count, t.n AS tool_call_count,
    CAST(u.t AS BIGINT) AS total_tokens, (u.c / u.i) AS cache_hit_rate, round(k.cost, 10) AS estimated_cost,
    CASE WHEN t.n > 0 THEN t.ok / t.n ELSE 0 END AS tool_success_rate
    FROM (SELECT * FROM grp ORDER BY (git_remote IS NOT NULL) DESC, last_seen_ts DESC NULLS LAST, id LIMIT 1) h,
    (SELECT count(*) AS n, min(first_seen_ts) AS first_seen_ts, max(last_seen_ts) AS last_seen_ts FROM grp) g,
    (SELECT count(*) AS n, sum(total_tokens) AS t, sum(input_tokens) AS i, sum(cached_input_tokens) AS c FROM v_call
        WHERE session_id IN (SELECT id FROM mine) AND ts BETWEEN {S} AND {E}) u,
    (SELECT sum(greatest(0, i - c) * pi + c * pc + o * po) AS cost FROM (SELECT model, sum(input_tokens) AS i, sum(cached_input_tokens) AS c,
        sum(output_tokens + reasoning_tokens) AS o FROM v_call WHERE session_id IN (SELECT id FROM mine) AND ts BETWEEN {S} AND {E} GROUP BY 1)
        JOIN v_price USING (model)) k,
    (SELECT count(*) AS n, sum({_OK}) AS ok FROM v_tool WHERE session_id IN (SELECT id FROM mine) AND start_ts BETWEEN {S} AND {E}) t""",
       {"grp": _GROUP, "mine": "SELECT * FROM v_session WHERE project_id IN (SELECT id FROM grp)"})
def _(spark, d):
    group = projects.project_group(v.project(spark, d), "17")
    return projects.project_header("17", group, v.session(spark, d), v.model_call(spark, d), v.tool_call(spark, d), v.price(spark), v.RANGE)


# ---------------------------------------------------------------- tool calls

_TOOL_FILTERS = ToolFilters(v.JUNE, status=("failed", "ok"), tools=("error", "purchase"), search="RUN ", max_duration_ms=20_000)
_TOOL_WHERE = "status IN ('failed', 'ok') AND tool_name IN ('error', 'purchase') AND command ILIKE '%run %' AND duration_ms <= 20000"
_TOOL_COLUMNS = """id, session_id, tool_name, command, status, start_ts, end_ts, duration_ms, exit_code, error, stdout_bytes,
    stderr_bytes, correlation_key"""
_FAILED = "status = 'failed' OR (exit_code IS NOT NULL AND exit_code <> 0)"


@query("tool_calls_list", f"SELECT {_TOOL_COLUMNS} FROM v_tool WHERE {_TOOL_WHERE} AND start_ts BETWEEN {JS} AND {JE}")
def _(spark, d):
    return tools.tool_calls_list(v.tool_call(spark, d), wanted=_TOOL_FILTERS, part=None)


@query("tool_calls_page", f"""SELECT {_TOOL_COLUMNS} FROM v_tool WHERE start_ts BETWEEN {JS} AND {JE} AND exit_code = 1 AND error <> ''
    AND session_id IN (SELECT id FROM v_session WHERE project_id IS NOT NULL AND id = '8') ORDER BY start_ts DESC, id LIMIT 5""")
def _(spark, d):
    return tools.tool_calls_list(v.tool_call(spark, d), v.session(spark, d).filter("project_id is not null"),
                                 ToolFilters(v.JUNE, session_id="8", exit_code=1, has_error=True), Page(5))


@query("tool_calls_of_project", f"""SELECT {_TOOL_COLUMNS} FROM v_tool WHERE
    session_id IN (SELECT id FROM v_session WHERE project_id = (SELECT min(project_id) FROM v_session WHERE id = '8')) AND duration_ms >= 100""")
def _(spark, d):
    held = v.session(spark, d)
    same = held.join(held.filter("id = '8'").select("project_id"), "project_id", "left_semi").withColumn("project_id", F.lit("p"))
    return tools.tool_calls_list(v.tool_call(spark, d), same, ToolFilters(min_duration_ms=100, project="p"), part=None)


_TOOL_SUMMARY = lambda p, q: f"""{p}total, CAST({p}ok AS BIGINT) AS {p}ok, CAST({p}failed AS BIGINT) AS {p}failed, CAST({p}unknown AS BIGINT) AS {p}unknown,
    ({p}dur) AS {p}avg_duration_ms, CASE WHEN {p}total > 0 THEN {p}ok / {p}total ELSE 0 END AS {p}success_rate"""
_TOOL_TOTALS = lambda p, a, b: f"""(SELECT count(*) AS {p}total, coalesce(sum({_OK}), 0) AS {p}ok, coalesce(sum(CASE WHEN {_FAILED} THEN 1 ELSE 0 END), 0) AS {p}failed,
    coalesce(sum(CASE WHEN status = 'unknown' THEN 1 ELSE 0 END), 0) AS {p}unknown, coalesce(avg(duration_ms), 0) AS {p}dur
    FROM v_tool WHERE start_ts BETWEEN {a} AND {b} AND tool_name <> 'signup')"""


@query("tool_calls_summary", f"SELECT {_TOOL_SUMMARY('', 'c')}, {_TOOL_SUMMARY('prev_', 'p')} FROM {_TOOL_TOTALS('', JS, JE)}, {_TOOL_TOTALS('prev_', JP, JS - 1)}")
def _(spark, d):
    return tools.tool_calls_summary(v.tool_call(spark, d), wanted=ToolFilters(v.JUNE, tools=("view", "click", "purchase", "error")))


@query("tool_breakdown", f"""SELECT tool_name AS tool, count(*) AS count, coalesce(avg(duration_ms), 0) AS avg_duration_ms,
    sum({_OK}) / count(*) AS success_rate FROM v_tool WHERE start_ts BETWEEN {JS} AND {JE} GROUP BY 1 ORDER BY count DESC, tool LIMIT 20""")
def _(spark, d):
    return tools.tool_breakdown(v.tool_call(spark, d), wanted=ToolFilters(v.JUNE))


@query("failure_breakdown", f"""SELECT error, count(*) AS count, max(tool_name) AS tool FROM v_tool WHERE start_ts BETWEEN {JS} AND {JE} AND ({_FAILED})
    AND error <> '' GROUP BY 1 ORDER BY count DESC, error LIMIT 10""")
def _(spark, d):
    return tools.failure_breakdown(v.tool_call(spark, d), wanted=ToolFilters(v.JUNE))


@query("strict_success_rate", f"SELECT sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) / count(*) AS success_rate FROM v_tool WHERE start_ts BETWEEN {JS} AND {JE}")
def _(spark, d):
    return tools.strict_success_rate(v.tool_call(spark, d), v.JUNE)


@query("avg_tool_duration", "SELECT avg(duration_ms) AS avg_duration_ms FROM v_tool")
def _(spark, d):
    return tools.avg_tool_duration(v.tool_call(spark, d))


@query("calls_by_status", "SELECT s.status, count(t.id) AS count FROM (VALUES ('ok'), ('failed'), ('unknown')) s(status) LEFT JOIN v_tool t USING (status) GROUP BY 1")
def _(spark, d):
    return tools.calls_by_status(v.tool_call(spark, d))


@query("top_failing_commands", """SELECT command, count(*) AS fail_count, arg_max_null(error, start_ts) AS last_error FROM v_tool
    WHERE status = 'failed' AND command IS NOT NULL GROUP BY command ORDER BY fail_count DESC, max(start_ts) DESC, command LIMIT 15""")
def _(spark, d):
    return tools.top_failing_commands(v.tool_call(spark, d), 15)


@query("top_tools_by_count", "SELECT tool_name AS tool, count(*) AS count FROM v_tool GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, d):
    return top_k(tools.tool_breakdown(v.tool_call(spark, d), k=None).select("tool", "count"), "count", "tool", 3)


# ---------------------------------------------------------------- worktrees and automations

def _balance_sql(view: str, up: str, down: str, names: dict[str, str], out: str, start: int, end: int) -> str:
    """Day-by-day balance as a recursive query, from the net of all earlier events."""
    counts = ", ".join(f"CAST(sum(CASE WHEN action IN ({v}) THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, v in names.items())
    cols = ", ".join(names)
    next_cols = ", ".join(f"y.{n}" for n in names)
    return f"""WITH RECURSIVE y AS (SELECT row_number() OVER (ORDER BY date) AS i, * FROM (SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS date, {counts}
            FROM {view} WHERE ts BETWEEN {start} AND {end} GROUP BY 1)),
        base AS (SELECT CAST(coalesce(sum(CASE WHEN action IN ({names[up]}) THEN 1 WHEN action IN ({names[down]}) THEN -1 ELSE 0 END), 0) AS BIGINT) AS b
            FROM {view} WHERE ts < {start}),
        r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS date, {", ".join("CAST(0 AS BIGINT) AS " + n for n in names)}, b AS {out} FROM base
            UNION ALL SELECT y.i, y.date, {next_cols}, greatest(0, r.{out} + y.{up} - y.{down}) FROM r JOIN y ON y.i = r.i + 1)
        SELECT date, {cols}, {out} FROM r WHERE i > 0"""


_WT = {"created": "'created'", "deleted": "'deleted', 'archived'", "errors": "'error'"}
_AU = {"queued": "'queued'", "completed": "'completed'", "failed": "'failed'"}


def _event_totals(view, names):
    counts = ", ".join(f"coalesce(sum(CASE WHEN action IN ({v}) THEN 1 ELSE 0 END), 0) AS {n}" for n, v in names.items())
    return (f"SELECT q.period, {counts} FROM (VALUES ('c'), ('p')) q(period) LEFT JOIN (SELECT *, {_period('ts', JS)} AS period FROM {view} "
            f"WHERE ts BETWEEN {JP} AND {JE}) x ON x.period = q.period GROUP BY 1")


_NET = "coalesce((SELECT sum(CASE WHEN action IN ({u}) THEN 1 WHEN action IN ({d}) THEN -1 ELSE 0 END) FROM {v} WHERE ts < {t}), 0)"


@query("worktree_kpis", _kpis({"created": "created", "deleted": "deleted", "errors": "errors", "active": "active",
                               "failure_rate": "CASE WHEN created > 0 THEN errors / created ELSE @ END"}, "z"),
       {"k": _event_totals("v_worktree", _WT),
        "z": f"""SELECT *, greatest(0, created - deleted + CASE period WHEN 'c' THEN {_NET.format(u=_WT['created'], d=_WT['deleted'], v='v_worktree', t=JS)}
            ELSE {_NET.format(u=_WT['created'], d=_WT['deleted'], v='v_worktree', t=JP)} END) AS active FROM k"""})
def _(spark, d):
    return balances.worktree_kpis(v.worktree_event(spark, d), v.JUNE)


@query("worktree_daily", "SELECT * FROM z", {"z": _balance_sql("v_worktree", "created", "deleted", _WT, "active", JS, JE)})
def _(spark, d):
    return balances.worktree_daily(v.worktree_event(spark, d), v.JUNE)


@query("worktree_daily_with_inventory", """SELECT date, created, deleted, errors, CASE WHEN date = '1997-06-15' THEN 42 ELSE active END AS active FROM z""",
       {"z": _balance_sql("v_worktree", "created", "deleted", _WT, "active", JS, JE)})
def _(spark, d):
    return balances.worktree_daily(v.worktree_event(spark, d), v.JUNE, inventory_count=42, today="1997-06-15")


@query("worktree_daily_before_today", "SELECT * FROM z", {"z": _balance_sql("v_worktree", "created", "deleted", _WT, "active", JS, JE)})
def _(spark, d):
    # Today lies behind the range, so the inventory says nothing about it.
    return balances.worktree_daily(v.worktree_event(spark, d), v.JUNE, inventory_count=42, today="1997-07-15")


@query("worktree_list", f"""SELECT id, ts, action, worktree_path, repo_root, branch, status, error FROM v_worktree WHERE ts BETWEEN {JS} AND {JE}
    AND (worktree_path ILIKE '%U1_/W%' OR branch ILIKE '%U1_/W%' OR error ILIKE '%U1_/W%')""")
def _(spark, d):
    return balances.worktree_list(v.worktree_event(spark, d), v.JUNE, search="U1_/W", part=None)


@query("automation_kpis", _kpis({"queued": "queued", "completed": "completed", "failed": "failed", "backlog_peak": "peak",
                                 "failure_rate": "CASE WHEN completed + failed > 0 THEN failed / (completed + failed) ELSE @ END"}, "z"),
       {"k": _event_totals("v_automation", _AU), "cur": _balance_sql("v_automation", "queued", "completed", _AU, "backlog", JS, JE),
        "prv": _balance_sql("v_automation", "queued", "completed", _AU, "backlog", JP, JS - 1),
        "z": f"""SELECT *, CASE period WHEN 'c' THEN greatest((SELECT max(backlog) FROM cur), {_NET.format(u=_AU['queued'], d=_AU['completed'], v='v_automation', t=JS)})
            ELSE greatest((SELECT max(backlog) FROM prv), {_NET.format(u=_AU['queued'], d=_AU['completed'], v='v_automation', t=JP)}) END AS peak FROM k"""})
def _(spark, d):
    return balances.automation_kpis(v.automation_event(spark, d), v.JUNE)


@query("automation_daily", "SELECT * FROM z", {"z": _balance_sql("v_automation", "queued", "completed", _AU, "backlog", JS, JE)})
def _(spark, d):
    return balances.automation_daily(v.automation_event(spark, d), v.JUNE)


@query("automation_page", """SELECT id, ts, action, thread_id, status, error FROM v_automation WHERE error ILIKE '%BOOM 1%'
    ORDER BY ts DESC, id LIMIT 25 OFFSET 25""")
def _(spark, d):
    return balances.automation_list(v.automation_event(spark, d), search="BOOM 1", part=Page(25, 25))


@query("balance_per_branch", """WITH RECURSIVE y AS (SELECT branch, date, delta, row_number() OVER (PARTITION BY branch ORDER BY date) AS i FROM (
        SELECT branch, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS date,
        CAST(sum(CASE WHEN action = 'created' THEN 1 WHEN action = 'error' THEN 0 ELSE -1 END) AS BIGINT) AS delta FROM v_worktree GROUP BY 1, 2)),
    r AS (SELECT branch, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS date, CAST(0 AS BIGINT) AS delta, CAST(0 AS BIGINT) AS active FROM y WHERE i = 1
        UNION ALL SELECT y.branch, y.i, y.date, y.delta, greatest(0, r.active + y.delta) FROM r JOIN y ON y.branch = r.branch AND y.i = r.i + 1)
    SELECT branch, date, delta, active FROM r WHERE i > 0""")
def _(spark, d):
    from ..functions.scalars import day_text
    events = v.worktree_event(spark, d)
    step = F.when(F.col("action") == "created", 1).when(F.col("action") == "error", 0).otherwise(-1)
    days = events.groupBy("branch", day_text(F.col("ts")).alias("date")).agg(F.sum(step).alias("delta"))
    return clamped_balance(days, ["branch"], "date", "delta", "active")


SQL["balance_per_branch"] = SQL["balance_per_branch"].replace(")\nWITH RECURSIVE ", "),\n")


@query("latest_worktree_action", """SELECT worktree_path, action, ts FROM (SELECT *, row_number() OVER (PARTITION BY worktree_path ORDER BY ts DESC, id) AS rn
    FROM v_worktree) WHERE rn = 1""")
def _(spark, d):
    return latest_per_key(v.worktree_event(spark, d), ["worktree_path"], "ts", "id").select("worktree_path", "action", "ts")


# ---------------------------------------------------------------- tables

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC, byte_offset DESC) AS rn FROM v_ledger) WHERE rn = 1"


def _ledger(spark, d):
    from ..sources.ledger import latest_ledger
    return latest_ledger(v.ingest_state(spark, d))


@query("ingest_files", "SELECT path, byte_offset, mtime_ms, updated_at FROM l WHERE path ILIKE '%/1%' ORDER BY updated_at DESC, path LIMIT 50", {"l": _LATEST})
def _(spark, d):
    return upkeep.ingest_files(_ledger(spark, d), search="/1", part=Page())


@query("ingest_summary", "SELECT count(*) AS total_files, max(updated_at) AS last_updated_at FROM l", {"l": _LATEST})
def _(spark, d):
    return upkeep.ingest_summary(_ledger(spark, d))


@query("last_sync", "SELECT max(updated_at) AS last_updated_at FROM v_ledger")
def _(spark, d):
    return upkeep.last_sync(v.ingest_state(spark, d))


@query("log_status", "SELECT count(*) > 0 AS has_logs, count(*) AS total FROM documents WHERE text <> ''")
def _(spark, d):
    return upkeep.log_status(v.table(spark, d, "documents").withColumnRenamed("text", "message"))


_CHECK = lambda name, view, ts: f"""SELECT '{name}' AS table_name, count(*) AS row_count, min({ts}) AS min_ts, max({ts}) AS max_ts,
    CAST(sum(CASE WHEN {ts} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_ts, CAST(sum(CASE WHEN {ts} < 1000000000000 THEN 1 ELSE 0 END) AS BIGINT) AS early_ts,
    CAST(0 AS BIGINT) AS future_ts FROM {view}"""


@query("data_checks", f"""SELECT *, CASE WHEN row_count = 0 THEN 'empty' WHEN early_ts > 0 OR future_ts > 0 THEN 'suspicious' ELSE 'ok' END AS verdict FROM (
    {_CHECK('session', 'v_session', 'ts')} UNION ALL {_CHECK('model_call', 'v_call', 'ts')} UNION ALL {_CHECK('tool_call', 'v_tool', 'start_ts')}
    UNION ALL {_CHECK('message', 'v_message', 'ts')})""")
def _(spark, d):
    return upkeep.data_checks({"session": v.session(spark, d), "model_call": v.model_call(spark, d),
                               "tool_call": v.tool_call(spark, d), "message": v.message(spark, d)}, v.NOW_MS)


@query("data_checks_missing", f"""SELECT *, CASE WHEN row_count = 0 THEN 'empty' WHEN early_ts > 0 OR future_ts > 0 THEN 'suspicious' ELSE 'ok' END AS verdict FROM (
    {_CHECK('session', 'v_session', 'ts')} UNION ALL {_CHECK('model_call', 'v_call', 'ts')}) UNION ALL SELECT name, NULL, NULL, NULL, NULL, NULL, NULL, 'missing'
    FROM (VALUES ('tool_call'), ('message')) q(name) UNION ALL SELECT 'daily_activity', count(DISTINCT date), NULL, NULL, NULL, NULL, NULL, 'ok' FROM ({_DAYS(0, 9_000_000_000_000)})""")
def _(spark, d):
    given = {"session": v.session(spark, d), "model_call": v.model_call(spark, d), "message": None,
             "daily_activity": upkeep.daily_activity_rollup(v.message(spark, d), v.model_call(spark, d))}
    return upkeep.data_checks(given, v.NOW_MS, upkeep.REQUIRED)


@query("daily_activity_rollup", _DAYS(0, 9_000_000_000_000))
def _(spark, d):
    return upkeep.daily_activity_rollup(v.message(spark, d), v.model_call(spark, d))


@query("worktree_rollup", "SELECT date, created AS created_count, deleted AS deleted_count, errors AS error_count, active AS active_count FROM z",
       {"z": _balance_sql("v_worktree", "created", "deleted", _WT, "active", 0, 9_000_000_000_000)})
def _(spark, d):
    return upkeep.worktree_rollup(v.worktree_event(spark, d))


@query("automation_rollup", "SELECT date, queued AS runs_queued, completed AS runs_completed, failed AS runs_failed, backlog AS backlog_peak FROM z",
       {"z": _balance_sql("v_automation", "queued", "completed", _AU, "backlog", 0, 9_000_000_000_000)})
def _(spark, d):
    return upkeep.automation_rollup(v.automation_event(spark, d))
