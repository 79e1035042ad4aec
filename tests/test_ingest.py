"""The ingest job, table store, streaming twins and price file."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sessionmeter import DateRange
from sessionmeter.ingest import IngestOptions, LogSources, backfill, ingest
from sessionmeter.operators import correlation as co
from sessionmeter.operators.pricing import with_price
from sessionmeter.plans.overview import overview_daily
from sessionmeter.plans.upkeep import stored_checks
from sessionmeter.sources.prices import price_table
from sessionmeter.sources.tables import Tables
from sessionmeter.streaming.correlation import correlate_stream
from sessionmeter.streaming.ingest import start_ingest
from tests.test_jsonl import DAY, write

TOOL_LOG = """2025-03-02 08:00:00.100 [info] FunctionCall: run {"cmd":"pwd"}
2025-03-02 08:00:00.300 [info] ToolCall: run {"status":"done","exit_code":0,"cmd":"pwd"}
"""


def session_file(n, calls=2):
    rows = [{"type": "session_meta", "id": f"s{n}", "ts": DAY + n, "cwd": f"/w/p{n % 2}"},
            {"type": "response_item", "item": {"role": "user", "content": "hi", "message_id": f"m{n}"}}]
    rows += [{"type": "event_msg", "payload": {"type": "token_count", "ts": DAY + n * 10 + i, "session_id": f"s{n}",
                                               "input_tokens": 5, "output_tokens": 1}} for i in range(calls)]
    return rows


def counts(tables, *names):
    return {n: tables.read(n).count() for n in names}


@pytest.fixture
def world(spark, tmp_path):
    logs = tmp_path / "logs"
    write(logs / "a.jsonl", session_file(1))
    write(logs / "b.jsonl", session_file(2) + ["oops", {"type": "response_item", "session_id": "nobody", "item": {"role": "user"}}])
    (tmp_path / "tool.log").write_text(TOOL_LOG)
    desk = tmp_path / "desk"
    desk.mkdir()
    (desk / "x-desktop-ab-1-t2-i3-000000-4.log").write_text(
        "2025-05-01T10:00:00.000Z info [git] created worktree /a/b\n2025-05-01T10:00:01.000Z info Automation queued\n")
    sources = LogSources(str(logs), str(tmp_path / "tool.log"), (str(desk),),
                         inventory=spark.createDataFrame([("/elsewhere",)], "path string"))
    return {"tables": Tables(spark, str(tmp_path / "tables")), "sources": sources, "logs": logs, "tmp": tmp_path}


def test_ingest_then_nothing_new_then_growth(world):
    tables, sources = world["tables"], world["sources"]
    assert {r.verdict for r in stored_checks(tables, 1_746_200_000_000).collect()} == {"missing"}
    report = ingest(tables, sources, 1_746_200_000_000).first()
    assert (report.files_processed, report.errors) == (4, 2) and 0 < report.duration_ms < 600_000
    checks = {r.table_name: (r.row_count, r.verdict) for r in stored_checks(tables, 1_746_200_000_000).collect()}
    assert checks.keys() == {"session", "model_call", "tool_call", "message", "daily_activity"}
    assert checks["session"] == (2, "ok") and checks["daily_activity"] == (tables.read("daily_activity").count(), "ok")
    want = {"session": 2, "message": 2, "model_call": 4, "tool_call": 1, "tool_call_event": 2, "project": 2,
            "desktop_log_event": 2, "worktree_event": 2, "automation_event": 1, "reject": 2, "ingest_state": 4}
    assert counts(tables, *want) == want
    assert {r.action for r in tables.read("worktree_event").collect()} == {"created", "archived"}

    again = ingest(tables, sources, 1_746_200_000_001).first()
    assert (again.files_processed, again.lines_ingested, again.errors) == (0, 0, 0)

    with open(world["logs"] / "a.jsonl", "a") as out:
        out.write(json.dumps({"type": "event_msg", "payload": {"type": "token_count", "ts": DAY + 77, "session_id": "s1"}}) + "\n")
        out.write(json.dumps({"type": "response_item", "item": {"role": "user", "message_id": "m2"}, "session_id": "s1"}) + "\n")
    more = ingest(tables, sources, 1_746_200_000_002).first()
    # The message repeats another's native id and is rejected.
    assert (more.files_processed, more.lines_ingested, more.errors) == (1, 2, 1)
    assert counts(tables, "model_call", "message", "session") == {"model_call": 5, "message": 2, "session": 2}

    # A start whose end comes in a later run is stored once, and then with its end.
    log = world["tmp"] / "tool.log"
    log.write_text(TOOL_LOG + '2025-03-02 08:00:01.000 [info] FunctionCall: run {"cmd":"ls"}\n')
    ingest(tables, LogSources(tool_log=str(log)), 1_746_200_000_003)
    with open(log, "a") as out:
        out.write('2025-03-02 08:00:02.000 [info] ToolCall: run {"status":"failed","cmd":"ls"}\n')
    ingest(tables, LogSources(tool_log=str(log)), 1_746_200_000_004)
    assert sorted((r.command, r.status, r.duration_ms) for r in tables.read("tool_call").collect()) == [
        ("ls", "failed", 1000), ("pwd", "ok", 200)]
    assert tables.read("tool_call_event").count() == 4

    full = ingest(tables, sources, 1_746_200_000_005, IngestOptions(full=True)).first()
    assert full.files_processed == 4
    assert counts(tables, "model_call", "message", "session", "tool_call") == {
        "model_call": 5, "message": 2, "session": 2, "tool_call": 2}
    assert tables.read("model_call").agg(F.sum("total_tokens")).first()[0] == 24


def test_tool_calls_with_equal_short_hashes_are_kept_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(co, "_hash16", lambda *parts: F.lit("0" * 16))
    tables, log = Tables(spark, str(tmp_path / "tables")), tmp_path / "tool.log"
    log.write_text(TOOL_LOG + '2025-03-02 08:00:01.000 [info] FunctionCall: run {"cmd":"ls"}\n')
    ingest(tables, LogSources(tool_log=str(log)), 1_746_200_000_000)
    assert counts(tables, "tool_call", "tool_call_event") == {"tool_call": 2, "tool_call_event": 3}
    with open(log, "a") as out:
        out.write('2025-03-02 08:00:02.000 [info] ToolCall: run {"status":"failed","cmd":"ls"}\n')
    ingest(tables, LogSources(tool_log=str(log)), 1_746_200_000_001)
    assert sorted((r.command, r.status, r.duration_ms) for r in tables.read("tool_call").collect()) == [
        ("ls", "failed", 1000), ("pwd", "ok", 200)]
    assert tables.read("tool_call_event").count() == 4


def test_read_range_and_backfill(spark, world):
    tables = world["tables"]
    ingest(tables, LogSources(sessions=str(world["logs"])), 5)
    assert tables.read("session", DateRange(DAY, DAY + 1)).count() == 1
    plan = tables.read("session", DateRange(DAY, DAY + 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    before = {r.id: r.project_id for r in tables.read("session").collect()}
    remotes = spark.createDataFrame([("/w/p0", "https://h/o/r"), ("/w/p1", "https://h/o/r")], "cwd string, git_remote string")
    backfill(tables, remotes, everything=True)
    after = {r.id: r.project_id for r in tables.read("session").collect()}
    assert len(set(before.values())) == 2 and len(set(after.values())) == 1
    assert tables.read("project").filter("name = 'r'").count() == 1


def test_streaming_ingest_equals_batch(spark, world):
    tables, logs = world["tables"], world["logs"]
    checkpoint = str(world["tmp"] / "stream")
    start_ingest(tables, str(logs), checkpoint, trigger={"availableNow": True}).awaitTermination()
    write(logs / "c.jsonl", session_file(3, calls=3))
    start_ingest(tables, str(logs), checkpoint, trigger={"availableNow": True}).awaitTermination()
    batch = Tables(spark, str(world["tmp"] / "batch"))
    ingest(batch, LogSources(sessions=str(logs)), 5)
    for name in ("session", "message", "model_call"):
        keys = lambda t: sorted(r.dedup_key for r in t.read(name).select("dedup_key").collect())
        assert keys(tables) == keys(batch) and keys(batch)


def test_streaming_correlation_spans_batches(spark, tmp_path):
    schema = "file string, " + ", ".join(f"{n} {t}" for n, t in co.FIELDS.items())
    base = 1_740_000_000_000
    event = lambda line, ts, kind, sig: ("f", line, base + ts, 1, kind, "t", None, sig, None, None, None, None, None)
    batches = [[event(1, 0, "start", "t|a"), event(2, 10, "start", "t|b")], [event(3, 200_000, "exit", "t|a")],
               [event(4, 2_000_000, "start", "t|c")], [event(5, 4_000_000, "start", "t|d")]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        (correlate_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    got = {(r.s_line, r.e_line) for r in spark.read.parquet(out).collect()}
    assert (1, 3) in got and (2, None) in got and (4, None) in got and not any(s == 5 for s, _ in got)


def test_price_file(spark, tmp_path):
    path = tmp_path / "prices.json"
    path.write_text(json.dumps({"m": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6, "mode": "chat"},
                                "half": {"input_cost_per_token": 1}, "n": {"input_cost_per_token": 1, "output_cost_per_token": 2,
                                                                            "cache_read_input_token_cost": 0.5}}))
    rows = {r.model: (r.input_price, r.output_price, r.cache_price) for r in price_table(spark, str(path)).collect()}
    assert rows == {"m": (1e-6, 2e-6, None), "half": (1.0, None, None), "n": (1.0, 2.0, 0.5)}


def test_an_entry_without_prices_ends_the_search(spark):
    price = spark.createDataFrame([("m", None, None, None), ("openai/m", 1.0, 2.0, None), ("openai/n", 3.0, 4.0, None)],
                                  "model string, input_price double, output_price double, cache_price double")
    used = spark.createDataFrame([("m",), ("n",), (None,), ("unknown",)], "model string")
    rows = {r.model: (r.input_price, r.cache_price) for r in with_price(used, price).collect()}
    assert rows == {"m": (None, None), "n": (3.0, 3.0), None: (None, None), "unknown": (None, None)}


def test_priced_reports_read_the_facts_once_and_only_their_days(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    day = 86_400_000
    calls = spark.range(10).select((F.col("id") * day).alias("ts"), F.lit("m").alias("model"), F.concat(F.lit("c"), "id").alias("id"))
    tables.append("model_call", calls)
    price = spark.createDataFrame([("m", 1.0, 2.0, None)], "model string, input_price double, output_price double, cache_price double")
    rng = DateRange(2 * day, 4 * day - 1)
    out = overview_daily(tables.read("session", keep_day=True), tables.read("model_call", keep_day=True), price, rng)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = plan.split("FileScan parquet")[1:]  # only the calls are stored here
    assert len(scans) == 1 and "day" in scans[0].split("PartitionFilters: [")[1].split("]")[0]
    assert sum(r["model_calls"] for r in out.collect()) == 2


def test_rollups_are_kept(spark, tmp_path):
    """Ingest fills the three daily tables; late rows change exactly their days, and balances the days behind them."""
    from sessionmeter.plans.activity import activity_daily
    from sessionmeter.plans.upkeep import automation_rollup, daily_activity_rollup, worktree_rollup

    day, logs, desk = 86_400_000, tmp_path / "logs", tmp_path / "desk"
    logs.mkdir()
    desk.mkdir()
    call = lambda at: {"type": "event_msg", "payload": {"type": "token_count", "ts": DAY + at, "session_id": "s1", "input_tokens": 5}}
    write(logs / "a.jsonl", [{"type": "session_meta", "id": "s1", "ts": DAY}, call(0), call(day), call(5 * day)])
    log = lambda n, *events: (desk / f"x-desktop-ab-1-t2-i3-000000-{n}.log").write_text(
        "".join(f"2025-05-{d:02}T10:00:0{i}.000Z info [git] {what}\n" for i, (d, what) in enumerate(events)))
    log(1, (1, "created worktree /a/b"), (3, "created worktree /a/c"), (3, "Automation queued"), (5, "deleted worktree /a/b"))
    tables = Tables(spark, str(tmp_path / "tables"))
    sources = LogSources(str(logs), None, (str(desk),))

    def same():
        full = {"daily_activity": daily_activity_rollup(tables.read("message"), tables.read("model_call")),
                "worktree_daily": worktree_rollup(tables.read("worktree_event")),
                "automation_daily": automation_rollup(tables.read("automation_event"))}
        for name, frame in full.items():
            kept = tables.read(name)
            assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, frame.select(*kept.columns).collect())) != [], name

    stamps = lambda name: {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "tables" / name).glob("day=*/*.parquet")}
    ingest(tables, sources, 1_746_200_000_000)
    same()
    before = {n: stamps(n) for n in ("daily_activity", "worktree_daily")}
    with open(logs / "a.jsonl", "a") as out:
        out.writelines(json.dumps(call(day + i)) + "\n" for i in range(3))
    log(2, (3, "deleted worktree /a/c"), (2, "created worktree /a/d"))
    ingest(tables, sources, 1_746_200_000_001)
    same()
    changed = {n: sorted(d for d, at in stamps(n).items() if before[n].get(d) != at) for n in before}
    assert len(changed["daily_activity"]) == 1 and changed["worktree_daily"] == ["day=2025-05-02", "day=2025-05-03", "day=2025-05-05"]

    message, calls, rollup = tables.read("message"), tables.read("model_call"), tables.read("daily_activity")
    rng = DateRange(DAY // day * day, DAY // day * day + 2 * day - 1)
    whole = activity_daily(message, calls, rng, rollup=rollup)
    assert "model_call" not in whole._jdf.queryExecution().toString()
    for stored in (rollup, rollup.limit(1), rollup.limit(0)):
        rows = lambda f: sorted(map(tuple, f.select("date", "message_count", "call_count", "token_total").collect()))
        assert rows(activity_daily(message, calls, rng, rollup=stored)) == rows(activity_daily(message, calls, rng)) != []
        assert rows(activity_daily(message, calls, DateRange(), rollup=stored)) == rows(activity_daily(message, calls, DateRange()))
