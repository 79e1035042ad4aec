"""Text logs of tool calls: records, arguments, event types and pairing."""

from __future__ import annotations

import random

import pytest

from sessionmeter.operators import correlation as co
from sessionmeter.operators.toollog import tool_log_events, tool_log_records
from sessionmeter.sources.lines import tool_log_lines

LOG = """\
\x1b[33m2025-03-02 08:00:00.100 [info] FunctionCall: run_shell {"cmd":"pwd","dir":"/home/ann/x"}\x1b[0m
2025-03-02 08:00:00.500 [info] ToolCall: run_shell {"status":"Started","cmd":"pwd"}
2025-03-02 08:00:01.000 [info] ToolCall: run_shell {"state":"done","exit_code":0,"duration_ms":"900","stdout":12,"cmd":"pwd"}
noise without a time
2025-03-02 08:01:00.000 [info] FunctionCall: run_shell args={"cmd":"cat nope"}
2025-03-02 08:01:00.250 [warn] BackgroundEvent: Execution failed: exit code=2 tool=run_shell command="cat nope" stderr="missing"
2025-03-02 08:02:00.000 [info] ToolCall: run_shell status=failed exit_code=9 cmd='bad one' duration_ms=40 cmd="worse"
2025-03-02 08:03:00.000 [info] FunctionCall: edit_file
{"path": "a",
 "cmd": "ToolCall: fake 2025-01-01T00:00:00Z",
 "command": "x"}
2025-03-02T08:04:00+0100 [info] ToolCall: lookup ({"event":"whatever","message":"oops"})
2025-03-02 08:05:00.000 [info] ToolCall: open_ended {"cmd":
2025-03-02 08:05:01.000 [info] BackgroundEvent: nothing of note
2025-03-02 08:05:02.000 [info] ToolCall: cut_off {"status":"completed"}"""


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tool") / "tool.log"
    path.write_bytes(LOG.replace("\n", "\r\n").encode())
    lines, files = tool_log_lines(spark, str(path))
    events = tool_log_events(tool_log_records(lines)).cache()
    return {"events": events, "files": files, "path": path, "rows": {r.line: r for r in events.collect()}}


def test_unterminated_line_waits(log):
    row = log["files"].first()
    size = log["path"].stat().st_size
    assert row.line_count == 14 and row.byte_offset == size - len(LOG.split("\n")[-1])
    assert 15 not in log["rows"]


def test_records_and_arguments(log):
    rows = log["rows"]
    assert sorted(rows) == [1, 2, 3, 5, 6, 7, 8, 12, 13]
    assert (rows[1].event_type, rows[1].command, rows[1].signature, rows[1].ts) == (
        "start", "pwd", "run_shell|pwd", 1740902400100)
    assert rows[2].event_type == "start"
    three = rows[3]
    assert (three.event_type, three.exit_code, three.duration_ms, three.stdout_bytes) == ("exit", 0, 900, 12)
    assert (rows[6].tool_name, rows[6].exit_code, rows[6].command) == ("run_shell", 2, 'cat nope" stderr="missing')
    assert rows[6].error.startswith("exit code=2")
    assert (rows[7].event_type, rows[7].command, rows[7].exit_code, rows[7].duration_ms) == ("failure", "worse", 9, 40)
    # The JSON over three lines is one record's; the mark inside it starts nothing.
    assert rows[8].command == "ToolCall: fake 2025-01-01T00:00:00Z"
    # The error text decides, as neither status nor line words do.
    assert (rows[12].event_type, rows[12].error, rows[12].ts) == ("failure", "oops", 1740899040000)
    assert (rows[13].event_type, rows[13].command, rows[13].signature) == ("start", None, 'open_ended|{"cmd":')


def test_tool_calls_of_the_log(spark, log):
    pairs = co.correlate(log["events"])
    calls = {(r.source_line): r for r in co.tool_calls(pairs).collect()}
    assert (calls[1].status, calls[1].duration_ms, calls[1].end_ts - calls[1].start_ts) == ("ok", 900, 900)
    assert 2 not in calls
    assert (calls[5].status, calls[5].exit_code, calls[5].duration_ms) == ("failed", 2, 250)
    assert (calls[7].status, calls[7].exit_code, calls[7].end_ts - calls[7].start_ts) == ("failed", 9, 40)
    assert (calls[8].status, calls[8].end_ts) == ("unknown", None)
    events = co.tool_call_events(pairs).collect()
    assert len(events) == 8
    tied = [e for e in events if e.source_line in (1, 3)]
    assert len({e.correlation_key for e in tied}) == 1 and calls[1].correlation_key == tied[0].correlation_key
    assert [e.payload for e in events if e.source_line == 1] == ['{"command":"pwd","signature":"run_shell|pwd"}']


def plain_pairs(events, window, repeat):
    """The pairing rule written down without cuts or indexes."""
    pending, out = [], []
    for e in sorted(events, key=lambda e: (e["ts"], e["rank"], e["line"])):
        if e["event_type"] == "start":
            if not any(p["signature"] == e["signature"] and abs(p["ts"] - e["ts"]) <= repeat for p in pending):
                pending.append(e)
            continue
        best = None
        for i, p in enumerate(pending):
            gap = abs(e["ts"] - p["ts"])
            if gap > window:
                continue
            points = 2 * (p["signature"] == e["signature"]) + (bool(e["tool_name"]) and p["tool_name"] == e["tool_name"])
            rank = (points, -gap if points else 0, -i)
            if best is None or rank > best[0]:
                best = (rank, i)
        out.append((pending.pop(best[1])["line"] if best else None, e["line"]))
    return sorted(out + [(p["line"], None) for p in pending], key=str)


def random_events(rng, n, spread):
    rows = []
    for line in range(1, n + 1):
        kind = rng.choice(["start", "start", "exit", "failure"])
        tool = rng.choice(["a", "b", "c"])
        sig = f"{tool}|{rng.randrange(4)}" if rng.random() < 0.8 else f"other{rng.randrange(5)}"
        named = tool if kind == "start" or rng.random() < 0.7 else None
        rows.append({"line": line, "ts": 10**12 + rng.randrange(spread) // 500 * 500, "rank": rng.randrange(3),
                     "event_type": kind, "tool_name": named, "signature": sig})
    return rows


def test_index_matches_the_plain_rule():
    rng = random.Random(5)
    for _ in range(150):
        rows = random_events(rng, 60, rng.choice([20_000, 400_000, 4_000_000]))
        pending = co.Pending()
        ordered = sorted(rows, key=lambda e: (e["ts"], e["rank"], e["line"]))
        got = [(s and s["line"], e and e["line"]) for event in ordered for s, e in co.match_event(event, pending)]
        got += [(s["line"], None) for _, s in pending.alive.values()]
        assert sorted(got, key=str) == plain_pairs(rows, co.WINDOW_MS, co.REPEAT_MS)


@pytest.mark.parametrize("piece_ms", [3_600_000, 400_000])
def test_cut_logs_pair_like_whole_ones(spark, piece_ms):
    rng = random.Random(11)
    logs = {f"log{i}": random_events(rng, 300, spread) for i, spread in enumerate([600_000, 9_000_000, 60_000_000])}
    rows = [(f, e["line"], e["ts"], e["rank"], e["event_type"], e["tool_name"], None, e["signature"], None, None, None, None,
             None) for f, events in logs.items() for e in events]
    schema = "file string, " + ", ".join(f"{n} {t}" for n, t in co.FIELDS.items())
    pairs = co.correlate(spark.createDataFrame(rows, schema), piece_ms=piece_ms).select("file", "s_line", "e_line").collect()
    for name, events in logs.items():
        got = sorted([(r.s_line, r.e_line) for r in pairs if r.file == name], key=str)
        assert got == plain_pairs(events, co.WINDOW_MS, co.REPEAT_MS)


def test_arguments_of_many_lines(spark):
    body = ['{"command": "x",', *[f' "k{i}": {i},' for i in range(40)], ' "z": 1}']
    rows = ["2025-03-02 08:00:00.000 [info] FunctionCall: edit_file", *body, "2025-03-02 08:01:00.000 [info] ToolCall: other {}"]
    lines = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(rows)], "file string, line bigint, value string")
    found = {r.line: r.args for r in tool_log_records(lines, max_lines=60).collect()}
    assert found[1] == "\n".join(body) and found[len(rows)] == "{}"


def test_arguments_are_compiled(spark):
    """No step of the events is a generator or a lambda, which Spark would interpret row by row."""
    records = spark.createDataFrame([("f", 1, 5, "tool", "ToolCall: a code=1", "a", "code=1 code=2 cmd='x y'"),
                                     ("f", 2, 6, "tool", "ToolCall: a", "a", '{"code":3,"exitCode":null,"cmd":" ","command":"z"}')],
                                    "file string, line bigint, ts bigint, mark string, text string, tool_name string, args string")
    events = tool_log_events(records)
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "lambdafunction" not in plan
    rows = {r["line"]: r for r in events.collect()}
    assert (rows[1]["exit_code"], rows[1]["command"]) == (2, "x y")
    assert (rows[2]["exit_code"], rows[2]["command"]) == (3, "z")


def test_lines_of_the_sample_log_are_dealt_to_many_tasks(spark, tmp_path):
    spark.sql("select id as event_id, timestamp'2024-01-01' as ts, id as user_id, 'view' as event_type, 1.0d as value,"
              " '{\"k\": 1}' as props from range(100)").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    from sessionmeter.registry.ingest import tool_log
    lines = tool_log(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert lines.count() == 100


def test_arguments_reach_over_a_block_of_lines(spark):
    """Lines are met in blocks; a record reaches over the edge of its own, and a line that comes twice counts once."""
    head = lambda n: ("f", n, "2024-01-01 00:00:00 ToolCall: t {")
    body = lambda n, k: [("f", n + i, "") for i in range(1, k)] + [("f", n + k, "}")]
    rows = [r for n, k in ((0, 20), (40, 21), (100, 22), (203, 1)) for r in [head(n), *body(n, k)]]
    rows += [("f", 204, "}")]
    found = {r["line"]: r["args"] for r in tool_log_records(spark.createDataFrame(rows, "file string, line bigint, value string")).collect()}
    assert [found[n].count("\n") for n in (0, 40, 100, 203)] == [20, 21, 21, 1]
    assert [found[n].endswith("}") for n in (0, 40, 100, 203)] == [True, True, False, True]
