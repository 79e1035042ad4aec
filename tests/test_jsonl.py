"""Session files: numbering, rejects, key synonyms, context, identity."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sessionmeter.operators import records
from sessionmeter.sources.jsonl import parse_jsonl
from sessionmeter.sources.lines import discover, session_lines
from sessionmeter.sources.tail import changed_files, read_new

DAY = 1_736_000_000_000

MAIN = [
    {"type": "session_meta", "id": "s-1", "ts": DAY, "cwd": "/work/alpha", "originator": "shell", "cli_version": 2,
     "model_provider": "acme", "git": {"branch": "dev", "sha": "f00"}},
    {"type": "response_item", "item": {"role": "User", "content": [{"text": "one"}, "two", {"text": {"value": "three"}},
                                                                  {"content": "four"}, 5]}},
    "",
    "{broken",
    {"kind": "event_msg", "payload": {"type": "token_count", "ts": "2025-01-04T14:13:20.500Z",
                                      "info": {"last_token_usage": {"input": 7, "output_tokens": "3"}},
                                      "input_tokens": 99, "reasoning": 2, "duration_ms": 0}},
    {"type": "turn_context", "payload": {"model": "m-1", "provider": "acme"}},
    {"type": "event_msg", "payload": {"type": "TOKEN_COUNT", "id": "call-9", "total_tokens": None, "input_tokens": True}},
    {"type": "turn_context", "session_id": "s-2", "context": {"model": "m-2"}},
    {"type": "event_msg", "session_id": "s-1", "ts": DAY + 9, "payload": {"type": "token_count", "total": 4}},
    {"type": "event_msg", "payload": {"type": "agent_message"}},
    {"type": "response_item", "role": "tool", "session_id": "s-1"},
    {"type": "response_item", "session": {"session_id": "s-3"}, "payload": {"role": "system"}, "message": {"content": "deep"}},
    {"a": 1, "type": "session_meta", "session_meta": {"cwd": "/x"}},
]


def write(path, rows, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)


@pytest.fixture(scope="module")
def context(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    write(root / "2025" / "a.jsonl", MAIN, end="")
    write(root / "other.txt", ["{}"])
    lines, files = session_lines(spark, str(root))
    good, rejects = parse_jsonl(lines)
    return {"context": records.read_records(good, keep_content=True).cache(), "plain": records.read_records(good), "rejects": rejects, "files": files,
            "path": str(root / "2025" / "a.jsonl")}


def test_rejects_keep_line_number(context):
    rows = context["rejects"].collect()
    assert [(r.file, r.line, r.raw) for r in rows] == [(context["path"], 4, "{broken")]


def test_file_summary(context):
    row = context["files"].collect()
    assert len(row) == 1 and row[0].line_count == len(MAIN)


def test_sessions(context):
    rows = {r.source_line: r for r in records.sessions(context["context"]).collect()}
    first = rows[1]
    assert (first.id, first.ts, first.cwd, first.cli_version, first.git_branch, first.git_commit) == (
        "s-1", DAY, "/work/alpha", "2", "dev", "f00")
    assert rows[13].id == rows[13].dedup_key and rows[13].cwd == "/x"


def test_dedup_key_matches_canonical_json(context):
    row = records.sessions(context["context"]).filter("source_line = 1").first()
    body = json.dumps({"cli_version": "2", "cwd": "/work/alpha", "git_branch": "dev", "git_commit": "f00",
                       "model_provider": "acme", "originator": "shell", "sessionId": "s-1", "ts": DAY},
                      separators=(",", ":"))
    inner = hashlib.sha256(body.encode()).hexdigest()[:24]
    assert row.dedup_key == hashlib.sha256(f"{context['path']}:1:{inner}".encode()).hexdigest()[:24]


def test_messages(context):
    rows = {r.source_line: r for r in records.messages(context["context"]).collect()}
    assert set(rows) == {2, 12}
    assert (rows[2].session_id, rows[2].role, rows[2].content) == ("s-1", "user", "one two three four")
    assert (rows[12].session_id, rows[12].role, rows[12].content) == ("s-3", "system", "deep")
    assert records.messages(context["plain"]).filter(F.col("content").isNotNull()).count() == 0


def test_model_calls_follow_context(context):
    rows = {r.source_line: r for r in records.model_calls(context["context"]).collect()}
    assert set(rows) == {5, 7, 9}
    five = rows[5]
    assert (five.session_id, five.ts, five.model, five.input_tokens, five.output_tokens, five.reasoning_tokens,
            five.total_tokens, five.duration_ms) == ("s-1", DAY + 500, None, 7, 3, 2, 12, None)
    seven = rows[7]
    # A payload id is the session id too, when no other key names one.
    assert (seven.session_id, seven.model, seven.input_tokens, seven.total_tokens) == ("call-9", "m-1", 0, 0)
    # The line names s-1, but the session in force is s-2, and so is the model.
    assert (rows[9].session_id, rows[9].model, rows[9].total_tokens) == ("s-1", "m-2", 4)


def test_contexts(context):
    rows = {r.source_line: r for r in records.contexts(context["context"]).collect()}
    assert (rows[6].session_id, rows[6].model, rows[6].model_provider) == ("s-1", "m-1", "acme")
    assert rows[8].session_id == "s-2"


def test_context_equals_a_plain_loop(spark):
    import random
    rng = random.Random(3)
    rows, want = [], []
    for file in ("a", "b", "c"):
        current, models = None, {}
        for line in range(1, 400):
            roll = rng.random()
            if roll < 0.1:
                sid = f"s{rng.randrange(4)}"
                doc = {"type": "session_meta", "id": sid}
                current = sid
            elif roll < 0.25:
                sid = rng.choice([None, f"s{rng.randrange(4)}"])
                model = rng.choice([None, f"m{rng.randrange(5)}"])
                doc = {"type": "turn_context", "context": {}}
                if sid:
                    doc["session_id"] = sid
                if model:
                    doc["context"]["model"] = model
                target = sid or current
                if target:
                    models[target] = model or models.get(target)
                    current = target
            else:
                doc = {"type": "event_msg", "payload": {"type": "token_count"}}
                if current:
                    want.append((file, line, current, models.get(current)))
            rows.append((file, line, json.dumps(doc), 5))
    frame = spark.createDataFrame(rows, "file string, line long, value string, mtime_ms long")
    good, _ = parse_jsonl(frame)
    got = records.model_calls(records.read_records(good)).select("source_file", "source_line", "session_id", "model")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text, ok", [
    ('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}{"b":2}', False), ("[1,2]", True), ("1],[2", False),
    ('{"a":1,"a":2}', True), ("nul", False), ('"x"', True)])
def test_whole_line_must_be_json(spark, text, ok):
    good, rejects = parse_jsonl(spark.createDataFrame([("f", 1, text, 0)], "file string, line long, value string, mtime_ms long"))
    assert (good.count(), rejects.count()) == ((1, 0) if ok else (0, 1))


def test_incremental_lines(spark, tmp_path):
    from sessionmeter.sources.ledger import next_ledger
    write(tmp_path / "x.jsonl", [{"n": 1}, {"n": 2}])
    write(tmp_path / "y.jsonl", [{"n": 1}] * 3)
    found = lambda ledger: changed_files(discover(spark, [str(tmp_path)], "*.jsonl"), ledger)
    nothing = spark.createDataFrame([], "path string, byte_offset long, line_count long, mtime_ms long, begun_at long, seen_size long")
    _, files = read_new(found(nothing), 7)
    ledger = spark.createDataFrame(next_ledger(files, 1).collect(), next_ledger(files, 1).schema)
    assert found(ledger).collect() == []
    with open(tmp_path / "x.jsonl", "a") as out:
        out.write('{"n":3}\n')
    write(tmp_path / "y.jsonl", [{"n": 9}])
    lines, files = read_new(found(ledger), 8)
    assert sorted((r.file[-7:], r.line, r.value, r.is_new) for r in lines.collect()) == [
        ("x.jsonl", 3, '{"n":3}', True), ("y.jsonl", 1, '{"n": 9}', True)]
    assert sorted((r.path[-7:], r.line_count, r.begun_at) for r in files.collect()) == [("x.jsonl", 3, 7), ("y.jsonl", 1, 8)]
    # A ledger that does not say where a file was begun: all is read, and what was taken is marked.
    lines, _ = read_new(found(ledger.withColumn("begun_at", F.lit(None).cast("long"))), 9)
    assert sorted((r.file[-7:], r.line, r.is_new) for r in lines.collect()) == [
        ("x.jsonl", 1, False), ("x.jsonl", 2, False), ("x.jsonl", 3, True), ("y.jsonl", 1, True)]


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f'{{"n":{i}}}\n' for i in range(1, 20_001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines, _ = session_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        wrong = lines.filter(F.get_json_object("value", "$.n").cast("long") != F.col("line")).count()
        assert (lines.count(), wrong) == (20_000, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
