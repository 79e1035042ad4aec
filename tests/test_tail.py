"""Reading what is new: byte ranges, carried context, and streams over growing files."""

from __future__ import annotations

import json
import os
import random
import time

import pytest

from sessionmeter.ingest import LogSources, ingest
from sessionmeter.runtime import checkpointed
from sessionmeter.sources.ledger import latest_ledger, next_ledger
from sessionmeter.sources.lines import discover
from sessionmeter.sources.tables import Tables
from sessionmeter.sources.tail import changed_files, open_anywhere, read_new
from sessionmeter.streaming.ingest import start_ingest
from tests.test_jsonl import DAY, write

NOTHING = "path string, byte_offset long, line_count long, mtime_ms long, updated_at long, begun_at long, seen_size long"


def counted(log):
    """An opener that notes how much every read call returned."""
    def opener(path):
        inner = open_anywhere(path)

        class Noted:
            __enter__ = lambda self: self
            __exit__ = lambda self, *_: inner.close()
            seek = lambda self, at: inner.seek(at)

            def read(self, n):
                data = inner.read(n)
                with open(log, "a") as out:
                    out.write(f"{len(data)}\n")
                return data
        return Noted()
    return opener


def step(spark, root, ledger, now, **options):
    changed = checkpointed(changed_files(discover(spark, [str(root)], "*.log"), latest_ledger(ledger)))
    lines, files = read_new(changed, now, **options)
    rows = sorted((os.path.basename(r.file), r.line, r.value) for r in lines.filter("is_new").collect())
    return rows, spark.createDataFrame(ledger.collect() + next_ledger(files, now).select(*ledger.columns).collect(), NOTHING)


def test_only_appended_bytes_are_read(spark, tmp_path):
    root, log, block = tmp_path / "in", tmp_path / "reads", 10_000
    root.mkdir()
    for name in "abc":
        (root / f"{name}.log").write_text("".join(f"{name} line {i} {'x' * (i % 50)}\n" for i in range(20_000)))
    rows, ledger = step(spark, root, spark.createDataFrame([], NOTHING), 1, block=block)
    assert len(rows) == 60_000
    added = "".join(f"new {i}\n" for i in range(3_000))
    with open(root / "b.log", "a") as out:
        out.write(added)
    rows, ledger = step(spark, root, ledger, 2, block=block, open_input=counted(str(log)))
    assert rows == sorted(("b.log", 20_001 + i, f"new {i}") for i in range(3_000))
    assert sum(map(int, log.read_text().split())) <= len(added) + block
    assert step(spark, root, ledger, 3)[0] == []


@pytest.mark.parametrize("whole", [False, True])
def test_random_growth(spark, tmp_path, whole):
    """Files grow by pieces that end anywhere; small blocks cut lines, some lines are longer than several blocks."""
    rng = random.Random(7 if whole else 8)
    root = tmp_path / "in"
    root.mkdir()
    written = {name: b"" for name in "ab"}
    want = {name: [] for name in "ab"}
    taken = {name: 0 for name in "ab"}
    ledger = spark.createDataFrame([], NOTHING)
    for turn in range(5):
        for name in "ab":
            more = b"".join(rng.choice([b"", b"short", "é日".encode(), b"y" * 300, b"cr\r", b" "]) + b"\n" for _ in range(rng.randrange(12)))
            more = more[:len(more) - rng.randrange(3)] if not whole or rng.random() < 0.5 else more
            with open(root / f"{name}.log", "ab") as out:
                out.write(more)
            before, written[name] = len(written[name]), written[name] + more
            data = written[name]
            end = data.rfind(b"\n") + 1 if whole else len(data)
            lines = data[:end].split(b"\n")
            lines = lines[:-1] if lines[-1] == b"" else lines
            fresh = [(f"{name}.log", i + 1, line.removesuffix(b"\r").decode(errors="replace")) for i, line in enumerate(lines)][taken[name]:]
            want[name] = fresh if len(data) != before or turn == 0 else []
            taken[name] = max(taken[name], len(lines))
        rows, ledger = step(spark, root, ledger, turn, whole_lines_only=whole, block=97)
        assert rows == sorted(want["a"] + want["b"]), turn
    (root / "a.log").write_text("begun anew\n")
    assert step(spark, root, ledger, 9, whole_lines_only=whole)[0] == [("a.log", 1, "begun anew")]


def random_lines(rng, n):
    out = []
    for _ in range(n):
        roll = rng.random()
        if roll < 0.15:
            out.append({"type": "session_meta", "id": f"s{rng.randrange(4)}", "ts": DAY})
        elif roll < 0.35:
            context = {"type": "turn_context", "context": {}}
            if rng.random() < 0.5:
                context["session_id"] = f"s{rng.randrange(4)}"
            if rng.random() < 0.7:
                context["context"]["model"] = f"m{rng.randrange(5)}"
            out.append(context)
        else:
            out.append({"type": "event_msg", "payload": {"type": "token_count", "ts": DAY + rng.randrange(10**6), "input_tokens": 1}})
    return out


def test_context_is_carried_over_runs(spark, tmp_path):
    """Session and model in force come from stored state: the same rows as from reading whole files."""
    rng = random.Random(11)
    logs, grown, whole = tmp_path / "logs", Tables(spark, str(tmp_path / "grown")), Tables(spark, str(tmp_path / "whole"))
    logs.mkdir()
    write(logs / "z.jsonl", [{"type": "session_meta", "id": f"s{i}", "ts": DAY} for i in range(4)])
    for turn in range(3):
        for name in "abc":
            with open(logs / f"{name}.jsonl", "a") as out:
                out.writelines(json.dumps(line) + "\n" for line in random_lines(rng, rng.randrange(8)))
        if turn == 1:  # a run that broke off before its ledger: its context state must not count
            stale = grown.read("carried_context").selectExpr("path", "session_id", "'wrong' value", "line + 1000 line", "begun_at")
            grown.append("carried_context", checkpointed(stale))
        ingest(grown, LogSources(sessions=str(logs)), 1000 + turn)
    ingest(whole, LogSources(sessions=str(logs)), 5000)
    rows = lambda t: sorted(map(tuple, t.read("model_call").select("source_file", "source_line", "session_id", "model", "ts").collect()), key=str)
    assert rows(grown) == rows(whole) and len({r[3] for r in rows(whole)}) > 2
    # A file that shrank forgets its old context.
    write(logs / "a.jsonl", [{"type": "event_msg", "payload": {"type": "token_count", "ts": DAY, "input_tokens": 1}}])
    before = grown.read("model_call").count()
    ingest(grown, LogSources(sessions=str(logs)), 6000)
    assert grown.read("model_call").count() == before


def test_stream_follows_growing_files(spark, tmp_path):
    logs, desk, tool = tmp_path / "logs", tmp_path / "desk", tmp_path / "tool.log"
    logs.mkdir()
    desk.mkdir()
    write(logs / "a.jsonl", [{"type": "session_meta", "id": "s1", "ts": DAY}])
    tool.write_text('2025-03-02 08:00:00.100 [info] FunctionCall: run {"cmd":"pwd"}\n')
    sources = LogSources(str(logs), str(tool), (str(desk),))
    live = Tables(spark, str(tmp_path / "live"))
    stream = start_ingest(live, sources, str(tmp_path / "cp"))
    try:
        def until(name, n):
            for _ in range(240):
                assert stream.exception() is None
                if live.read(name).count() >= n:
                    return
                time.sleep(0.25)
            raise AssertionError(f"{name} did not reach {n}")
        until("session", 1)
        with open(logs / "a.jsonl", "a") as out:
            out.write(json.dumps({"type": "event_msg", "payload": {"type": "token_count", "ts": DAY + 5, "input_tokens": 3}}) + "\n")
        with open(tool, "a") as out:
            out.write('2025-03-02 08:00:00.300 [info] ToolCall: run {"status":"done","exit_code":0,"cmd":"pwd"}\n')
        (desk / "x-desktop-ab-1-t2-i3-000000-4.log").write_text("2025-05-01T10:00:00.000Z info [git] created worktree /a/b\n")
        until("model_call", 1)
        until("tool_call_event", 2)
        until("worktree_event", 1)
    finally:
        stream.stop()
    batch = Tables(spark, str(tmp_path / "batch"))
    ingest(batch, sources, 5)
    for name in ("session", "model_call", "tool_call", "tool_call_event", "desktop_log_event", "worktree_event"):
        rows = lambda t: sorted(map(tuple, t.read(name).drop("created_at").collect()), key=str)
        assert rows(live) == rows(batch) and rows(batch), name


def test_tool_log_in_pieces_equals_the_whole(spark, tmp_path):
    """Appended piece by piece, cut anywhere: pairs over runs, arguments on further lines, a record that goes on."""
    rng, at, text = random.Random(3), 1_740_900_000, ""
    for i in range(120):
        at += rng.choice([0, 1, 2, 30, 200, 400])
        stamp = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(at)) + f".{i % 1000:03d}"
        tool, cmd = rng.choice("ab"), rng.choice(["x", "y", "z"])
        text += rng.choice([
            f'{stamp} [info] FunctionCall: {tool} {{"cmd":"{cmd}"}}\n',
            f'{stamp} [info] FunctionCall: {tool}\n{{"cmd":\n"{cmd} {i}"}}\n',
            f'{stamp} [info] ToolCall: {tool} {{"status":"done","exit_code":0,"cmd":"{cmd}"}}\n',
            f'{stamp} [info] BackgroundEvent: Execution failed: exit code=1 tool={tool} command="{cmd}"\n', f"{stamp} [info] nothing\n"])
    log = tmp_path / "tool.log"
    pieces, whole = Tables(spark, str(tmp_path / "pieces")), Tables(spark, str(tmp_path / "whole"))
    # Cuts: inside a line, and between a record and the lines that go on.
    cuts = [text.index("FunctionCall", 2000) + 5, text.index("\n{", 6000) + 1, len(text)]
    for turn, cut in enumerate(cuts):
        log.write_text(text[:cut])
        ingest(pieces, LogSources(tool_log=str(log)), 1000 + turn)
    ingest(whole, LogSources(tool_log=str(log)), 5000)
    broken = text[:cuts[1]].count("\n")  # this record was first read without its arguments, and stored so
    for name in ("tool_call", "tool_call_event"):
        rows = lambda t: sorted((tuple(r) for r in t.read(name).drop("id", "dedup_key", "correlation_key").filter(
            f"source_line <> {broken}").collect()), key=str)
        assert len(rows(whole)) > 40
        if name == "tool_call_event":
            assert rows(pieces) == rows(whole)
        else:
            assert len(set(rows(pieces)) ^ set(rows(whole))) <= 2  # the broken record may have met another end
    state = pieces.read("ingest_state").orderBy("updated_at").collect()
    assert 0 < state[0].byte_offset < state[1].byte_offset < cuts[2] == state[2].seen_size
