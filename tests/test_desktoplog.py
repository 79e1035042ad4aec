"""Desktop logs: multi-line records, privacy, redaction, events, archive inference."""

from __future__ import annotations

import pytest

from sessionmeter.operators import desktoplog as dl
from sessionmeter.sources.lines import desktop_lines

NAME = "some-desktop-0a1b-2c-77-t5-i2-112233-9.log"
LOG = """\
left over from before
2025-05-01T10:00:00.000Z INFO [git-repo-watcher] Starting git repo watcher "/home/ann/.codex/worktrees/ab/repo" branch: dev/x {"a": 1,
 "mail": "ann@example.org"}
2025-05-01T10:00:01.000Z info [git] removed worktree /Users/ann/wt
2025-05-01T10:00:02.000Z warn [git] strange thing happened
 second line for bob@example.org
2025-05-01T10:00:03.000Z info Automation run queued thread_id=th-1
2025-05-01T10:00:04.000Z info [main] automation run finished
2025-05-01T10:00:05.000Z error [automation] no idea
2025-05-01T10:00:06.000Z error the system prompt leaked
2025-05-01T10:00:07.000Z info [chat] harmless but unknown
2025-13-01T10:00:08.000Z info [main] impossible month
2025-05-01T10:00:09.000Z
2025-05-01T10:00:10.000Z info [main] not finished yet"""


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    roots = [tmp_path_factory.mktemp("one"), tmp_path_factory.mktemp("two")]
    (roots[0] / NAME).write_text(LOG)
    (roots[1] / "other.log").write_text("2025-05-01T10:00:00.000Z info [main] elsewhere\n")
    (roots[1] / "some-desktop-x.txt").write_text("2025-05-01T10:00:00.000Z info [main] elsewhere\n")
    lines, _ = desktop_lines(spark, [str(r) for r in roots], "some-desktop-*.log")
    records, rejects = dl.desktop_records(lines)
    safe = dl.safe_records(records, 7, home="/home/ann").cache()
    return {"safe": safe, "rejects": rejects}


def test_records(log):
    rows = {r.line_number: r for r in log["safe"].collect()}
    assert sorted(rows) == [2, 4, 5, 7, 8, 9]
    two = rows[2]
    assert (two.app_session_id, two.process_id, two.thread_id, two.instance_id, two.segment_index) == ("0a1b-2c", 77, 5, 2, 9)
    assert two.component == "git-repo-watcher" and two.level == "info"
    assert two.message == 'Starting git repo watcher "~/.codex/worktrees/ab/repo" branch: dev/x'
    assert two.payload_text == '{"a": 1,\n "mail": "[redacted]"}'
    assert rows[5].message == "strange thing happened\n second line for [redacted]"
    assert rows[4].message == "removed worktree /Users/[redacted]/wt"


def test_rejects(log):
    assert sorted(r.line for r in log["rejects"].collect()) == [12]


def test_worktree_events(log):
    rows = sorted((r.ts % 100_000, r.action, r.worktree_path, r.branch, r.status, r.error)
                  for r in dl.worktree_events(log["safe"], home="/home/ann").collect())
    assert [r[1:5] for r in rows] == [
        ("created", "~/.codex/worktrees/ab/repo", "dev/x", "ok"), ("archived", "/Users/[redacted]/wt", None, "ok"),
        ("error", None, None, "failed")]
    assert rows[2][5] == "strange thing happened\n second line for [redacted]"


def test_automation_events(log):
    rows = sorted((r.ts, r.action, r.thread_id, r.status) for r in dl.automation_events(log["safe"]).collect())
    assert [r[1:] for r in rows] == [("queued", "th-1", "ok"), ("completed", "5", "ok"), ("failed", "5", "failed")]


def test_archive_inference(spark):
    events = spark.createDataFrame(
        [("1", 1, "created", "/a"), ("2", 2, "archived", "/a"), ("3", 1, "created", "/b"), ("4", 3, "error", "/c"),
         ("5", 1, "created", "/d"), ("6", 1, "created", None)], "id string, ts long, action string, worktree_path string")
    inventory = spark.createDataFrame([("/d",)], "path string")
    rows = dl.archived_events(events, inventory, 99).collect()
    assert sorted((r.worktree_path, r.action, r.ts) for r in rows) == [("/b", "archived", 99), ("/c", "archived", 99)]
    assert len({r.dedup_key for r in rows}) == 2
