"""Order-dependent operators against plain loops, with one key holding most rows."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sessionmeter.functions import git, text
from sessionmeter.functions.scalars import day_text
from sessionmeter.operators.attribution import calls_of_session, window_totals
from sessionmeter.operators.medians import exact_medians
from sessionmeter.operators.ordered import carry_forward, clamped_balance, first_per_key, with_next
from sessionmeter.operators.pages import page, top_k
from sessionmeter.plans.projects import project_models
from sessionmeter.ranges import Page


@pytest.mark.parametrize("current", [False, True])
def test_carry_forward(spark, current):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.choice([None, None, f"v{i}"])) for i in range(600)]
    rows += [(None, 700, "x"), (None, 701, None)]
    df = spark.createDataFrame(rows, "k string, pos long, v string")
    got = {r.pos: r.out for r in carry_forward(df, ["k"], "pos", "v", "out", current, chunk=17).collect()}
    last, want = {}, {}
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        if current and v:
            last[k] = v
        want[pos] = last.get(k) if k else None
        if v:
            last[k] = v
    assert got == want


@pytest.mark.parametrize("hot", [1_000_000, 100, 0])
def test_with_next(spark, hot):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["k0", "k1", "k2", None]), rng.randrange(4000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, ts long, id long")
    found = with_next(df, ["k"], "ts", "id", "nxt", width=100, hot=hot)
    assert set(found.columns) == {"k", "ts", "id", "nxt"}
    facts = found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(k")
    assert facts == 1, "the rows themselves are shuffled once"
    got = {r.id: r.nxt for r in found.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for here, there in zip(ordered, ordered[1:] + [None]):
            want[here[2]] = there and there[1]
    assert got == want


@pytest.mark.parametrize("baseline", [-3, 0, 4])
def test_clamped_balance(spark, baseline):
    rng = random.Random(baseline)
    steps = [rng.randrange(-4, 5) for _ in range(60)]
    days = spark.createDataFrame([("k", None, baseline)] + [("k", f"d{i:03}", s) for i, s in enumerate(steps)],
                                 "k string, day string, delta long")
    got = [r.bal for r in clamped_balance(days, ["k"], "day", "delta", "bal").orderBy("day").collect()]
    level, want = baseline, []
    for s in steps:
        level = max(0, level + s)
        want.append(level)
    assert got == want


def test_exact_medians(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([None, float(rng.randrange(10)), rng.random() * 10**rng.randrange(9), -rng.random()]))
            for _ in range(2000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r["median"] for r in exact_medians(df, "g", ["x"]).collect()}
    assert got == {g: statistics.median([x for k, x in rows if k == g and x is not None]) for g in ("a", "b", "c", "one")}


def test_medians_of_very_many_values_in_one_bin(spark):
    """40,000 values within 0.01 % of each other, and a tail beside them: ranges are cut until ten values are left."""
    rng = random.Random(6)
    rows = [("dense", 1 + rng.random() / 10_000) for _ in range(39_999)] + [("dense", 1.00005 - 1e-15)]
    rows += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(2001)] + [("same", 3.0)] * 500 + [("same", 3.0000000000000004)] * 500
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r["median"] for r in exact_medians(df, "g", ["x"], total="all", ranked=10).collect()}
    want = {g: statistics.median([x for k, x in rows if k == g]) for g in ("dense", "wide", "same")}
    assert got == {**want, "all": statistics.median([x for _, x in rows])}
    assert exact_medians(df.limit(0), "g", ["x"], total="all").collect() == []


def test_a_groups_facts_are_cut_down_before_they_are_summed(spark):
    project = spark.createDataFrame([("p", "n", "/r", None, 1, 2)], "id string, name string, root_path string, git_remote string, first_seen_ts long, last_seen_ts long")
    session = spark.createDataFrame([("s", "p", 5), ("t", "q", 6)], "id string, project_id string, ts long")
    calls = spark.createDataFrame([(s, "m", 5, 1, 1, 1, 1, 1) for s in ("s", "s", "t")], "session_id string, model string, ts long, input_tokens long, "
                                  "cached_input_tokens long, output_tokens long, reasoning_tokens long, total_tokens long")
    price = spark.createDataFrame([("m", 1.0, 1.0, 1.0)], "model string, input_price double, output_price double, cache_price double")
    found = project_models(project, session, calls, price)
    assert [tuple(r) for r in found.collect()] == [("m", 2, 6.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.rindex("Aggregate [session_id")


def test_a_sessions_window_reaches_the_scan(spark, tmp_path):
    path, hour = str(tmp_path / "calls"), 3_600_000
    rows = [("a", "s", 50 * hour), ("b", None, 51 * hour), ("c", None, 90 * hour), ("d", "t", 51 * hour)]
    spark.createDataFrame(rows, "id string, session_id string, start_ts long").write.parquet(path)
    windows = spark.createDataFrame([("s", 26 * hour, 75 * hour), ("t", 80 * hour, 99 * hour)], "session_id string, window_start long, window_end long")
    found = calls_of_session(windows, spark.read.parquet(path), "s")
    assert {r.id for r in found.collect()} == {"a", "b"}
    scans = found._jdf.queryExecution().executedPlan().toString().replace("\n", " ")
    assert f"GreaterThanOrEqual(start_ts,{26 * hour})" in scans and "Join" not in scans
    assert {r.id for r in calls_of_session(windows, spark.read.parquet(path), "nobody").collect()} == set()


def test_first_per_key_limits_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("'same' as k", "id").write.parquet(path)
    df = first_per_key(spark.read.parquet(path), ["k"], [F.col("id").desc()])
    assert [r.id for r in df.collect()] == [999]
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_absurd_times_change_no_other_window(spark):
    """A session stamped in microseconds and calls stamped in seconds, before 1970 and far ahead."""
    day, base = 86_400_000, 1_740_000_000_000
    rng = random.Random(12)
    calls = [(base + rng.randrange(9 * day), None, 5, "ok", None) for _ in range(300)]
    spans = [(f"s{i}", a, a + rng.randrange(7_200_000, 8 * day)) for i in range(60) for a in [base + rng.randrange(8 * day)]]
    odd_calls = [(base // 1000, None, 5, "ok", None), (-base, None, 5, "ok", None), (base * 1000, None, 5, "ok", None)]
    odd_spans = [("far", base * 1000 - day, base * 1000 + day), ("wide", -2 * base, base * 2000)]
    schema, names = "start_ts long, end_ts long, duration_ms long, status string, exit_code long", "session_id string, window_start long, window_end long"
    total = lambda s, c: {r.session_id: tuple(r)[1:] for r in window_totals(spark.createDataFrame(s, names), spark.createDataFrame(c, schema)).collect()}
    plain, odd = total(spans, calls), total(spans + odd_spans, calls + odd_calls)
    assert {k: odd[k] for k in plain} == plain and len(plain) == 60
    assert odd["far"] == (1, 1, 5, 1, base * 1000, base * 1000) and odd["wide"] == (303, 303, 5 * 303, 303, -base, base * 1000)
    plan = window_totals(spark.createDataFrame(spans, names), spark.createDataFrame(calls, schema))._jdf.queryExecution().toString()
    assert "Exchange SinglePartition" not in plan


def test_window_totals(spark):
    rng = random.Random(6)
    hour = 3_600_000
    calls = []
    for i in range(400):
        start = rng.randrange(200 * hour) // 60_000 * 60_000
        took = rng.choice([None, rng.randrange(10_000_000)])
        calls.append((start, start + took if took and rng.random() < 0.7 else None, took if rng.random() < 0.5 else None,
                      rng.choice(["ok", "failed", "unknown"]), rng.choice([None, 0, 1])))
    windows = [(f"w{i}", a, a + rng.randrange(2 * hour, 150 * hour)) for i, a in
               enumerate(rng.randrange(-40 * hour, 210 * hour) // 60_000 * 60_000 for _ in range(60))]
    frame = spark.createDataFrame(calls, "start_ts long, end_ts long, duration_ms long, status string, exit_code long")
    spans = spark.createDataFrame(windows, "session_id string, window_start long, window_end long")
    got = {r.session_id: (r.n, r.ok, r.dur, r.dur_n, r.first_ts, r.last_ts) for r in window_totals(spans, frame).collect()}
    for name, low, high in windows:
        inside = [c for c in calls if low <= c[0] <= high]
        took = [c[2] if c[2] is not None else c[1] - c[0] for c in inside if c[2] is not None or c[1] is not None]
        want = (len(inside), sum(c[3] in ("ok", "unknown") or c[4] == 0 for c in inside), sum(took), len(took),
                min((c[0] for c in inside), default=None), max((c[1] if c[1] is not None else c[0] for c in inside), default=None))
        assert got[name] == want, name


def test_pages_and_rankings(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(10)], "id long, m long")
    assert [r.id for r in page(df, [F.col("id").desc()], Page(3, 2)).collect()] == [7, 6, 5]
    assert [r.id for r in top_k(df, "m", "id", 3).collect()] == [2, 5, 1]


def test_days_in_zones(spark):
    df = spark.createDataFrame([(1_700_000_000_123,), (-1,)], "t long")
    rows = df.select(day_text(F.col("t")), day_text(F.col("t"), "Pacific/Auckland"), day_text(F.col("t"), "America/Lima")).collect()
    assert [tuple(r) for r in rows] == [("2023-11-14", "2023-11-15", "2023-11-14"), ("1969-12-31", "1970-01-01", "1969-12-31")]


@pytest.mark.parametrize("url, plain, strict, loose", [
    ("https://Host.org/Team/Tool.git", "https://host.org/team/tool", "tool", "tool"),
    ("https://host.org/team/tool/", "https://host.org/team/tool", "tool", "tool"),
    ("git@host.org:team/tool.git", "https://host.org/team/tool", "tool", "tool"),
    ("ssh://git@host.org/team/sub/tool", "https://host.org/team/sub/tool", "tool", "tool"),
    ("https://host.org/alone", "https://host.org/alone", None, "alone"),
    ("file:///srv/x/tool", "file:///srv/x/tool", None, "tool"),
    ("Host.org:Team/Tool", "host.org:team/tool", None, "tool"), ("http:///x/y", "http:///x/y", None, None),
    ("just words", "just words", None, None), ("  ", None, None, None), (None, None, None, None)])
def test_git_urls(spark, url, plain, strict, loose):
    df = spark.createDataFrame([(url,)], "u string")
    row = df.select(git.normalize_git_url(F.col("u")), git.repo_name(F.col("u"), True), git.repo_name(F.col("u"))).first()
    assert tuple(row) == (plain, strict, loose)


def test_search_is_ascii_only_with_wildcards(spark):
    df = spark.createDataFrame([("Alpha_1",), ("ALPHAX1",), ("back\\slash",), ("É",)], "t string")
    found = lambda term: sorted(r.t for r in df.filter(text.any_matches(term, "t")).collect())
    assert found("pha_1") == ["ALPHAX1", "Alpha_1"] and found("K\\S") == ["back\\slash"] and found("é") == []


def test_masked_email(spark):
    df = spark.createDataFrame([("Ann@Ex.ORG",), ("plain",), ("a@b@C",), ("@x",)], "e string")
    rows = df.select(text.mask_email(F.col("e")).alias("m")).select("m.*").collect()
    assert [r.email_domain for r in rows] == ["ex.org", None, "b@c", "x"]
    assert rows[3].email_hash is None and all(len(r.email_hash) == 12 for r in rows[:3])
