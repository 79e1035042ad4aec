"""Shape of plans that decides how steps grow with their input."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sessionmeter.operators import merging, records
from sessionmeter.registry import ingest as logs
from sessionmeter.sources.jsonl import parse_jsonl

LINES = "file string, line long, value string, mtime_ms long"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark, folder, n=40):
    """Orders and line items as the log of sessions reads them."""
    spark.range(n).selectExpr(
        "id as o_orderkey", "id % 7 as o_custkey", "'O' as o_orderstatus", "'1-URGENT' as o_orderpriority",
        "timestamp_ntz'1997-01-01' as o_orderdate").write.parquet(f"{folder}/orders.parquet")
    spark.range(n * 3).selectExpr(
        "id div 3 as l_orderkey", "id % 3 as l_linenumber", "id as l_partkey", "id as l_suppkey", "cast(id % 20 as double) as l_quantity",
        "0.5d as l_discount", "0.1d as l_tax", "case id % 3 when 0 then 'N' else 'R' end as l_returnflag",
        "timestamp_ntz'1997-01-01' as l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_typing_looks_values_up_once(spark):
    good, _ = parse_jsonl(spark.createDataFrame([("f", 1, "{}", 0)], LINES))
    plan = optimized(records.typed_lines(good))
    # Lambdas are interpreted row by row; only times and numbers written as text still need some.
    assert plan.count("lambdafunction") < 150
    assert plan.count("filter(array(") == 0


def test_filtered_lines_are_written_once(spark, tmp_path):
    """A filter on the lines must not repeat the JSON they are made of."""
    folder = tables(spark, tmp_path)
    log = logs.session_log(spark, folder)
    assert optimized(parse_jsonl(log)[1]).count("own-model") == optimized(log).count("own-model") == 1


@pytest.mark.parametrize("doc, want", [
    ({"type": "event_msg", "payload": {"type": "token_count", "input_tokens": None, "input": 7}}, 0),
    ({"type": "event_msg", "payload": {"type": "token_count", "usage": {"prompt_tokens": "2.5"}, "input_tokens": 9}}, 2),
    ({"type": "event_msg", "payload": [], "event": {"payload": {"type": "token_count"}}}, None),
    ({"type": None, "kind": "event_msg", "message": {"payload": {"kind": "token_count", "input": 3.0}}, "input_tokens": 8}, 3)])
def test_first_source_of_a_count_decides(spark, doc, want):
    good, _ = parse_jsonl(spark.createDataFrame([("f", 1, json.dumps(doc), 0)], LINES))
    assert records.typed_lines(good).select("call.input_tokens").first()[0] == want


def test_rows_without_reference_meet_no_join(spark):
    session = spark.createDataFrame([("1",), ("2",)], "id string")
    tool = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("c", None)], "id string, session_id string")
    out = merging.delete_cascade({"session": session, "tool_call": tool}, "session", session.filter("id = '1'"))["tool_call"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("a", None), ("b", "2"), ("c", None), ("c", None)]))
    plan = optimized(out)
    assert "Union" in plan and "isnotnull(session_id" in plan


def test_canonical_names_are_steps(spark):
    """A group's names are dealt to all tasks, and the normalised remote is one column, not dozens of copies."""
    from sessionmeter.functions.git import canonical_name, with_canonical_name
    from sessionmeter.plans.projects import project_group
    rows = [("1", "A", "git@h.org:o/Repo.git"), ("2", " repo ", None), ("3", None, "https://h.org/x/repo/"), ("4", "b", "https://h.org/"),
            ("5", None, None), ("6", "Repo", ""), ("7", "", "ssh://git@h.org/o/other")]
    project = spark.createDataFrame(rows, "id string, name string, git_remote string")
    both = with_canonical_name(project, "stepwise").withColumn("whole", canonical_name(F.col("name"), F.col("git_remote")))
    assert [r["stepwise"] for r in both.collect()] == [r["whole"] for r in both.collect()]
    group = project_group(project, "1")
    assert sorted(r["id"] for r in group.collect()) == ["1", "2", "3", "6"]
    assert optimized(group).count("^ssh://git@") <= 4 and "RepartitionByExpression" in optimized(group).replace(
        "Repartition ", "RepartitionByExpression ")
