"""The library's tables as projections of the sample tables.

The sample tables hold no agent usage, so orders stand for sessions, line items for model
calls, events for tool calls and log events, conversations for messages and customers for
projects. Column meaning is stretched; the operators are the real ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import millis_of
from ..ranges import DateRange

SHIFT_MS = 9_710 * 86_400_000          # moves the events of January 2024 to June 1997
BASE_MS = 865_123_200_000              # 1997-06-01
RANGE = DateRange(852_076_800_000, 915_148_799_999)   # 1997-01-01 .. 1998-12-31
JUNE = DateRange(BASE_MS + 10 * 86_400_000, BASE_MS + 20 * 86_400_000 - 1)
NOW_MS = 1_735_689_600_000

text = lambda name: F.col(name).cast("string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    project = F.when(key % 13 != 0, text("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        text("o_orderkey").alias("id"),
        (millis_of(F.col("o_orderdate")) + (key * 7919) % 86400 * 1000).alias("ts"),
        F.concat(F.lit("/home/u"), text("o_custkey"), F.lit("/repo"), (owner % 40).cast("string")).alias("cwd"),
        F.when(key % 3 == 0, "cli").otherwise("ide").alias("originator"),
        F.concat(F.lit("0."), (key % 7).cast("string")).alias("cli_version"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("model_provider"),
        F.col("o_orderstatus").alias("git_branch"),
        F.concat(F.lit("c"), (key % 97).cast("string")).alias("git_commit"),
        project.alias("project_id"),
        F.when(key % 2 == 0, F.concat(project, F.lit("-"), F.col("o_orderstatus"))).alias("project_ref_id"))


def model_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity")
    whole = lambda c: F.round(c).cast("bigint")
    tokens = {"input_tokens": whole(quantity * 100), "cached_input_tokens": whole(quantity * 100 * F.col("l_discount")),
              "output_tokens": whole(quantity * 10), "reasoning_tokens": whole(F.col("l_tax") * 100)}
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        text("l_orderkey").alias("session_id"),
        (millis_of(F.col("l_shipdate")) + (F.col("l_linenumber") * 3600 + F.col("l_partkey") % 3600) * 1000).alias("ts"),
        F.when(flag == "A", "gpt-5").when(flag == "R", "gpt-5.1-mini")
        .when(F.col("l_linenumber") > 1, "local-llama").alias("model"),
        *[c.alias(n) for n, c in tokens.items()],
        (tokens["input_tokens"] + tokens["output_tokens"]).alias("total_tokens"),
        F.when(F.col("l_linestatus") == "F", whole((quantity - 1) * 1000)).alias("duration_ms"))


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), text("conv_id").alias("session_id"), "role",
        (F.lit(BASE_MS) + F.col("conv_id") * 2_220_000 + F.col("turn") * 45_000).alias("ts"),
        F.col("text").alias("content"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "*", (millis_of(F.col("ts")) - SHIFT_MS).alias("ms"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("took"))


def tool_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, key, k = F.col("event_type"), F.col("event_id"), F.col("k")
    status = F.when(kind == "error", "failed").when(kind.isin("purchase", "click"), "ok").otherwise("unknown")
    return _events(spark, sf_dir).select(
        text("event_id").alias("id"), F.when(key % 2 == 1, text("user_id")).alias("session_id"),
        kind.alias("tool_name"), F.when(k % 10 != 0, F.concat(F.lit("run "), text("k"))).alias("command"),
        status.alias("status"), F.col("ms").alias("start_ts"),
        F.when(key % 3 != 0, F.col("ms") + F.col("took")).alias("end_ts"),
        F.when(key % 3 == 1, F.col("took")).alias("duration_ms"),
        F.when(kind == "error", k % 3).when(kind.isin("purchase", "click"), 0).cast("bigint").alias("exit_code"),
        F.when((kind == "error") & (k % 25 == 0), "").when(kind == "error", F.concat(F.lit("err "), (k % 25).cast("string")))
        .alias("error"),
        (key % 1000).alias("stdout_bytes"), F.lit(0).cast("bigint").alias("stderr_bytes"),
        F.concat(F.lit("c"), text("event_id")).alias("correlation_key"))


def worktree_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, key, k = F.col("event_type"), F.col("event_id"), F.col("k")
    path = F.concat(F.lit("/home/u"), text("user_id"), F.lit("/wt"), (k % 5).cast("string"))
    return _events(spark, sf_dir).filter(kind.isin("signup", "purchase", "error")).select(
        text("event_id").alias("id"), F.col("ms").alias("ts"),
        F.when(kind == "signup", "created").when(kind == "error", "error")
        .when(key % 2 == 1, "archived").otherwise("deleted").alias("action"),
        path.alias("worktree_path"), path.alias("repo_root"),
        F.concat(F.lit("b"), (k % 7).cast("string")).alias("branch"),
        F.when(kind == "error", "failed").otherwise("ok").alias("status"),
        F.when(kind == "error", F.concat(F.lit("boom "), text("k"))).alias("error"))


def automation_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, sf_dir).filter(kind.isin("signup", "purchase", "error")).select(
        text("event_id").alias("id"), F.col("ms").alias("ts"),
        F.when(kind == "signup", "queued").when(kind == "error", "failed").otherwise("completed").alias("action"),
        text("user_id").alias("thread_id"), F.when(kind == "error", "failed").otherwise("ok").alias("status"),
        F.when(kind == "error", F.concat(F.lit("boom "), text("k"))).alias("error"))


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, repo = F.col("c_custkey"), (F.col("c_custkey") % 60).cast("string")
    org = F.concat(F.lit("Org"), (F.col("c_nationkey") % 5).cast("string"))
    joined = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return table(spark, sf_dir, "customer").select(
        text("c_custkey").alias("id"), joined("Repo", (key % 90).cast("string")).alias("name"),
        joined("/home/", F.lower("c_mktsegment"), "/", text("c_custkey")).alias("root_path"),
        F.when(key % 4 == 1, joined("https://Git.Example.com/", org, "/Repo", repo, ".git"))
        .when(key % 4 == 2, joined("git@git.example.com:", org, "/repo", repo))
        .when(key % 4 == 3, joined("ssh://git@git.example.com/", org, "/Repo", repo, "/")).alias("git_remote"),
        (F.lit(BASE_MS) - key * 60_000).alias("first_seen_ts"),
        F.when(key % 17 != 0, F.lit(BASE_MS) + key * 7919 % 5000 * 60_000).alias("last_seen_ts"))


def project_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.col("o_custkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(
        F.max(millis_of(F.col("o_orderdate"))).alias("last_seen_ts")).select(
        F.concat(text("o_custkey"), F.lit("-"), "o_orderstatus").alias("id"), text("o_custkey").alias("project_id"),
        F.when((owner % 5 != 0) | (F.col("o_orderstatus") != "P"), F.col("o_orderstatus")).alias("branch"),
        F.when(owner % 3 == 0, F.concat(F.lit("r"), text("o_custkey"))).alias("commit"),
        F.concat(F.lit("/home/u"), text("o_custkey")).alias("cwd"), "last_seen_ts")


def ingest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every update ever written; the current state is the newest row per path."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/logs/"), F.coalesce("source", F.lit("none")), F.lit("/"), (key % 300).cast("string"),
                 F.lit(".jsonl")).alias("path"),
        F.col("n_chars").cast("bigint").alias("byte_offset"), (key % 50).alias("line_count"),
        F.when(key % 9 != 0, F.lit(BASE_MS) + key * 1000).alias("mtime_ms"), (F.lit(BASE_MS) + key * 7919 % 100000 * 1000).alias("updated_at"))


def price(spark: SparkSession) -> DataFrame:
    """A price table of the usual form; the second name is found only by its dashed spelling."""
    return spark.createDataFrame(
        [("gpt-5", 1.25e-06, 1.0e-05, 1.25e-07), ("openai/gpt-5-1-mini", 2.5e-07, 2.0e-06, None)],
        "model string, input_price double, output_price double, cache_price double")
