"""Project list, totals and detail, with checkouts of one repository merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.git import canonical_name, merge_key, with_canonical_name
from ..functions.scalars import call_ok, cost, count_if, day_text, or_zero, ratio, uncached
from ..functions.text import contains_ignoring_case
from ..operators.ordered import FEW, first_per_key
from ..operators.pages import page
from ..operators.pricing import with_price
from ..ranges import DateRange, Page
from ..runtime import checkpointed
from .usage import calls_per_session_model

SORT_KEYS = {"last_seen": "last_seen_ts", "first_seen": "first_seen_ts", "name": "name",
             "session_count": "session_count", "total_tokens": "total_tokens"}

_DISPLAY = ["name", "root_path", "git_remote"]


def _best_first() -> list[Column]:
    """Preferred display row: one with a remote, then the newest, then the smallest id."""
    return [(F.coalesce("git_remote", F.lit("")) != "").desc(), F.col("last_seen_ts").desc_nulls_last(), F.col("id")]


def merge_entities(project: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, entities)``: which entity each project id belongs to, and a row per entity.

    Projects are merged by normalised remote (or name), and those groups again by canonical
    name. An entity keeps its smallest project id.
    """
    keyed = project.withColumn("merge_key", merge_key(F.col("name"), F.col("git_remote")))
    groups = first_per_key(keyed, ["merge_key"], _best_first()).withColumn(
        "entity", canonical_name(F.col("name"), F.col("git_remote")))
    members = keyed.join(groups.select("merge_key", "entity"), "merge_key").select(
        F.col("id").alias("project_id"), "entity", "first_seen_ts", "last_seen_ts")
    shown = first_per_key(groups, ["entity"], _best_first()).select("entity", *_DISPLAY)
    spans = members.groupBy("entity").agg(
        F.min("project_id").alias("id"), F.count("*").alias("project_count"),
        F.min("first_seen_ts").alias("first_seen_ts"), F.max("last_seen_ts").alias("last_seen_ts"))
    entities = spans.join(shown, "entity").select(
        "entity", "id", "name", F.when(F.col("project_count") == 1, F.col("root_path")).alias("root_path"),
        "git_remote", "first_seen_ts", "last_seen_ts")
    return members.select("project_id", "entity"), entities


def _owned(session: DataFrame) -> DataFrame:
    return session.filter(F.col("project_id").isNotNull()).select(F.col("id").alias("session_id"), "project_id")


def _model_usage(session: DataFrame, model_call: DataFrame, rng: DateRange, *keys: str) -> DataFrame:
    """Token sums per key and model over sessions of a project, summed per session first."""
    per_session = calls_per_session_model(rng.filter(model_call))
    return per_session.join(_owned(session), "session_id").groupBy(*keys, "model").agg(
        F.sum("calls").alias("calls"), *[F.sum(t).alias(t) for t in
        ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")])


def _usage_cost() -> Column:
    return cost(uncached(F.col("input_tokens"), F.col("cached_input_tokens")), F.col("cached_input_tokens"),
                F.col("output_tokens") + F.col("reasoning_tokens"))


def _tool_usage(session: DataFrame, tool_call: DataFrame, rng: DateRange, *keys: str) -> DataFrame:
    per_session = rng.filter(tool_call, "start_ts").filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.count("*").alias("n"), count_if(call_ok()).alias("ok"))
    return per_session.join(_owned(session), "session_id").groupBy(*keys).agg(
        F.sum("n").alias("tool_call_count"), F.sum("ok").alias("ok_count"))


def projects_list(project: DataFrame, session: DataFrame, model_call: DataFrame, tool_call: DataFrame,
                  price: DataFrame, rng: DateRange = DateRange(), search: str | None = None,
                  sort_by: str = "last_seen", descending: bool = True, part: Page | None = None) -> DataFrame:
    """Merged projects that have a session in range, with usage, cost and success rate."""
    counted = rng.filter(session).filter(F.col("project_id").isNotNull()).groupBy("project_id").agg(
        F.count("*").alias("session_count"))
    used = project.join(counted.select(F.col("project_id").alias("id")), "id", "left_semi").filter(
        contains_ignoring_case(search, "name", "root_path", "git_remote"))
    members, entities = merge_entities(used)
    usage = with_price(_model_usage(session, model_call, rng, "project_id"), price).groupBy("project_id").agg(
        F.sum("calls").alias("model_call_count"), F.sum("total_tokens").alias("total_tokens"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("cached_input_tokens").alias("cached_input_tokens"),
        F.sum(_usage_cost()).alias("estimated_cost"))
    tools = _tool_usage(session, tool_call, rng, "project_id")
    facts = members
    for part_facts in (counted, usage, tools):
        facts = facts.join(part_facts, "project_id", "left")
    sums = ["session_count", "model_call_count", "tool_call_count", "total_tokens", "input_tokens",
            "cached_input_tokens", "estimated_cost", "ok_count"]
    merged = facts.groupBy("entity").agg(*[or_zero(F.sum(c)).alias(c) for c in sums])
    rows = entities.join(merged, "entity").select(
        "id", "name", "root_path", "git_remote", "first_seen_ts", "last_seen_ts", "session_count",
        "model_call_count", "tool_call_count", "total_tokens",
        ratio(F.col("cached_input_tokens"), F.col("input_tokens")).alias("cache_hit_rate"), "estimated_cost",
        ratio(F.col("ok_count"), F.col("tool_call_count")).alias("tool_success_rate"))
    key = F.col(SORT_KEYS[sort_by])
    return page(rows, [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("id")], part)


def projects_totals(project: DataFrame, session: DataFrame, model_call: DataFrame, tool_call: DataFrame,
                    price: DataFrame, rng: DateRange = DateRange(), search: str | None = None) -> DataFrame:
    """Rows ``metric, value`` over all projects; the project count is that of the merged list."""
    in_range = rng.filter(session).filter(F.col("project_id").isNotNull())
    used = project.join(in_range.select(F.col("project_id").alias("id")), "id", "left_semi").filter(
        contains_ignoring_case(search, "name", "root_path", "git_remote"))
    _, entities = merge_entities(used)
    usage = with_price(_model_usage(session, model_call, rng), price)
    one = lambda df, name, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    spent = usage.agg(or_zero(F.sum("total_tokens")).alias("tokens"), or_zero(F.sum(_usage_cost())).alias("spent")).select(
        F.inline(F.array(F.struct(F.lit("total_tokens").alias("metric"), F.col("tokens").cast("double").alias("value")),
                         F.struct(F.lit("total_cost").alias("metric"), F.col("spent").cast("double").alias("value")))))
    tools = _tool_usage(session, tool_call, rng, "project_id")
    return (one(entities, "total_projects", F.count("*"))
            .unionByName(one(in_range, "distinct_project_ids", F.count_distinct("project_id")))
            .unionByName(one(in_range, "total_sessions", F.count("*")))
            .unionByName(spent)
            .unionByName(one(tools, "avg_success_rate",
                             ratio(F.sum("ok_count"), F.sum("tool_call_count")))))


def project_group(project: DataFrame, project_id: str) -> DataFrame:
    """All project rows that share the canonical name of one id.

    Names take many patterns a row, and a file of projects has few splits, so the rows are dealt out first.
    """
    tasks = int(project.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = with_canonical_name(project.repartition(tasks), "canonical")
    wanted = named.filter(F.col("id") == project_id).select("canonical")
    return named.join(wanted, "canonical", "left_semi")


def _in_group(df: DataFrame, group: DataFrame) -> DataFrame:
    return df.join(group.select(F.col("id").alias("project_id")), "project_id", "left_semi")


def _few_or_all(found: DataFrame) -> DataFrame:
    """A stored frame, marked for a broadcast if it has few rows."""
    kept = checkpointed(found)
    return F.broadcast(kept) if kept.count() <= FEW else kept


def _group_sessions(session: DataFrame, group: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Sessions of a group, found once, and a function that cuts facts down to theirs before anything is summed.

    If they are many, facts are shuffled by session, which is how they are summed too.
    """
    own = _few_or_all(_in_group(session, group).select("id", "project_id", "ts"))
    ids = own.select(F.col("id").alias("session_id"))
    return own, lambda facts: facts.join(ids, "session_id", "left_semi")


def project_branches(group: DataFrame, project_ref: DataFrame, session: DataFrame,
                     rng: DateRange = DateRange()) -> DataFrame:
    """Refs of a project group with session count and commit, newest first.

    A session belongs to the ref it names, or, naming none, to every ref of its project whose
    branch is open or its own. Sessions of other groups are left out first, and both kinds are
    counted before they meet the refs, so nothing fans out.
    """
    refs = _few_or_all(_in_group(project_ref, group))
    sessions = rng.filter(session)
    facts = [F.count("*").alias("n"), F.max("git_commit").alias("newest")]
    known = refs.select(F.col("id").alias("project_ref_id"))
    named = sessions.join(known, "project_ref_id", "left_semi").groupBy(F.col("project_ref_id").alias("id")).agg(*facts)
    loose = _in_group(sessions.filter(F.col("project_ref_id").isNull()), group)
    any_branch = loose.groupBy("project_id").agg(*facts)
    by_branch = loose.filter(F.col("git_branch").isNotNull()).groupBy(
        "project_id", F.col("git_branch").alias("branch")).agg(*facts)
    counted = (named.select("id", "n", "newest")
               .unionByName(refs.filter(F.col("branch").isNull()).join(any_branch, "project_id").select("id", "n", "newest"))
               .unionByName(refs.join(by_branch, ["project_id", "branch"]).select("id", "n", "newest"))
               .groupBy("id").agg(F.sum("n").alias("n"), F.max("newest").alias("newest")))
    return (refs.join(counted, "id", "left")
            .orderBy(F.col("last_seen_ts").desc_nulls_last(), "id")
            .select("id", "branch", F.coalesce("commit", "newest").alias("commit"), or_zero(F.col("n")).alias("session_count")))


def project_models(group: DataFrame, session: DataFrame, model_call: DataFrame, price: DataFrame,
                   rng: DateRange = DateRange()) -> DataFrame:
    """Tokens and cost per model of a project group."""
    own, theirs = _group_sessions(session, group)
    usage = _model_usage(own, theirs(model_call), rng)
    named = F.when(F.col("model") != "", F.col("model"))
    return with_price(usage, price).select(
        F.coalesce(named, F.lit("Unknown")).alias("model"), F.col("total_tokens").alias("tokens"),
        F.coalesce(_usage_cost(), F.lit(0.0)).alias("cost")).orderBy(F.col("tokens").desc(), "model")


def project_history(group: DataFrame, session: DataFrame, rng: DateRange = DateRange()) -> DataFrame:
    """Sessions per UTC day of a project group."""
    return _in_group(rng.filter(session), group).groupBy(day_text(F.col("ts")).alias("date")).agg(
        F.count("*").alias("session_count")).orderBy("date")


def project_header(project_id: str, group: DataFrame, session: DataFrame, model_call: DataFrame,
                   tool_call: DataFrame, price: DataFrame, rng: DateRange = DateRange()) -> DataFrame:
    """The one row that heads a project's detail view."""
    tag = lambda df: df.withColumn("k", F.lit(1))
    group = _few_or_all(group)
    own, theirs = _group_sessions(session, group)
    usage = with_price(_model_usage(own, theirs(model_call), rng), price).agg(
        or_zero(F.sum("calls")).alias("model_call_count"), or_zero(F.sum("total_tokens")).alias("total_tokens"),
        or_zero(F.sum("input_tokens")).alias("input_tokens"),
        or_zero(F.sum("cached_input_tokens")).alias("cached_input_tokens"),
        F.coalesce(F.sum(_usage_cost()), F.lit(0.0)).alias("estimated_cost"))
    tools = _tool_usage(own, theirs(tool_call), rng, "project_id").agg(
        or_zero(F.sum("tool_call_count")).alias("tool_call_count"), or_zero(F.sum("ok_count")).alias("ok_count"))
    span = group.agg(F.count("*").alias("members"), F.min("first_seen_ts").alias("first_seen_ts"),
                     F.max("last_seen_ts").alias("last_seen_ts"))
    shown = first_per_key(tag(group), ["k"], _best_first()).select("k", *_DISPLAY)
    head = tag(span).join(shown, "k")
    for one in (rng.filter(own).agg(F.count("*").alias("session_count")), usage, tools):
        head = head.join(tag(one), "k")
    return head.select(
        F.lit(project_id).alias("id"), "name", F.when(F.col("members") == 1, F.col("root_path")).alias("root_path"),
        "git_remote", "first_seen_ts", "last_seen_ts", "session_count", "model_call_count", "tool_call_count",
        "total_tokens", ratio(F.col("cached_input_tokens"), F.col("input_tokens")).alias("cache_hit_rate"),
        "estimated_cost", ratio(F.col("ok_count"), F.col("tool_call_count")).alias("tool_success_rate"))
