"""Writing rules: keep-first appends, project upserts, key checks and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.git import project_name, workspace_folder
from ..functions.scalars import payload_hash
from ..schemas import CASCADE, SET_NULL
from .ordered import first_per_key


def append_new(target: DataFrame, batch: DataFrame, keys: tuple[str | tuple[str, ...], ...] = ("dedup_key",),
               order: list[Column] | None = None) -> DataFrame:
    """Rows of a batch whose keys are new, the first of each; to be appended to the target.

    With several keys a row must be new in every one of them; a key may be several columns, none null.
    """
    order = order or [F.col("source_file"), F.col("source_line")]
    for key in keys:
        names = [key] if isinstance(key, str) else list(key)
        batch = first_per_key(batch, names, order).join(target.select(*names), names, "left_anti")
    return batch


def split_valid(child: DataFrame, parent: DataFrame, reference: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)`` by whether the row a reference names exists."""
    known = parent.select(F.col("id").alias(reference))
    bad = child.join(known, reference, "left_anti")
    return child.join(known, reference, "left_semi"), _reject(bad, "FOREIGN KEY constraint failed")


def split_unique(batch: DataFrame, target: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)`` by primary key: the first row of an id wins, the others are recorded.

    A row that repeats a dedup key is dropped silently before.
    """
    fresh = append_new(target, batch, ("dedup_key",), order)
    clash = fresh.join(target.select("id"), "id", "left_semi")
    rest = fresh.join(target.select("id"), "id", "left_anti")
    first = first_per_key(rest, ["id"], order)
    later = rest.join(first.select("dedup_key"), "dedup_key", "left_anti")
    return first, _reject(clash.unionByName(later), "UNIQUE constraint failed: id")


def _reject(df: DataFrame, reason: str) -> DataFrame:
    return df.select(F.col("source_file").alias("file"), F.col("source_line").alias("line"),
                     F.lit(reason).alias("error"), F.lit(None).cast("string").alias("raw"))


def with_project(session: DataFrame, remotes: DataFrame | None = None) -> DataFrame:
    """Add project and ref: one project per remote, else per workspace folder, else per path.

    ``remotes`` maps a folder to its normalised remote (of several, the first in order counts);
    finding remotes on disk is up to the caller.
    """
    base = session.drop("project_id", "project_ref_id", "git_remote", "project_name")
    if remotes is None:
        base = base.withColumn("git_remote", F.lit(None).cast("string"))
    else:
        one = first_per_key(remotes.select("cwd", "git_remote"), ["cwd"], [F.col("git_remote").asc_nulls_last()])
        base = base.join(one, "cwd", "left")
    cwd, remote = F.col("cwd"), F.col("git_remote")
    base = base.withColumn("project_name", project_name(cwd, remote))
    project = (F.when(remote.isNotNull(), payload_hash({"git_remote": remote}, 16))
               .when(workspace_folder(cwd).isNotNull(), payload_hash({"conductor_project": workspace_folder(cwd)}, 16))
               .otherwise(payload_hash({"name": F.col("project_name"), "root_path": cwd}, 16)))
    base = base.withColumn("project_id", project)
    return base.withColumn("project_ref_id", payload_hash(
        {"project_id": F.col("project_id"), "branch": F.col("git_branch"), "cwd": cwd}, 16))


def _arrivals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows arrive before all others."""
    first = old.withColumn("arrival", F.lit(None).cast(new.schema["arrival"].dataType)).withColumn("turn", F.lit(0))
    return first.unionByName(new.withColumn("turn", F.lit(1)))


def _merge(old: DataFrame, new: DataFrame, newest: list[str], kept: list[str]) -> DataFrame:
    """Upsert in arrival order. ``newest`` columns follow the last row, ``kept`` the last non-null."""
    at = F.struct("turn", "arrival")
    last = [F.max_by(c, at).alias(c) for c in newest]
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in kept]
    return _arrivals(old, new).groupBy("id").agg(
        *last, *known, F.min("first_seen_ts").alias("first_seen_ts"), F.max("last_seen_ts").alias("last_seen_ts"))


def merge_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Projects after an upsert. ``new`` has a unique, sortable column ``arrival``."""
    return _merge(old, new, ["name"], ["root_path", "git_remote"]).select(
        "id", "name", "root_path", "git_remote", "first_seen_ts", "last_seen_ts")


def merge_refs(old: DataFrame, new: DataFrame) -> DataFrame:
    return _merge(old, new, ["project_id"], ["branch", "commit", "cwd"]).select(
        "id", "project_id", "branch", "commit", "cwd", "first_seen_ts", "last_seen_ts")


def project_rows(session: DataFrame, arrival: Column) -> DataFrame:
    """Project rows as sessions with derived projects bring them in."""
    return session.select(F.col("project_id").alias("id"), F.col("project_name").alias("name"),
                          F.col("cwd").alias("root_path"), "git_remote", F.col("ts").alias("first_seen_ts"),
                          F.col("ts").alias("last_seen_ts"), arrival.alias("arrival"))


def ref_rows(session: DataFrame, arrival: Column) -> DataFrame:
    return session.select(F.col("project_ref_id").alias("id"), "project_id", F.col("git_branch").alias("branch"),
                          F.col("git_commit").alias("commit"), "cwd", F.col("ts").alias("first_seen_ts"),
                          F.col("ts").alias("last_seen_ts"), arrival.alias("arrival"))


def backfill_projects(session: DataFrame, remotes: DataFrame | None = None, everything: bool = False) -> DataFrame:
    """Derive projects of sessions that have none, or again of all with a folder.

    The result has all sessions, with ``changed`` marking the rows derived anew.
    """
    again = F.col("cwd") != "" if everything else F.col("project_id").isNull()
    again = F.coalesce(again, F.lit(False))
    derived = with_project(session.filter(again), remotes).withColumn("changed", F.lit(True))
    rest = session.filter(~again).withColumn("changed", F.lit(False))
    return rest.unionByName(derived.select(*rest.columns))


def delete_cascade(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting rows by id: dependants go too, or lose their reference."""
    out = dict(tables)
    gone = ids.select("id").distinct()
    out[table] = out[table].join(gone, "id", "left_anti")
    for child, column in CASCADE.get(table, {}).items():
        if child not in out:
            continue
        lost = out[child].join(gone.withColumnRenamed("id", column), column, "left_semi").select("id")
        out = delete_cascade(out, child, lost)
    for child, column in SET_NULL.get(table, {}).items():
        if child in out:
            order = out[child].columns
            # Rows without a reference have none to lose; in the join they would all meet in one task.
            free, bound = out[child].filter(F.col(column).isNull()), out[child].filter(F.col(column).isNotNull())
            marked = bound.join(gone.select(F.col("id").alias(column), F.lit(True).alias("_gone")), column, "left")
            out[child] = free.unionByName(marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*order))
    return out


def by_id(table: DataFrame, key: str) -> DataFrame:
    """Lookup of one row; the comparison reaches the Parquet scan."""
    return table.filter(F.col("id") == key)
