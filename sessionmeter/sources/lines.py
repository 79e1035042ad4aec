"""Numbered lines of text files, read in parallel splits.

Line tables have ``file, line, value, mtime_ms`` with lines counted from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed
from .tail import FEW


def discover(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    """Files below the roots by name pattern: ``path, size, mtime_ms``. Contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .load(roots).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"),
                                F.unix_millis("modificationTime").alias("mtime_ms")).orderBy("mtime_ms", "path"))


def _raw(spark: SparkSession, paths: list[str], glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    meta = lambda name: F.col("_metadata")[name]
    # The row id is taken right at the scan, where it counts the lines of a split in order.
    return reader.text(paths).select(
        meta("file_path").alias("uri"), meta("file_block_start").alias("block"), meta("file_size").alias("size"),
        F.unix_millis(meta("file_modification_time")).alias("mtime_ms"), "value",
        F.monotonically_increasing_id().alias("row_id"))


def _blocks(raw: DataFrame) -> DataFrame:
    """One row per split of a file, with the number of lines before it."""
    counted = raw.groupBy("uri", "block").agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_id"), F.max("size").alias("size"),
        F.max("mtime_ms").alias("mtime_ms"), F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.max_by(F.octet_length("value"), "row_id").alias("last_bytes"))
    whole = Window.partitionBy("uri")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .withColumn("total", F.sum("n").over(whole))
            .withColumn("open_end", F.sum("bytes").over(whole) > F.col("size"))
            .withColumn("path", _path(F.col("uri"))))


def _path(uri):
    """Plain path of a local file, the URI of any other."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, paths: list[str], glob: str | None = None, whole_lines_only: bool = False,
               ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(lines, files)``: numbered lines, and what the ledger should say about each file.

    With ``whole_lines_only`` a last line without line end is left for the next run. With a
    ledger the frame has a column ``is_new``: false for lines an earlier run has taken. A file
    that shrank is new from its first line.
    """
    raw = _raw(spark, paths, glob)
    blocks = _blocks(raw)
    if ledger is None:
        blocks = blocks.withColumn("taken", F.lit(0))
    else:
        known = ledger.select("path", F.col("byte_offset").alias("known_bytes"), "line_count")
        taken = F.when(F.col("size") >= F.col("known_bytes"), F.col("line_count")).otherwise(F.lit(0))
        blocks = blocks.join(known, "path", "left").withColumn("taken", F.coalesce(taken, F.lit(0)))
    kept = F.col("total") - F.col("open_end").cast("int") if whole_lines_only else F.col("total")
    blocks = blocks.withColumn("kept", kept)

    last = blocks.withColumn("rank", F.row_number().over(Window.partitionBy("uri").orderBy(F.col("block").desc()))) \
        .filter("rank = 1")
    left_over = F.when(F.col("open_end"), F.col("last_bytes")).otherwise(F.lit(0))
    files = last.select("path", (F.col("size") - (left_over if whole_lines_only else F.lit(0))).alias("byte_offset"),
                        F.col("kept").alias("line_count"), "mtime_ms")

    # One row per split, written once: its number is known, and the lines meet it without a shuffle of theirs.
    places = checkpointed(blocks.select("uri", "block", "path", "first_id", "base", "kept", "taken"))
    line = F.col("base") + F.col("row_id") - F.col("first_id") + 1
    lines = (raw.join(F.broadcast(places) if places.count() <= FEW else places, ["uri", "block"]).withColumn("line", line)
             .filter(F.col("line") <= F.col("kept"))
             .select(F.col("path").alias("file"), "line", F.regexp_replace("value", "\r$", "").alias("value"),
                     "mtime_ms", (F.col("line") > F.col("taken")).alias("is_new")))
    return lines, files


def session_lines(spark: SparkSession, root: str, **options) -> tuple[DataFrame, DataFrame]:
    """Lines of all session files below a folder. A last line without line end counts."""
    return read_lines(spark, [root], "*.jsonl", **options)


def tool_log_lines(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    return read_lines(spark, [path], whole_lines_only=True, **options)


def desktop_lines(spark: SparkSession, roots: list[str], glob: str, **options) -> tuple[DataFrame, DataFrame]:
    """Lines of all desktop logs below several folders whose names match the pattern."""
    return read_lines(spark, roots, glob, whole_lines_only=True, **options)
