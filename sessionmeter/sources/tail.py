"""Only what was appended to text files since the last run, in byte ranges.

The files to read are a table: path, size, and the offset and line where the last run ended. Spark cuts
what lies behind the offsets into ranges and deals them to tasks; a task seeks to its range and reads
the lines that begin in it. Neither file names nor contents pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed

#: Bytes of a range, and of one read call.
BLOCK, CHUNK = 64 << 20, 1 << 20
#: Rows up to which a frame with one row per range may be broadcast.
FEW = 100_000

_RAW = "path string, start long, n long, at long, size long, closed boolean, value string"


def open_anywhere(path: str):
    """A seekable input for a local path or a URI that Arrow's file systems know."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def changed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are new or differ from the ledger in size or time, with the place to go on from.

    ``files`` has ``path, size, mtime_ms``. A file that shrank begins anew. One that the ledger does not
    know to have been read from its start (``begun_at``) is read whole; the lines taken before are marked.
    """
    known = ledger.select("path", F.col("byte_offset").alias("known_bytes"), F.col("line_count").alias("known_lines"),
                          F.col("mtime_ms").alias("known_mtime"), "begun_at", F.coalesce("seen_size", "byte_offset").alias("seen_size"))
    shrank = F.col("size") < F.col("seen_size")
    goes_on = F.coalesce(~shrank & F.col("begun_at").isNotNull(), F.lit(False))
    return files.join(known, "path", "left").filter(
        F.col("known_bytes").isNull() | (F.col("size") != F.col("seen_size")) | ~F.col("mtime_ms").eqNullSafe(F.col("known_mtime"))
    ).select("path", "size", "mtime_ms", F.when(goes_on, F.col("begun_at")).alias("begun_at"),
             F.when(goes_on, F.col("known_bytes")).otherwise(F.lit(0)).cast("long").alias("from_byte"),
             F.when(goes_on, F.col("known_lines")).otherwise(F.lit(0)).cast("long").alias("from_line"),
             F.when(~shrank, F.col("known_lines")).otherwise(F.lit(0)).cast("long").alias("taken"))


def byte_ranges(changed: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, start, end, size: what lies behind the offsets, cut into blocks."""
    return changed.filter("size > from_byte").select(
        "path", "size", F.explode(F.sequence("from_byte", F.col("size") - 1, F.lit(block).cast("long"))).alias("start")).withColumn(
        "end", F.least(F.col("start") + block, F.col("size")))


def _lines_of(source, start: int, end: int, size: int) -> Iterator[tuple[int, int, bool, bytes]]:
    """(place, length with its end, whether it has one, text) of every line that begins in [start, end); a line may reach up to ``size``."""
    at = max(0, start - 1)  # the byte before tells whether a line begins here
    source.seek(at)
    rest, skipping, step = b"", start > 0, 512
    while at + len(rest) < size:
        here = at + len(rest)
        if here >= end:  # only to finish the last line
            step = min(2 * step, CHUNK)
        data = source.read(min(end - here if here < end else step, CHUNK, size - here))
        if not data:
            break
        rest += data
        if skipping:
            cut = rest.find(b"\n")
            if cut < 0:
                at, rest = at + len(rest), b""
                if at >= end:
                    return
                continue
            at, rest, skipping = at + cut + 1, rest[cut + 1:], False
        done = rest.rfind(b"\n") + 1
        for line in rest[:done].split(b"\n")[:-1]:
            if at >= end:
                return
            yield at, len(line) + 1, True, line
            at += len(line) + 1
        rest = rest[done:]
        if at >= end:
            return
    if rest and not skipping and at < end:
        yield at, len(rest), False, rest


def read_ranges(ranges: DataFrame, tasks: int, open_input: Callable = open_anywhere) -> DataFrame:
    """Lines of ranges: path, start (of the range), n (from 0 in the range), at (byte), size (with line end), closed, value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _RAW.split(", ")]
        for batch in batches:
            for path, start, end, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "size")), strict=True):
                rows, held = [], 0
                with open_input(path) as source:
                    for n, (at, length, closed, line) in enumerate(_lines_of(source, start, end, size)):
                        rows.append((path, start, n, at, length, closed, line.removesuffix(b"\r").decode(errors="replace")))
                        held += length
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return ranges.select("path", "start", "end", "size").repartition(tasks, "path", "start").mapInArrow(work, _RAW)


def read_new(changed: DataFrame, now_ms: int, whole_lines_only: bool = False, hold: Column | None = None, block: int = BLOCK,
             open_input: Callable = open_anywhere) -> tuple[DataFrame, DataFrame]:
    """``(lines, files)``: new lines with their numbers in the file, and what the ledger should say.

    ``changed`` comes from :func:`changed_files`, materialised. Every byte behind the offsets is read once. A first fragment,
    behind an offset in the middle of a line, belongs to a line already taken and is skipped.
    With ``whole_lines_only`` a last line without line end is left for the next run. With ``hold``, a condition on
    ``value``, the next run goes on from the last line that meets it: what that line opened may not be complete yet.
    """
    ranges = byte_ranges(changed, block)
    amount = ranges.count()
    raw = checkpointed(read_ranges(ranges, max(1, min(amount, 8 * changed.sparkSession.sparkContext.defaultParallelism)), open_input))
    if whole_lines_only:
        raw = raw.filter("closed")
    per_range = raw.groupBy("path", "start").agg(F.count("*").alias("lines"), F.max(F.col("at") + F.col("size")).alias("until"),
                                                *([] if hold is None else [F.max(F.when(hold, F.struct("at", "n"))).alias("held")]))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = checkpointed(per_range.join(changed.select("path", "from_line", "taken", "mtime_ms"), "path").withColumn(
        "base", F.col("from_line") + F.coalesce(F.sum("lines").over(before), F.lit(0))))
    if hold is None:
        ends = places.groupBy("path").agg(F.max("until").alias("until"), (F.max("from_line") + F.sum("lines")).alias("lines"))
    else:
        ends = places.groupBy("path").agg(F.max(F.when(F.col("held").isNotNull(), F.struct(
            F.col("held.at").alias("until"), (F.col("base") + F.col("held.n")).alias("lines")))).alias("last")).select("path", "last.*")
    files = changed.join(ends, "path", "left").select(
        "path", (F.col("size") if hold is None and not whole_lines_only else F.coalesce("until", "from_byte")).alias("byte_offset"),
        F.coalesce("lines", "from_line").alias("line_count"), "mtime_ms",
        F.coalesce("begun_at", F.lit(now_ms)).alias("begun_at"), F.col("size").alias("seen_size"))
    small = places.select("path", "start", "base", "taken", "mtime_ms")
    line = F.col("base") + F.col("n") + 1
    lines = raw.join(F.broadcast(small) if amount <= FEW else small, ["path", "start"]).select(
        F.col("path").alias("file"), line.alias("line"), "value", "mtime_ms", (line > F.coalesce("taken", F.lit(0))).alias("is_new"))
    return lines, files
