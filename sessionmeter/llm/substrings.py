"""Repeated passages by De Bruijn compaction over tokens, in Spark joins.

Windows of ``window`` words are the edges of a De Bruijn graph. Handling each as a row would
move many times the text, so neighbouring windows travel together: every window names the
least of its K-word hashes as its anchor, and a run of windows with one anchor is a *piece*,
cut alike wherever the same words stand. Pieces are compacted edges: a name (128-bit hash of
the words they spell), an anchor, and source coordinates.

1. Pieces are counted by name: the least document of each, and how many names an anchor has.
2. Repeated pieces whose only successor and predecessor in all documents are each other are
   joined to paths (nonbranching runs of the graph). Their coordinates in each document are
   checked: a path counts only where its pieces stand one after the other.
3. An anchor with several names is a branching place: there passages begin, end or differ.
   Only there single windows are formed, one document per name, and joined by their hash.

The result is exact up to 128-bit hashes. Null and empty texts and those shorter than a window
repeat nothing. Equal rows repeat nothing of each other if they share their doc_id; rows of
one doc_id with different texts are kept apart by the MD5 digest of the text. Rows without a doc_id
are last in order. An empty table gives an empty one; other columns pass through, but for those
named like the columns added (n_words, n_removed, kept), which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


from .common import slices, stored

#: Words of an anchor. Shorter ones repeat by chance, longer ones cut more pieces.
K = 12
#: A piece has at most window - K + 1 windows; start and number travel in one long.
PACK = 256
#: What tells rows apart: doc_id, and two halves of a digest of the text.
KEY = ("doc", "r1", "r2")
#: Stands for a missing doc_id, after all others.
LAST = (1 << 63) - 1

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """First n powers of each base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 12) * 2
        found = []
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                factors = np.full(size, b, np.uint64)
                factors[0] = 1
                both.append(np.cumprod(factors))
            found.append(tuple(both))
        _POWERS[:] = found
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Spans:
    """Hashes of any span of a word sequence."""

    def __init__(self, words: list[bytes]):
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2).astype(np.uint64)
        self.sums = []
        for lane, (power, inverse) in enumerate(_powers(len(words) + 1)):
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(both[:, lane] * power[:len(words)], out=total[1:])
            self.sums.append((total, inverse))

    def name(self, start: np.ndarray, size, lane: int) -> np.ndarray:
        total, inverse = self.sums[lane]
        raw = (total[start + size] - total[start]) * inverse[start]
        return _mix(raw + np.asarray(size).astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def pieces(words: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Anchor, name (two longs), first window and number of windows of each piece of a text."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 2
    spans, k = Spans(words), min(K, window)
    grams = spans.name(np.arange(len(words) - k + 1), k, 0)
    # The hash above, the place below: the least is the first of equal ones.
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    reach, have = window - k + 1, 1
    while have < reach:
        step = min(have, reach - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    place = (key[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, n])
    size = count + window - 1
    return grams[place[first]], spans.name(first, size, 0), spans.name(first, size, 1), first, count


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _pieces_of(docs: DataFrame, window: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [pieces(t.split() if t else [], window) for t in texts]
            each = np.array([len(f[0]) for f in found], np.int64)
            doc, r1, r2 = (np.repeat(batch.column(c).to_numpy(), each) for c in KEY)
            anchor, s1, s2, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(r1), pa.array(r2), _longs(anchor), _longs(s1), _longs(s2), pa.array(first * PACK + count)],
                names=[*KEY, "anchor", "s1", "s2", "span"])

    return docs.select(*KEY, "text").mapInArrow(
        work, "doc long, r1 long, r2 long, anchor long, s1 long, s2 long, span long")


def _windows_of(pending: DataFrame, window: int) -> DataFrame:
    """A row for each window of the listed pieces (column spans) of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, w1, w2 = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                places = np.concatenate([np.arange(s // PACK, s // PACK + s % PACK) for s in spans])
                hashes = Spans(text.split())
                at.append(places)
                w1.append(hashes.name(places, window, 0))
                w2.append(hashes.name(places, window, 1))
            if at:
                each = np.array([len(p) for p in at], np.int64)
                keys = [pa.array(np.repeat(batch.column(c).to_numpy(), each)) for c in KEY]
                at, w1, w2 = map(np.concatenate, (at, w1, w2))
                yield pa.RecordBatch.from_arrays([*keys, pa.array(at), _longs(w1), _longs(w2)], names=[*KEY, "at", "w1", "w2"])

    return pending.select(*KEY, "text", "spans").mapInArrow(
        work, "doc long, r1 long, r2 long, at long, w1 long, w2 long")


NAME = ["s1", "s2"]


def _paths(seen: DataFrame) -> DataFrame:
    """Compact repeated pieces to nonbranching paths: name, path (two longs), words before it in the path."""
    order = Window.partitionBy(*KEY).orderBy("start")
    name = F.struct("s1", "s2")
    near = seen.select(
        *KEY, "start", "count", "s1", "s2",
        F.when(F.lead("start").over(order) == F.col("start") + F.col("count"), F.lead(name).over(order)).alias("after"),
        F.when(F.lag("start").over(order) + F.lag("count").over(order) == F.col("start"), F.lag(name).over(order)).alias("before"))
    only = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    edges = near.groupBy("s1", "s2").agg(
        only("after").alias("after"), only("before").alias("before"),
        F.min(F.struct(*KEY, "start", "count")).alias("source"))
    # A piece continues a path if its predecessor is the only one and has no other successor,
    # and if the first source of both has them one after the other.
    back = edges.select(F.col("after").alias("after_of"), F.struct("s1", "s2").alias("before"),
                        F.col("source").alias("source_before")).filter("after_of is not null")
    joined = edges.join(back, "before", "left").withColumn(
        "goes_on", F.coalesce((F.col("after_of") == F.struct("s1", "s2"))
                              & (F.col("source_before.doc") == F.col("source.doc"))
                              & (F.col("source_before.r1") == F.col("source.r1"))
                              & (F.col("source_before.r2") == F.col("source.r2"))
                              & (F.col("source_before.start") + F.col("source_before.count") == F.col("source.start")),
                              F.lit(False)))
    source = Window.partitionBy("source.doc", "source.r1", "source.r2").orderBy("source.start")
    begin = F.last(F.when(~F.col("goes_on"), F.struct(F.col("source.start").alias("start"), "s1", "s2")), ignorenulls=True).over(
        source.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.select("s1", "s2", F.col("source.start").alias("origin"), begin.alias("begin")).select(
        "s1", "s2", F.col("begin.s1").alias("p1"), F.col("begin.s2").alias("p2"),
        (F.col("origin") - F.col("begin.start")).alias("offset"))


def _keyed(docs: DataFrame, *others) -> DataFrame:
    """The key and the text, beside other columns given."""
    half = lambda k: F.coalesce(F.conv(F.substring(F.md5("text"), k, 16), 16, -10).cast("long"), F.lit(0))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), half(1).alias("r1"), half(17).alias("r2"),
                       "text", *others)


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """Maximal known runs of windows that a smaller document holds too.

    doc, r1, r2 (key of the text), start (word), count (windows; they cover count + window - 1
    words), first_doc (least document with the words), path (name of the compacted path; null
    for windows at branching places).
    """
    if not 1 <= window <= PACK:
        raise ValueError(f"windows may have 1 to {PACK} words")
    keyed = _keyed(docs)
    found = _pieces_of(keyed, window)
    names = found.groupBy("anchor", *NAME).agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    anchors = names.groupBy("anchor").agg(F.count("*").alias("names"), F.min("first_doc").alias("least"),
                                          F.max("last_doc").alias("most")).filter("least < most")
    told = stored(names.join(anchors, "anchor").select(
        "anchor", *NAME, "first_doc", (F.col("first_doc") < F.col("last_doc")).alias("repeated"),
        (F.col("names") > 1).alias("branching")))
    seen = stored(found.join(told, ["anchor", *NAME]).select(
        *KEY, *NAME, F.floor(F.col("span") / PACK).alias("start"), (F.col("span") % PACK).alias("count"),
        "first_doc", "repeated", "branching"))
    # Rows that repeat as a whole have the same pieces; one of each counts.
    copies = seen.filter("repeated").repartition(*KEY).dropDuplicates([*KEY, "start"])
    placed = copies.join(_paths(copies), NAME).select("*", (F.col("start") - F.col("offset")).alias("path_start"))
    # All pieces of one appearance of a path share path_start; together they cover it without a gap.
    path_spans = (placed.filter("first_doc < doc")
                  .groupBy(*KEY, "p1", "p2", "path_start").agg(
                      F.min("start").alias("start"), F.max(F.col("start") + F.col("count")).alias("end"),
                      F.sum("count").alias("total"), F.min("first_doc").alias("first_doc"),
                      F.collect_list(F.struct("start", "count")).alias("parts"))
                  # Coordinates that do not add up keep their pieces apart.
                  .select(*KEY, F.explode(F.when(F.col("end") - F.col("start") == F.col("total"), F.array(F.struct(
                      "start", F.col("total").alias("count")))).otherwise(F.col("parts"))).alias("part"), "first_doc", "p1", "p2")
                  .select(*KEY, "part.start", "part.count", "first_doc",
                          F.concat(F.hex("p1"), F.hex("p2")).alias("path")))
    pending = (seen.filter("branching and first_doc = doc").groupBy(*KEY)
               .agg(F.collect_set(F.col("start") * PACK + F.col("count")).alias("spans")))
    windows = stored(_windows_of(keyed.select(*KEY, "text").join(pending, [*KEY]), window))
    first = windows.groupBy("w1", "w2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).filter(
        "first_doc < last_doc").drop("last_doc")
    single = windows.join(first, ["w1", "w2"]).filter("first_doc < doc").select(
        *KEY, F.col("at").alias("start"), F.lit(1).cast("long").alias("count"), "first_doc", F.lit(None).cast("string").alias("path"))
    return path_spans.unionByName(single)


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Adds n_words, n_removed and kept: the words no span of ``repeated_spans`` covers, joined by spaces."""
    spans = repeated_spans(docs, window).groupBy(*KEY).agg(
        F.collect_list(F.col("start") * F.lit(1 << 32) + F.col("count")).alias("spans"))
    extra = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    held = "held"  # all other columns, so that none clashes with those used here
    packed = _keyed(docs, "doc_id", F.struct(*[F.col(f"`{f.name}`") for f in extra], F.lit(0)).alias(held))
    joined = packed.join(spans, list(KEY), "left").select("doc_id", "text", held, "spans")
    schema = joined.drop("spans").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, removed, kept = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                total.append(len(words))
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    values = np.array(spans, np.int64)
                    start = values >> 32
                    np.add.at(change, start, 1)
                    np.add.at(change, start + (values & 0xFFFFFFFF) + window - 1, -1)
                    stay = np.cumsum(change[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in schema), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*schema.names, "n_words", "n_removed", "kept"])


    out = StructType([*schema, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    done = joined.mapInArrow(work, out)
    return done.select("doc_id", "text", *[F.col(held)[f.name].alias(f.name) for f in extra if f.name not in ("n_words", "n_removed", "kept")],
                       "n_words", "n_removed", "kept")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
