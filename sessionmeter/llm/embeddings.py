"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations that make sign codes balanced and true to the vectors are learned (ITQ: alternate
between codes and the orthogonal Procrustes rotation) on at most ``SAMPLE`` vectors, those with
the smallest hashes; everything else covers all rows. Codes are cut into substrings; each is a
table, and vectors that share a substring (and label and dimension) meet there. Their cosines
are computed from the original vectors in double precision, and only those of at least the
threshold count: precision is exact. Substrings get longer with the logarithm of the number of
vectors, so that a bucket of unrelated vectors stays about the same size, and tables are added
from further rotations until a pair at the threshold meets in one with a probability of
``RECALL`` (bits differing independently with chance angle / pi).

A pair that meets in several tables counts in the first one, which its two codes tell, so pairs
are neither emitted nor deduplicated: each bucket yields a link count per vector and a spanning
forest of its links. Equal vectors are joined first and weigh as many as they are. Buckets over ``BLOCK``
rows are cut in blocks, and every pair of blocks is a task of its own: nothing is capped.

Null, empty and zero vectors, those with null or non-finite components, and those without a
label link with nothing and keep a row. Vectors of different lengths link with nothing of each
other. Rows that share a vec_id each keep a row; a null vec_id is compared like any other and
names a component only if all of it is null. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .simhash import _forest

THRESHOLD = 0.93
RECALL = 0.99
#: Vectors the rotation is learned from, at most.
SAMPLE = 20_000
ROUNDS = 30
#: Rows of a bucket that one task compares with each other, at most.
BLOCK = 2048


@dataclass
class Codes:
    """Rotations (each dimension x dimension), bits of a substring, and the number of tables."""

    rotations: list[np.ndarray]
    bits: int
    tables: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """A row of substring values per vector."""
        weights = (1 << np.arange(self.bits)).astype(np.int64)
        found = []
        for rotation in self.rotations:
            signs = vectors @ rotation > 0
            for i in range(0, signs.shape[1] - self.bits + 1, self.bits):
                found.append(signs[:, i:i + self.bits] @ weights)
                if len(found) == self.tables:
                    return np.stack(found, axis=1)
        return np.stack(found, axis=1)


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """ITQ on unit vectors: principal axes, then the rotation nearest to its own codes.

    The vectors are not centred: planes through the origin part two vectors with a chance that
    follows their angle, which the number of tables relies on. Around the mean of a dense group
    centred codes would be arbitrary.
    """
    size = sample.shape[1]
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    turned = sample @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0]
    for _ in range(rounds):
        codes = np.sign(turned @ rotation)
        left, _, right = np.linalg.svd(codes.T @ turned)
        rotation = (left @ right).T
    return axes @ rotation


def design(rows: int, size: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a substring and number of tables for so many vectors of a group."""
    bits = min(max(8, round(math.log2(max(rows, 1))) - 3), 24, size)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of an array column; shorter ones end in zeros."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), size))
    out[np.arange(size) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def fit(valid: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> Codes | None:
    """Learn codes for distinct vectors (``vector``, ``label``); None if there are none."""
    size = valid.agg(F.max(F.size("vector"))).first()[0]
    if size is None:
        return None
    largest = valid.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0]
    sample = valid.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toArrow().column("vector").combine_chunks()
    unit = _unit(_matrix(sample, size))
    bits, tables = design(largest, size, threshold, recall)
    rotations = [learn_rotation(unit, seed) for seed in range(-(-tables // (size // bits)))]
    return Codes(rotations, bits, tables)


def _compare(left, right, threshold: float, same: bool) -> tuple[np.ndarray, ...]:
    """Links within a block or between two: ids, links per row, and the least id connected to it by these links."""
    unit_l, code_l, weight_l, id_l, table = left
    unit_r, code_r, weight_r, id_r, _ = right
    linked = unit_l @ unit_r.T >= threshold
    if same:
        np.fill_diagonal(linked, False)
    a, b = np.nonzero(linked)
    earlier = (code_l[a, :table] == code_r[b, :table]).any(axis=1) if table else np.zeros(len(a), bool)
    a, b = a[~earlier], b[~earlier]
    count = np.zeros(len(id_l), np.int64)
    np.add.at(count, a, weight_r[b])
    ids = id_l
    if same:
        a, b = a[a < b], b[a < b]
    else:
        back = np.zeros(len(id_r), np.int64)
        np.add.at(back, b, weight_l[a])
        ids, count, b = np.r_[id_l, id_r], np.r_[count, back], b + len(id_l)
    # A link of every row to the least one connected with it is a spanning forest: no link found here is lost.
    order = np.argsort(ids)
    at = np.empty_like(order)
    at[order] = np.arange(len(order))
    return ids, count, ids[order[_forest(len(ids), at[a], at[b])[at]]]


def _links(distinct: DataFrame, codes: Codes, threshold: float) -> DataFrame:
    """rep, n (copies linked to it through a bucket), least (smallest rep connected with it there)."""
    size = len(codes.rotations[0])
    shared = distinct.sparkSession.sparkContext.broadcast(codes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.of(_unit(_matrix(batch.column("vector"), size)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int64()))],
                                             names=[*batch.schema.names, "codes"])

    coded = stored(distinct.mapInArrow(deal, "rep long, weight long, label string, vector array<double>, codes array<long>"))
    keys = coded.select("rep", "label", F.size("vector").alias("size"), F.posexplode("codes").alias("table", "value"))
    key = ["label", "size", "table", "value"]
    # Two rows at least make work; a row per bucket, so its size grows with the vectors and Spark chooses the join.
    sizes = keys.groupBy(key).count().filter("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    wide = coded.select("rep", "weight", "label", "vector", "codes", F.size("vector").alias("size"),
                        F.posexplode("codes").alias("table", "value"))
    dealt = wide.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = dealt.select("*", other.alias("other")).withColumns({
        "low": F.least("block", "other"), "high": F.greatest("block", "other")})
    groups = [*key, "low", "high"]
    ordered = sent.select("rep", "weight", "vector", "codes", "block", *groups).repartition(*groups).sortWithinPartitions(*groups)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            rep, weight, block = (table.column(c).to_numpy() for c in ("rep", "weight", "block"))
            unit = _unit(_matrix(table.column("vector").combine_chunks(), size))
            code = np.array(table.column("codes").to_pylist(), np.int64)
            position = at[2]
            pick = lambda chosen: (unit[chosen], code[chosen], weight[chosen], rep[chosen], position)
            low, high = at[4], at[5]
            one, two = (np.flatnonzero(block == k) for k in (low, high))
            ids, count, least = _compare(pick(one), pick(two), threshold, low == high)
            there = count > 0
            return pa.RecordBatch.from_arrays([pa.array(ids[there]), pa.array(count[there]), pa.array(least[there])],
                                              names=["rep", "n", "least"])

        for batch in batches:
            values = list(zip(*(batch.column(c).to_pylist() for c in groups), strict=True))
            start = 0
            for i in range(1, len(values) + 1):
                if i < len(values) and values[i] == values[start]:
                    continue
                if at is not None and values[start] != at:
                    yield close()
                    held = []
                at = values[start]
                held.append(batch.slice(start, i - start))
                start = i
        if held:
            yield close()

    return ordered.mapInArrow(work, "rep long, n long, least long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    # A row number keeps rows apart that share a vec_id; vec_id orders, the number breaks ties.
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                                 F.col("embedding").cast("array<double>").alias("vector"),
                                 F.monotonically_increasing_id().alias("row")))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.coalesce(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    valid = rows.filter(usable).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0
    distinct = stored(valid.groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("row").alias("rep"), F.min("vec_id").alias("first")))
    codes = fit(distinct, threshold, recall)
    if codes is None:
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.lit(True))
    found = stored(_links(distinct.select("rep", "weight", "label", "vector"), codes, threshold))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    named = (distinct.select("rep", "weight", "first").join(counts, "rep", "left")
             .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "component").select(
        "rep", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    members = valid.select("label", "vector", "row").join(distinct.select("label", "vector", "rep"), ["label", "vector"]).select("row", "rep")
    told = members.join(of, "rep").select("row", "n_links", "component_id")
    return rows.select("vec_id", "row").join(told, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
            "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
