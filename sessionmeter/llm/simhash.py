"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; a bit is set if it is set in over half the XXH64 values of the
text's word shingles. Two fingerprints within ``radius`` bits have a common variant that
differs from each by at most half of it, and two that share such a variant are within the
radius. So every distinct fingerprint emits all its variants within half the radius, equal
variants meet, and the pairs that meet are deduplicated and verified.

Shuffling each variant (2,081 for radius 4) would move far more than the texts. Variants are
shuffled by a check value of ``t`` parity bits instead: a change of one or two bits changes at
most two of them, so the variants of a fingerprint have 1 + t + t(t-1)/2 check values, the
fingerprint travels once to each, and its variants with that value are formed there. ``t``
grows with the logarithm of the number of fingerprints, so that a check value holds about the
same number of variants at every size. One that holds more works through them in passes.

Exact copies share a fingerprint and count once. Fingerprints that share a variant are linked
to the least of them, and only a spanning forest leaves each task: no group's pairs are formed.

Null and empty texts have no words and fingerprint zero, linked like any other; repeated rows
and rows that share a doc_id each keep a row; a null doc_id takes part but never names a
component that has another; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, stored
from .components import components

SEED = 42
#: Variants that one check value holds on average, and that one pass sorts at most.
TARGET, PASS = 1 << 21, 1 << 22


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """64-bit SimHash of a text in UTF-8; ASCII white space separates, A-Z are lower-cased."""
    words = text.lower().split()  # of bytes: ASCII only
    if not words:
        return 0
    line, k = b" ".join(words), words_per_shingle
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1:], strict=False)]
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for i in range(0, n, 1 << 14):
        bits = np.unpackbits(values[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i, c in enumerate(counts.tolist()) if 2 * c > n)


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """doc_id, text_key (a hash of the text, to tell rows of one doc_id apart), fingerprint (a signed long)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t, words_per_shingle) for t in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(prints.view(np.int64))],
                                             names=["doc_id", "text_key", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        work, "doc_id long, text_key long, fingerprint long")


def _parity_masks(t: int) -> list[int]:
    """The 64 bits dealt to ``t`` groups."""
    return [sum(1 << b for b in range(g, 64, t)) for g in range(t)]


def _deltas(t: int, half: int) -> list[int]:
    """Check values that up to ``half`` changed bits can add."""
    return [sum(1 << g for g in chosen) for n in range(half + 1) for chosen in combinations(range(t), n)]


@lru_cache(maxsize=4)
def _changes(t: int, half: int) -> dict[int, np.ndarray]:
    """All changes of up to ``half`` bits, by what they add to the check value."""
    by: dict[int, list[int]] = {}
    for n in range(half + 1):
        for bits in combinations(range(64), n):
            delta = 0
            for b in bits:
                delta ^= 1 << (b % t)
            by.setdefault(delta, []).append(sum(1 << b for b in bits))
    return {d: np.array(masks, np.uint64) for d, masks in by.items()}


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def meet(prints: np.ndarray, check: int, t: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among fingerprints whose variants meet under one check value."""
    half = radius // 2
    prints = np.unique(prints)
    own = np.zeros(len(prints), np.int64)
    for g, mask in enumerate(_parity_masks(t)):
        own |= (np.bitwise_count(prints & np.uint64(mask)).astype(np.int64) & 1) << g
    delta = own ^ check
    parts = [(np.flatnonzero(delta == d), masks) for d, masks in _changes(t, half).items()]
    parts = [(who, masks) for who, masks in parts if len(who)]
    total = sum(len(who) * len(masks) for who, masks in parts)
    passes = max(1, -(-total // PASS))
    links_a, links_b = [], []
    for turn in range(passes):
        values, owners = [], []
        for who, masks in parts:
            step = max(1, PASS // len(masks))
            for i in range(0, len(who), step):
                value = (prints[who[i:i + step], None] ^ masks[None, :]).ravel()
                owner = np.repeat(who[i:i + step], len(masks))
                if passes > 1:
                    mine = (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(passes) == turn
                    value, owner = value[mine], owner[mine]
                values.append(value)
                owners.append(owner)
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
        if len(first) == len(value):
            continue
        least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.r_[first, len(value)]))
        pair = np.unique(owner[owner != least] * len(prints) + least[owner != least])
        links_a.append(pair // len(prints))
        links_b.append(pair % len(prints))
    if not links_a:
        return prints[:0], prints[:0]
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
    label = _forest(len(prints), a[near], b[near])
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links a, b that connect what is connected among distinct fingerprints (column fingerprint)."""
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    variants = sum(math.comb(64, n) for n in range(half + 1))
    t = min(32, max(6, math.ceil(math.log2(max(1, distinct.count()) * variants / TARGET))))
    check = F.lit(0).cast("long")
    for g, mask in enumerate(_parity_masks(t)):
        signed = mask - (1 << 64) if mask >> 63 else mask
        check = check + F.shiftleft((F.bit_count(F.col("fingerprint").bitwiseAND(F.lit(signed).cast("long"))) % 2).cast("long"), g)
    sent = distinct.select("fingerprint", check.alias("own")).select("fingerprint", F.explode(F.transform(
        F.array(*[F.lit(d).cast("long") for d in _deltas(t, half)]), lambda d: d.bitwiseXOR(F.col("own")))).alias("check"))

    def work(key, group):
        a, b = meet(group.column("fingerprint").to_numpy().view(np.uint64), key[0].as_py(), t, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.groupBy("check").applyInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, text_key, fingerprint (long), group (one value per component), component_id.

    component_id is the smallest doc_id reachable by links.
    """
    prints = stored(fingerprints(docs, words_per_shingle))
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    joined = components(links(distinct, radius)).withColumnRenamed("node", "fingerprint")
    placed = distinct.join(joined, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of = placed.join(named, "component").select("fingerprint", F.col("component").alias("group"), "component_id")
    return prints.join(of, "fingerprint").select("doc_id", "text_key", "fingerprint", "group", "component_id")


def one_per_group(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """Of each component the row with the smallest doc_id, of equal ones that with the smallest text_key.

    Rows equal in doc_id and text count as one. Rows without a doc_id come last.
    """
    key = lambda doc, text: F.struct(doc.isNull().alias("none"), doc.alias("doc"), text.alias("text_key"))
    firsts = near_duplicates(docs, words_per_shingle, radius).groupBy("group").agg(
        F.min(key(F.col("doc_id"), F.col("text_key"))).alias("key")).select(
            F.coalesce("key.doc", F.lit(0)).alias("doc"), "key.none", "key.text_key")
    packed = docs.select(F.struct(*docs.columns).alias("held"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
                         F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("text_key"))
    names = ["doc", "none", "text_key"]
    return packed.join(firsts, names).dropDuplicates(names).select("held.*")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
