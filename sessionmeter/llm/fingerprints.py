"""Document fingerprints by locally consistent parsing.

A text's code points are parsed to phrases level by level. On each level runs of one name are
joined, and deterministic coin tossing (the lowest bit in which a name differs from its left
neighbour, twice the place plus the bit, repeated) turns names into a few labels of which
neighbours differ; a phrase begins at every local maximum of these labels. A boundary depends
on a few neighbours only, so equal substrings are cut alike in their interior wherever they
stand, and a phrase's name (a hash of the names in it) is the same in all texts.

The fingerprint is a sketch of the phrases on all levels, each as often as it occurs: ``SLOTS``
one-byte values, each the remainder of the least name in its slot, 00 where no name falls.
Phrases of the first level, a few letters long and common to all texts, come after all others
and so only fill the slots of short texts. Likeness is the share of equal slots among those either uses: an estimate of how many
phrases two texts share. Equal texts have equal fingerprints; an empty text has only zeros.

Null texts count as empty. Rows are independent; repeated rows repeat their fingerprint; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices

SLOTS = 128
ROUNDS = 4
#: Code points parsed at a time; a longer text stands alone.
CHUNK = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors for the places in a phrase.
_PLACES = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _join_runs(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of one name becomes a name of its own, so that neighbours differ."""
    first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (text[1:] != text[:-1])])
    if len(first) == len(names):
        return names, text
    size = np.diff(np.r_[first, len(names)]).astype(np.uint64)
    joined = names[first]
    return np.where(size > 1, _mix(joined + size * _ODD), joined), text[first]


def _toss(names: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Labels below six or so, neighbours within a text distinct; the first name has no neighbour."""
    label = names
    for _ in range(ROUNDS):
        left = np.r_[label[:1], label[:-1]]
        different = label ^ left
        different[start] = label[start] | np.uint64(1) << np.uint64(63)
        place = np.bitwise_count((different & (~different + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        label = place * np.uint64(2) + ((label >> np.minimum(place, np.uint64(63))) & np.uint64(1))
    return label


def phrases(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level, and the text each is in."""
    names, text = _join_runs(names, text)
    start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    label = _toss(names, start)
    begins = np.zeros(len(names), bool)
    begins[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & (text[1:-1] == text[:-2]) & (text[1:-1] == text[2:])
    begins[start] = True
    first = np.flatnonzero(begins)
    size = np.diff(np.r_[first, len(names)])
    place = np.arange(len(names)) - np.repeat(first, size)
    return _mix(np.add.reduceat(_mix(names) * _PLACES[place & 63], first) + size.astype(np.uint64) * _ODD), text[first]


def sketches(codes: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS bytes per text, of its code points."""
    count = len(codes)
    best = np.full(count * SLOTS, np.iinfo(np.uint64).max)

    def note(names: np.ndarray, text: np.ndarray, last: bool) -> None:
        key = _mix(names + text.astype(np.uint64) * _ODD)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        nth = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        spread = _mix(names[order] ^ np.uint64(0x5851F42D4C957F2D) ^ (nth.astype(np.uint64) * _PLACES[1]))
        value = spread << np.uint64(7) >> np.uint64(1) | np.uint64(last) << np.uint64(63)
        np.minimum.at(best, text[order] * SLOTS + (spread >> np.uint64(57)).astype(np.int64), value)

    sizes = np.array([len(c) for c in codes], np.int64)
    text = np.repeat(np.arange(count), sizes)
    names = _mix(np.concatenate(codes).astype(np.uint64) + np.uint64(1)) if len(text) else np.zeros(0, np.uint64)
    level = 0
    while len(names):
        names, text = phrases(names, text)
        level += 1
        note(names, text, level == 1)
        # A text that is one phrase ends here.
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        whole = np.zeros(len(names), bool)
        whole[first[np.diff(np.r_[first, len(names)]) == 1]] = True
        names, text = names[~whole], text[~whole]
    value = (best % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    value[best == np.iinfo(np.uint64).max] = 0
    return value.reshape(count, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among used ones, row by row; two empty texts are alike."""
    used = (a != 0) | (b != 0)
    same = (a == b) & used
    total = used.sum(axis=1)
    return np.where(total > 0, same.sum(axis=1) / np.maximum(total, 1), 1.0)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def _sketched(texts: list[str]) -> np.ndarray:
    """Sketches of texts, as many at a time as CHUNK allows."""
    found, held, size = [], [], 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            found.append(sketches(held))
            held, size = [], 0
        held.append(_codes(t))
        size += len(t)
    if held:
        found.append(sketches(held))
    return np.concatenate(found) if found else np.zeros((0, SLOTS), np.uint8)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hexadecimal sketch) of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _sketched([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes().hex() for r in found], pa.string())],
                                             names=["doc_id", "fingerprint"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as much of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _constant(values: list[int | None], kind: str = "bigint") -> Column:
    """An array column that is one literal of the plan, however long it is."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _count_up_to(bounds: list[int], value: Column) -> Column:
    """Number of sorted bounds not above a value: first of every so many, then within those that follow."""
    width = max(1, math.isqrt(len(bounds)))
    reached = lambda among: F.size(F.filter(among, lambda b: b <= value))
    whole = reached(_constant(bounds[width - 1::width])) * width
    return whole + reached(F.slice(_constant(bounds), whole + 1, width))


def _in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """Texts in ranges of doc_id, each range ending with the first text of the next one.

    Range bounds are quantiles of doc_id (their number is that of the shuffle partitions), and
    one number per range tells where the next begins, so each text moves once. Both are array
    literals: the plan does not grow with the number of ranges. Rows without a doc_id come
    first; rows with one doc_id go by their text.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = rows.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = sorted({int(b) for b in bounds})
    count = len(bounds) + 1
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(_count_up_to(bounds, F.col("doc_id")) if bounds else F.lit(0))
    # Generated, so that the place is computed once and not in every expression that names it.
    rows = rows.select("*", F.explode(F.array(place)).alias("part"))
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"]
    firsts = dict(rows.groupBy("part").agg(first).collect())  # one row per range
    filled = sorted(firsts)
    before = dict(zip(filled, filled[-1:] + filled[:-1], strict=True))  # the last text is followed by the first
    of = lambda found, kind="bigint": F.element_at(_constant([found.get(i) for i in range(count)], kind), F.col("part") + 1)
    own = F.struct(F.col("part"), F.lit(False).alias("extra"))
    also = F.struct(of(before, "int").alias("part"), F.lit(True).alias("extra"))
    begins = of(firsts).eqNullSafe(F.col("doc_id"))
    out = rows.select("doc_id", "text", F.inline(F.when(begins, F.array(own, also)).otherwise(F.array(own))))
    return out.repartitionById(count, F.col("part")).sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), "text"), count


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every text against its edited form and against the next text.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    ordered, _ = _in_order(docs)

    def emit(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        own = _sketched([t for _, t, _ in rows])
        following = np.concatenate([own[1:], _sketched([rows[-1][2]])])
        changed = [edited(t, f) for _, t, f in rows]
        other = _sketched(changed)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
             pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
             pa.array([r.tobytes().hex() for r in own], pa.string()), pa.array([r.tobytes().hex() for r in other], pa.string()),
             pa.array(likeness(own, other)), pa.array(likeness(own, following))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, str] | None = None
        ready: list[tuple[int, str, str]] = []
        size, closed = 0, None
        for batch in slices(batches):
            for doc, text, part, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "extra")), strict=True):
                if closed == part:
                    continue  # only the first of the next range's rows is the next text
                if held is not None:
                    ready.append((*held, text))
                    size += len(text)
                held = None if extra else (doc, text)
                closed = part if extra else None
                if ready and (size >= CHUNK or extra):
                    yield emit(ready)
                    ready, size = [], 0

    return ordered.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                    "edited_fingerprint string, near_edited double, near_next double")
