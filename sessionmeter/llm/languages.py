"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters and single blanks; n-grams of one to three signs are hashed to
``BUCKETS`` features. Training counts every n-gram of every labelled text in its task and adds
the sums up in Spark: what reaches the driver is one row per language and bucket that occurs,
whatever the number of texts. The log-probability matrix (languages x buckets, as 32-bit
floats) is broadcast, its size checked against ``MAX_MATRIX``; scoring reads it with one sparse
gather and sum per batch.

Null texts and texts without a letter are ``und`` with score 0, as is everything if no text is
labelled. The score is the posterior probability of the language given. Ties go to the first
language in order. Rows without a label train nothing; repeated rows count repeatedly; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import as_bytes, slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bytes of the matrix that may be broadcast.
MAX_MATRIX = 256 << 20
SMOOTHING = 0.5
UNDETERMINED = "und"
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case form of each letter's code point, 32 for everything else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def features(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per order the buckets of all n-grams and the text each is from (ascending); texts with a letter."""
    signs = [np.frombuffer((" " + t.decode("utf-8", "replace") + " ").encode("utf-32-le", "replace"), "<u4") for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(s) for s in signs])
    code = _letters()[np.concatenate(signs)] if signs else np.zeros(0, np.uint32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (text[1:] != text[:-1])
    code, text = code[keep], text[keep]
    lettered = np.zeros(len(texts), bool)
    lettered[text[code != 32]] = True
    found = []
    for n in ORDERS:
        size = max(0, len(code) - n + 1)
        mixed = np.full(size, n, np.uint32)
        for i in range(n):
            mixed = (mixed ^ code[i:i + size]) * _FACTORS[i]
            mixed ^= mixed >> np.uint32(15)
        whole = text[:size] == text[n - 1:n - 1 + size]
        found.append((mixed[whole] & np.uint32(BUCKETS - 1), text[:size][whole]))
    return found, lettered


@dataclass
class Model:
    """``labels`` and, per bucket, the log-probability of each; ``prior`` is the log-share of its texts."""

    labels: list[str]
    weights: np.ndarray
    prior: np.ndarray


def train(docs: DataFrame) -> Model:
    """Fit on all rows of ``docs`` whose text and lang are not null."""
    labelled = docs.filter("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in slices(batches):
            grams, _ = features(as_bytes(batch.column("text")))
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            place = np.array([names.index(x) for x in langs], np.int64)
            found = sum(np.bincount(place[owner] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                        for bucket, owner in grams).reshape(-1, BUCKETS)
            for i, name in enumerate(names):
                sums[name] = sums.get(name, 0) + found[i]
                texts[name] = texts.get(name, 0) + int((place == i).sum())
            if len(sums) * BUCKETS * 8 > 64 << 20:  # many labels: hand on what is there
                yield from _counted(sums, texts)
                sums, texts = {}, {}
        yield from _counted(sums, texts)

    rows = (labelled.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    labels = [r["lang"] for r in rows.filter("bucket = -1").select("lang").orderBy("lang").limit(MAX_MATRIX // (4 * BUCKETS) + 1).collect()]
    if len(labels) * BUCKETS * 4 > MAX_MATRIX:
        raise ValueError(f"more than {MAX_MATRIX // (4 * BUCKETS)} labels")
    table = rows.toArrow()
    counts, texts = np.zeros((len(labels), BUCKETS)), np.zeros(len(labels))
    place = {name: i for i, name in enumerate(labels)}
    lang = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    counts[lang[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    texts[lang[bucket < 0]] = n[bucket < 0]
    smooth = counts + SMOOTHING
    weights = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if labels else counts
    prior = np.log(np.maximum(texts, 1) / max(1, texts.sum()))
    return Model(labels, np.ascontiguousarray(weights.T, np.float32), prior)


def _counted(sums: dict[str, np.ndarray], texts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for name, found in sums.items():
        there = np.flatnonzero(found)
        bucket = np.r_[-1, there].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(bucket), pa.string()), pa.array(bucket), pa.array(np.r_[texts[name], found[there]].astype(np.int64))],
            names=["lang", "bucket", "n"])


def score(texts: list[bytes], model: Model) -> tuple[list[str], np.ndarray]:
    if not model.labels:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    grams, lettered = features(texts)
    total = np.tile(model.prior, (len(texts), 1))
    for bucket, owner in grams:
        if not len(bucket):
            continue
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for i in range(len(model.labels)):
            total[owner[first], i] += np.add.reduceat(model.weights[bucket, i].astype(np.float64), first)
    best = total.argmax(axis=1)
    chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return ([model.labels[b] if has else UNDETERMINED for b, has in zip(best.tolist(), lettered.tolist(), strict=True)],
            np.where(lettered, chance, 0.0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score (replacing columns of these names); only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score")
    names = rest.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            labels, chance = score(as_bytes(batch.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(chance)],
                                             names=[*names, "lang_pred", "score"])

    return rest.mapInArrow(work, StructType([*rest.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """The fold that the contract keeps from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
