"""Periodic runs of words by a dictionary of basic factors.

For every power of two L the stretches of L words (basic factors) get names: equal stretches of one text,
equal names. A name for 2L is a pair of names for L, so each level costs one sort of the places whose
name occurs again; a stretch that stands only once in its text can be in no run at any longer length.
At each level every place is tied to its *successor*, the next place with its name, if that is at most
2L words on. Places whose successors are equally far apart form arithmetic progressions, and their
common difference d is the period they propose.

A run of smallest period q and at least 4q words is read off at the level with L/2 < q <= L: there, by
Fine and Wilf's theorem, a place of the run has its successor exactly q on (a nearer one would give the
whole run a smaller period), and at least q + 2 places of the run have one. So its proposals are one
unbroken row of places with difference q, which reaches exactly from the run's first word to L + q words
before its end: extension is to the end of that row, and no run is proposed twice or with a multiple of its period.

The same holds for every length of text; nothing is cut. A null or empty text has no words and no
runs. Rows are independent: repeated rows repeat their results, an empty table gives an empty one,
other columns are not read. Of runs with equal length/period the first, then the shorter period, counts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, slices

#: Words and periods of the shortest run.
LEAST, TIMES = 6, 4


def runs_of(words: np.ndarray, text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs, by start and period, in a row of texts.

    ``words`` are numbers of words, ``text`` ascending numbers of the texts they belong to; a run
    has ``least`` words and four periods or more and stays inside its text.
    """
    n = len(words)
    name = np.unique(text.astype(np.int64) << 32 | words.astype(np.int64), return_inverse=True)[1]
    place = np.arange(n)  # places whose name occurs again, ascending
    starts = np.searchsorted(text, text)  # first word of a place's text
    ends = np.searchsorted(text, text, "right")
    longest = int((ends - starts).max(initial=0))
    found: list[np.ndarray] = []
    length = 1
    while len(place) and length < longest:
        order = np.argsort(name, kind="stable")
        here, sorted_name = place[order], name[order]
        again = sorted_name[1:] == sorted_name[:-1]
        gap = np.full(len(order), 0)
        gap[:-1] = np.where(again & (here[1:] - here[:-1] <= 2 * length), here[1:] - here[:-1], 0)
        common = np.concatenate((again, [False])) | np.concatenate(([False], again))
        successor = np.zeros(len(order), np.int64)
        successor[order] = gap
        # Rows of neighbouring places with one difference propose it as their period.
        proposing = np.flatnonzero((successor > length // 2) & (successor <= length))
        if len(proposing):
            at, d = place[proposing], successor[proposing]
            breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(d) != 0)) + 1
            first, last = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(at)])) - 1
            total = at[last] - at[first] + length + d[first]
            long = (total >= TIMES * d[first]) & (total >= least)
            found.append(np.stack((at[first], total, d[first]))[:, long])
        # Names of twice the length, where both halves occur again and end inside the text.
        kept = np.zeros(len(order), bool)
        kept[order] = common
        place, name = place[kept], name[kept]
        whole = place + 2 * length <= ends[place]
        half = np.searchsorted(place, place + length)
        whole &= half < len(place)
        whole[whole] = place[half[whole]] == place[whole] + length
        pair = name[whole].astype(np.int64) << 32 | name[half[whole]]
        place, name = place[whole], np.unique(pair, return_inverse=True)[1]
        length *= 2
    start, total, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, start))
    return start[order], total[order], period[order]


def planted(words: list[bytes], doc_id: int) -> list[bytes]:
    """The words with the contract's repetition in a tenth of the documents."""
    hashed = zlib.crc32(str(doc_id).encode())
    n, g = len(words), hashed // 10
    if hashed % 10 or not n:
        return words
    a = g % n
    block = words[a:a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (block * (-(-(n - a) // len(block))))[:n - a]


def _results(texts: list[list[bytes]]) -> Iterator[tuple]:
    """Per text: runs (start, length, period), and the words left after dropping repetitions."""
    number: dict[bytes, int] = {}
    for words in texts:
        for w in words:
            number.setdefault(w, len(number))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    start, length, period = runs_of(words, text)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    stays = np.cumsum(change[:-1]) == 0
    begins = np.cumsum(sizes) - sizes
    bounds = np.searchsorted(start, np.append(begins, len(words)))
    for i, own in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            yield [], own
            continue
        found = list(zip((start[a:b] - begins[i]).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
        kept = stays[begins[i]:begins[i] + len(own)].tolist()
        yield found, [w for w, k in zip(own, kept, strict=True) if k]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple:
    best = runs[0]
    for run in runs[1:]:  # by start, then period: only a greater exponent replaces
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return (*best, 1000 * best[1] // best[2])


def collapse(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, runs (start, length, period of each), collapsed: the words no repetition drops.

    With ``plant`` the contract's repetitions are put in first.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, found in _worked(batches, plant):
            fields = [pa.array([[r[k] for r in runs] for runs, _ in found], pa.list_(pa.int64())) for k in range(3)]
            inner = pa.StructArray.from_arrays([f.flatten() for f in fields], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [doc, pa.ListArray.from_arrays(fields[0].offsets, inner),
                 pa.array([b" ".join(kept) for _, kept in found], pa.binary()).cast(pa.string())],
                names=["doc_id", "runs", "collapsed"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        work, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _worked(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[tuple]:
    for batch in slices(batches):
        texts = [t.split() for t in as_bytes(batch.column("text"))]
        if plant:
            texts = [t if d is None else planted(t, d) for d, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True)]
        yield batch.column("doc_id"), list(_results(texts))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract; a null doc_id plants nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for doc, found in _worked(batches, True):
            best = [_strongest(runs) if runs else (None,) * 4 for runs, _ in found]
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array([len(runs) for runs, _ in found], pa.int64()),
                 *(pa.array([b[k] for b in best], pa.int64()) for k in range(4)),
                 pa.array([sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()) for runs, _ in found]),
                 pa.array([sha(b" ".join(kept)) for _, kept in found])],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        work, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")
