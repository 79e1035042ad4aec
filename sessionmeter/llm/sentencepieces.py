"""SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

A text's merge encoding is the one sequence of pieces in which each neighbouring pair is
*compatible*: merging the pair's own text anew gives the same two pieces. So no merge queue over
the text is needed: Aho-Corasick finds all pieces at every position, the longest compatible
one is taken, and where none fits the search goes back a piece and marks the position in a bit
field, since the same position can never succeed later.

A text is cut where no piece found in it reaches across, for there nothing can ever be merged. All cuts
of the parts that a worker has not met lately are searched together, in arrays: in one round each
search takes, rejects or gives back one piece; the last few go on one by one. Encoded parts are
remembered, up to a limit. Characters outside the vocabulary become their bytes. Blanks become the
visible blank, with one put in front.

Models with a normalizer, without byte fallback or of another type are refused. Null texts
count as empty, which encode to the end id alone. Rows are independent; repeated rows repeat
their results, an empty table gives an empty one, other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, Remembered, as_bytes, slices

BLANK = "▁"
#: Parts of texts that a worker remembers in one generation, and places for tested pairs of pieces (a power of two, as its exponent).
MEMORY, PAIRS = 150_000, 20
SPREAD = 0x9E3779B97F4A7C15
#: So few searches go on one by one, since a round costs about as much for one as for this many.
FEW = 16
LOST = "a part of the text is no sequence of compatible pieces"
#: The rank of what is never merged.
NEVER = np.int32(2**31 - 1)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Pieces:
    """A model's vocabulary, with encoding and decoding.

    In arrays a piece goes by its number: longer pieces have higher ones, and 0 is no piece.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        # The library is asked for the vocabulary and for three facts about the model, not for encodings of texts.
        if model.normalize("ﬁ ①  x ") != f"{BLANK}ﬁ{BLANK}①{BLANK * 2}x{BLANK}":
            raise ValueError("only models that leave texts as they are, with a blank in front")
        of_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        if len(of_byte) != 256:
            raise ValueError("only models that fall back to bytes")
        self.bytes = np.array([of_byte[b] for b in range(256)], np.int32)
        self.eos = model.eos_id()
        usual = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id = {model.id_to_piece(i): i for i in usual}
        scores = {model.id_to_piece(i): model.get_score(i) for i in usual}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[score] for piece, score in scores.items()}
        self.text = {i: piece.replace(BLANK, " ").encode() for piece, i in self.id.items()}
        self.text |= {i: bytes([b]) for b, i in of_byte.items()}
        self.shown = [str(i).encode() for i in ids]
        # Bytes that an id takes in decimal with a blank, and decoded.
        self.widths = np.array([len(s) + 1 for s in self.shown]), np.array([len(self.text.get(i, b"")) for i in ids])
        blank_inside = any(BLANK in piece.lstrip(BLANK) for piece in self.id)
        letters = set().union(*self.id)
        # Where texts are cut to look parts up; longer parts only cost memory.
        self.part = re.compile(b"(?s).+" if blank_inside else b" *[^ ]+| +" if "\n" in letters else b" *[^ \n]+| +|\n")
        self.apart = next(c for c in map(chr, range(1, 0xD800)) if c not in letters).encode()
        self._number(letters)
        # Tested pairs, each at one place only, twice its key and 1 if compatible: a newer pair takes the place of an older one.
        self.pairs = np.full(1 << PAIRS, -1, np.int64)
        self.parts = Remembered(MEMORY)

    def _number(self, letters: set[str]) -> None:
        """Numbers of pieces and letters, and what is looked up by them."""
        symbols = ["", *sorted(letters.union(self.id), key=lambda s: (len(s), s))]
        number = {s: i for i, s in enumerate(symbols)}
        self.symbols = symbols
        self.ids = np.array([self.id.get(s, 0) for s in symbols], np.int32)
        self.size = np.array([len(s) for s in symbols], np.int32)
        # The next shorter piece with which a piece begins.
        self.shorter = np.array([next((number[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.id), 0) for s in symbols], np.int32)
        # Pieces of one character by their code; the others are found from behind, so that all with one beginning come together.
        self.single = np.zeros(0x110000, np.int32)
        self.finder = ahocorasick.Automaton()
        for piece in self.id:
            if len(piece) > 1:
                self.finder.add_word(piece[::-1], number[piece])
            else:
                self.single[ord(piece)] = number[piece]
        self.finder.make_automaton()
        merges = {number[s[:n]] * len(symbols) + number[s[n:]]: r
                  for s, r in self.rank.items() for n in range(1, len(s)) if s[:n] in number and s[n:] in number}
        self.merges = np.array(sorted(merges), np.int64)
        self.ranks = np.array([merges[k] for k in self.merges.tolist()], np.int32)
        # A piece's own merges, up to the last: rank of each, first and last symbol before it.
        own = [self._merges(s) for s in symbols]
        self.whole = np.array([len(steps) >= len(s) for steps, s in zip(own, symbols, strict=True)])
        steps = [(i, k, rank, number[first], number[last]) for i, found in enumerate(own) for k, (rank, first, last) in enumerate(found)]
        i, k, *values = np.array(steps, np.int32).T
        self.own, self.first, self.last = (np.full((len(symbols), k.max() + 1), NEVER) for _ in values)
        self.own[i, k], self.first[i, k], self.last[i, k] = values

    def _merges(self, text: str) -> list[tuple[int, str, str]]:
        """Plain merging, the best-ranked neighbours first, of equals the leftmost: rank, first and last symbol at each step.

        The last step merges nothing. A text that becomes one symbol has as many steps as characters.
        """
        found, steps = list(text) or [""], []
        while True:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(found, found[1:], strict=False)]
            low = min(ranks, default=NEVER)
            steps.append((low, found[0], found[-1]))
            if low == NEVER:
                return steps
            i = ranks.index(low)
            found[i:i + 2] = [found[i] + found[i + 1]]

    def _remerge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces gives these two.

        Until a merge reaches across, each side goes through its own merges; the better-ranked of both comes first.
        """
        fits = self.whole[left] & self.whole[right]
        rows = np.flatnonzero(fits & (left > 0))
        left, right = left[rows], right[rows]
        i, j = np.zeros_like(left), np.zeros_like(left)
        while len(rows):
            a, b = self.own[left, i], self.own[right, j]
            key = self.last[left, i] * np.int64(len(self.size)) + self.first[right, j]
            at = np.minimum(np.searchsorted(self.merges, key), len(self.merges) - 1)
            across = np.where(self.merges[at] == key, self.ranks[at], NEVER)
            bad = (across < a) & (across <= b)
            fits[rows[bad]] = False
            i, j = i + (a <= b), j + (a > b)
            more = ~bad & (np.minimum(a, b) < NEVER)
            rows, left, right, i, j = (x[more] for x in (rows, left, right, i, j))
        return fits

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As ``_remerge``, with a memory; left 0 is the beginning."""
        place = lambda k: (k.astype(np.uint64) * np.uint64(SPREAD) >> np.uint64(64 - PAIRS)).astype(np.int64)
        key = left * np.int64(len(self.size)) + right
        held = self.pairs[place(key)]
        fits = held & 1 > 0
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            found = self._remerge(*np.divmod(asked, len(self.size)))
            self.pairs[place(asked)] = asked * 2 + found
            fits[new] = found[back]
        return fits

    def _compatible(self, left: int, right: int) -> bool:
        """As ``compatible``, for one pair."""
        key = left * len(self.symbols) + right
        place = (key * SPREAD & (1 << 64) - 1) >> (64 - PAIRS)
        held = self.pairs.item(place)
        if held >> 1 != key:
            a, b = self.symbols[left], self.symbols[right]
            held = key * 2 + (self._merges(a + b)[-1][1:] == (a or b, b))
            self.pairs[place] = held
        return held & 1 > 0

    def longest(self, text: str) -> np.ndarray:
        """The longest piece at each position, 0 behind the last."""
        out = np.append(self.single[codes(text)], np.int32(0))
        found = np.fromiter(chain.from_iterable(self.finder.iter(text[::-1])), np.int64).reshape(-1, 2)
        if len(found):
            starts = np.flatnonzero(np.diff(found[:, 0], prepend=-1))
            out[len(text) - 1 - found[starts, 0]] = np.maximum.reduceat(found[:, 1], starts)
        return out

    def backtrack(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The piece that begins at each position, or 0; and where a character outside the vocabulary stands."""
        size = len(text)
        longest = self.longest(text)
        reach = np.maximum.accumulate(np.arange(size + 1) + self.size[longest])
        cut = np.concatenate(([True], reach[:-1] <= np.arange(1, size + 1)))
        # One place more than the text has, for what stands before a search's first piece.
        none = size + 1
        chosen, before, failed = np.zeros(size + 2, np.int32), np.full(size + 2, none), np.zeros(size + 2, bool)
        at = np.flatnonzero(cut & (longest > 0))
        piece, last = longest[at], np.zeros(len(at), np.int32)
        while len(at) > FEW:
            end = at + self.size[piece]
            fits = (piece > 0) & ~failed[end]
            tried = np.flatnonzero(fits)
            fits[tried] = self.compatible(last[tried], piece[tried])
            taken, stuck = np.flatnonzero(fits), np.flatnonzero(piece == 0)
            chosen[at[taken]], before[end[taken]] = piece[taken], at[taken]
            last = np.where(fits, piece, last)
            piece = np.where(fits, longest[end], self.shorter[piece])
            at, back = np.where(fits, end, at), before[at[stuck]]
            failed[at[stuck]] = True
            at[stuck], piece[stuck], last[stuck] = back, self.shorter[chosen[back]], chosen[before[back]]
            chosen[back] = 0
            lost, going = at == none, ~(fits & cut[at % none])
            if lost.any():
                raise ValueError(LOST)
            at, piece, last = at[going], piece[going], last[going]
        for state in zip(at.tolist(), piece.tolist(), last.tolist(), strict=True):
            self._alone(*map(memoryview, (longest, cut, chosen, before, failed, self.size, self.shorter)), *state)
        return chosen[:size], (cut & (longest == 0))[:size]

    def _alone(self, longest, cut, chosen, before, failed, sizes, shorter, at: int, piece: int, last: int) -> None:
        """Go on with one search to its end, as the rounds do."""
        none = len(cut)
        while True:
            if not piece:
                failed[at] = True
                at = before[at]
                if at == none:
                    raise ValueError(LOST)
                piece, last, chosen[at] = shorter[chosen[at]], chosen[before[at]], 0
                continue
            end = at + sizes[piece]
            if failed[end] or not self._compatible(last, piece):
                piece = shorter[piece]
                continue
            chosen[at], before[end] = piece, at
            at, last, piece = end, piece, longest[end]
            if cut[at]:
                return

    def _ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in a row, and how many each part has."""
        data = self.apart.join(parts)
        text = data.decode().replace(" ", BLANK)
        ends = np.cumsum([len(p) + len(self.apart) for p in parts])
        begun = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)))
        starts = np.concatenate(([0], begun[ends[:-1]]))
        piece, outside = self.backtrack(text)
        outside[starts[1:] - 1] = False
        code = codes(text)[outside]
        counts = (piece > 0).astype(np.int64)
        counts[outside] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        ids = np.repeat(self.ids[piece], counts)
        ids[np.repeat(outside, counts)] = self.bytes[np.frombuffer(code.tobytes().decode("utf-32-le").encode(), np.uint8)]
        return ids, np.add.reduceat(counts, starts)

    def remember(self, texts: list[list[bytes]]) -> dict[bytes, tuple[int, bytes, bytes]]:
        """Number of ids, ids in decimal and decoded text of all parts of some texts."""
        fresh = self.parts.missing(set().union(*texts))
        group = np.cumsum([len(p) for p in fresh]) // SLICE_BYTES
        edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(fresh)]
        for a, b in zip(edges, edges[1:], strict=False):
            parts = fresh[a:b]
            ids, counts = self._ids(parts)
            listed, ends = ids.tolist(), np.cumsum(counts) - 1
            shown = b" ".join(map(self.shown.__getitem__, listed))
            plain = b"".join(map(self.text.__getitem__, listed))
            to, till = (np.cumsum(w[ids])[ends].tolist() for w in self.widths)
            self.parts.young.update(
                (p, (n, shown[i:j - 1], plain[k:m]))
                for p, n, i, j, k, m in zip(parts, counts.tolist(), [0, *to], to, [0, *till], till, strict=False))
        return self.parts.young

    def _parts(self, text: bytes) -> list[bytes]:
        return self.part.findall(b" " + text.replace(BLANK.encode(), b" ")) if text else []

    def encode(self, text: bytes) -> tuple[int, bytes]:
        """Number of ids, and the ids in decimal with a blank between them; the end id is last."""
        return self.round_trips([text])[0][:2]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of ids; the blank put in front goes, control ids are silent, broken bytes become U+FFFD."""
        text = b"".join(self.text.get(i, b"") for i in ids)
        return text[text.startswith(b" "):].decode("utf-8", "replace").encode()

    def round_trips(self, texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """As ``encode``, and the decoded text; every part is decoded from its ids once."""
        parts = [self._parts(t) for t in texts]
        known = self.remember(parts).__getitem__
        end = str(self.eos).encode()
        out = []
        for ps in parts:
            counts, shown, plain = zip(*map(known, ps), strict=True) if ps else ((), (), ())
            decoded = b"".join(plain)
            out.append((sum(counts) + 1, b" ".join([*shown, end]), decoded[decoded.startswith(b" "):]))
        return out

    def round_trip(self, text: bytes) -> tuple[int, bytes, bytes]:
        return self.round_trips([text])[0]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array of int, the end id last)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in slices(batches):
            ids = [[int(i) for i in f[1].split()] for f in pieces.round_trips(as_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """The columns of the contract; ids stay in the task that made them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in slices(batches):
            found = pieces.round_trips(as_bytes(batch.column("text")))
            sha = lambda i: pa.array([hashlib.sha256(f[i]).hexdigest() for f in found], pa.string())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), sha(1), sha(2)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
