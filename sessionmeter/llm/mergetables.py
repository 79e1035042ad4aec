"""Byte-pair merges over many short sequences at once, as ragged numpy arrays."""

from __future__ import annotations

import json

import numpy as np

#: Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as letters from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}

NEVER = np.int32(2**31 - 1)


class Merges:
    """The merge table of a byte-level BPE vocabulary file (the JSON form of the tokenizers library).

    Merging is *rank-synchronous*: in one round every sequence merges all places of its own
    lowest-ranked pair. That equals merging one place after the other from the left, because a
    merged symbol only takes part in pairs of higher rank, which the constructor checks.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"only plain byte-level BPE, not {model['type']} with {odd}")
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in stated["added_tokens"]):
            raise ValueError("added tokens must stand for exactly their own text")
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.inner = np.array([ids[BYTE_LETTERS[b]] for b in range(256)], np.int32)
        self.last = np.array([ids[BYTE_LETTERS[b] + end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or made.setdefault(a + b, rank) != rank:
                raise ValueError("a pair must rank after the merges that make its parts, and each symbol have one merge")
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        # Two bytes side by side in no symbol are never merged across: sequences are cut there.
        byte = {letter: b for b, letter in BYTE_LETTERS.items()}
        self.joined = np.zeros(1 << 16, bool)
        for word in made:
            own = [byte[c] for c in word.removesuffix(end)]
            self.joined[[a << 8 | b for a, b in zip(own, own[1:])]] = True

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def apply(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(symbols, counts)``: the symbols of all parts in a row, and how many each part has."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
        ends = np.cumsum(lengths)
        symbol = self.inner[data]
        final = ends[lengths > 0] - 1
        symbol[final] = self.last[data[final]]
        # opens: the symbol begins a sequence. at: the byte the symbol begins with, in all parts.
        opens = np.ones(len(data), bool)
        opens[1:] = ~self.joined[data[:-1].astype(np.int64) << 8 | data[1:]]
        opens[ends[:-1][ends[:-1] < len(data)]] = True
        at = np.arange(len(data))
        rank = np.full(len(data), NEVER, np.int32)
        inside = np.flatnonzero(~opens[1:])
        rank[inside] = self._rank(symbol[inside], symbol[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            starts = np.flatnonzero(opens)
            sizes = np.diff(starts, append=len(symbol))
            low = np.minimum.reduceat(rank, starts)
            idle = low == NEVER
            if idle.any():
                rest = np.repeat(idle, sizes)
                done.append((at[rest], symbol[rest]))
                if idle.all():
                    break
                symbol, opens, at, rank = (x[~rest] for x in (symbol, opens, at, rank))
                low, sizes = low[~idle], sizes[~idle]
            hit = rank == np.repeat(low, sizes)
            if (hit[1:] & hit[:-1]).any():  # a symbol repeated: every other place, from the left
                place = np.arange(len(hit))
                begun = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), place, 0))
                hit &= (place - begun) % 2 == 0
            symbol[hit] = self.merged[rank[hit]]
            stay = np.concatenate(([True], ~hit[:-1]))
            symbol, opens, at, rank, hit = (x[stay] for x in (symbol, opens, at, rank, hit))
            new = np.flatnonzero(hit)
            near = np.concatenate((new, new[~opens[new]] - 1))
            follows = near + 1 < len(symbol)
            follows[follows] = ~opens[near[follows] + 1]
            rank[near] = NEVER
            near = near[follows]
            rank[near] = self._rank(symbol[near], symbol[near + 1])
        place, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place, kind="stable")
        begins = np.searchsorted(place[order], ends - lengths)
        return symbol[order], np.diff(begins, append=len(place))
