"""Token ids of many texts with a byte-pair vocabulary that drops white space.

A slice of texts is one array of code points: where their class changes, a *part* (a word, a digit, a row
of signs, a contraction) begins. Equal parts are found by sorting 16-byte keys, each different part is looked
up once, new ones are merged together in ragged arrays, and ids are gathered back into one array.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from .common import Remembered
from .mergetables import Merges

#: Parts whose ids a worker remembers in one generation, about.
PARTS = 200_000
SPACE, LETTER, DIGIT, SIGN, UNKNOWN = range(5)
KEY = 16
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _kinds() -> np.ndarray:
    """Class of every code point; those of an unassigned one are left to the library, which may know a newer Unicode."""
    kinds = np.full(0x110000, SIGN, np.uint8)
    for i in range(0x110000):
        category = unicodedata.category(chr(i))
        if category[0] in "LN":
            kinds[i] = LETTER if category[0] == "L" else DIGIT
        elif category == "Cn":
            kinds[i] = UNKNOWN
    # The white space of Unicode.
    kinds[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


class WordTokenizer:
    """Ids (little-endian unsigned 32 bits) as the tokenizers library gives them, special tokens in texts included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = Merges(path)
        special = map(re.escape, sorted(self.merges.special, key=len, reverse=True))
        self.special = re.compile("|".join(special)) if self.merges.special else re.compile("(?!)")
        self.kinds = _kinds()
        self.known = Remembered(PARTS)

    def _plain(self, text: str) -> bool:
        """Lower-casing letter by letter, no special token, nothing to compose."""
        return not self.special.search(text) and (
            text.isascii() or "Σ" not in text and unicodedata.is_normalized("NFC", text))

    def _bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last code point of every part."""
        kind = self.kinds[points]
        begins = kind != SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        quote = np.flatnonzero(begins[:-1] & (points[:-1] == ord("'")) & (kind[1:] == LETTER))
        if len(quote):  # 's 't 'm 'd 're 've 'll stand alone, whatever letters follow
            one, two = points[quote + 1], np.append(points, 0)[quote + 2]
            is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
            size = np.where(is_(one, "stmd"), 1, np.where(is_(one, "rv") & is_(two, "e") | is_(one, "l") & is_(two, "l"), 2, 0))
            quote, size = quote[size > 0], size[size > 0]
            begins[quote + 1] = False
            after = quote + 1 + size
            after = after[after < len(points)]
            begins[after[kind[after] == LETTER]] = True
        last = kind != SPACE
        last[:-1] &= begins[1:] | (kind[1:] == SPACE)
        return np.flatnonzero(begins), np.flatnonzero(last) + 1

    def _distinct(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place of every different part, and which of them each part is."""
        size = end - start
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(KEY), np.uint8), KEY)
        key = windows[start].view("<u8")
        key[:, 0] &= _MASKS[np.minimum(size, 8)]
        key[:, 1] &= _MASKS[np.clip(size - 8, 0, 8)]
        number: dict[bytes, int] = {}
        for i in np.flatnonzero(size > KEY).tolist():  # beyond a key's reach: told apart by their text
            key[i] = number.setdefault(data[start[i]:end[i]], len(number)), 0
        mixed = key[:, 0] * _FACTORS[0]
        mixed ^= (mixed >> np.uint64(29)) + key[:, 1] * _FACTORS[1] + np.minimum(size, KEY + 1).astype(np.uint64)
        _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
        of = first[which]
        if (key[of] != key).any() or (size[of] != size).any():  # two keys mixed alike
            whole = np.column_stack((key, size.astype(np.uint64)))
            _, first, which = np.unique(whole, axis=0, return_index=True, return_inverse=True)
        return first, which

    def _encoded(self, texts: list[str]) -> list[bytes | None]:
        """Ids of plain texts in lower case; none for a text with a code point of no known class."""
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        data = joined.encode()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        if not len(points):
            return [b""] * len(texts)
        begin, end = self._bounds(points)
        at = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))))
        first, which = self._distinct(data, at[begin], at[end])
        parts = [data[a:b] for a, b in zip(at[begin[first]].tolist(), at[end[first]].tolist(), strict=True)]
        fresh = self.known.missing(set(parts))
        symbols, counts = self.merges.apply(fresh)
        packed, stops = symbols.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        self.known.young.update((p, packed[a:b]) for p, a, b in zip(fresh, [0, *stops], stops))
        found = list(map(self.known.young.__getitem__, parts))
        pool = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        offsets = np.cumsum(lengths) - lengths
        own = lengths[which]
        until = np.concatenate(([0], np.cumsum(own)))
        ids = pool[np.repeat(offsets[which] - until[:-1], own) + np.arange(until[-1])]
        bounds = until[np.searchsorted(begin, np.concatenate(([0], ends)))].tolist()
        odd = set(np.searchsorted(ends, np.flatnonzero(self.kinds[points] == UNKNOWN)).tolist())
        return [None if i in odd else ids[a:b].tobytes() for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        shown = [t.decode() for t in texts]
        plain = [i for i, t in enumerate(shown) if self._plain(t)]
        out: list[bytes | None] = [None] * len(texts)
        for i, ids in zip(plain, self._encoded([shown[i].lower() for i in plain]), strict=True):
            out[i] = ids
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if ids is None else ids
                for t, ids in zip(shown, out, strict=True)]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
