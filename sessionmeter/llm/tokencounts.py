"""Token counts of texts with a byte-level BPE vocabulary.

Texts are cut into the vocabulary's pre-tokens. The pre-tokens of a slice of rows that the worker
has not met lately are merged together in ragged arrays (``mergetables``): each round merges
every sequence's lowest-ranked pair at all its places, until none is left; what counts is how
many symbols survive. Counts are remembered per pre-token in a bounded map.

A special token's string inside a text is that one token, as the library reads it by default.
A null text counts as empty: no bytes, no tokens. Rows are independent: repeated rows repeat their
counts, an empty table gives an empty one, other columns are not read. A very long text is one
slice of its own; a very long pre-token is merged as many short sequences, since it is cut
wherever two bytes stand side by side in no symbol.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, slices
from .mergetables import Merges

#: Pre-tokens whose counts a worker remembers in one generation, about.
MEMORY = 200_000
LIMIT = 512

# How byte-level vocabularies of this kind cut a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{other}+|\s+(?!\S)|\s+"
_ASCII = re.compile(_PATTERN.format(L="[A-Za-z]", N="[0-9]", other=r"[^ \t-\rA-Za-z0-9]").replace(
    r"\s", r"[ \t-\r]").replace(r"\S", r"[^ \t-\r]").encode())


def _newer_letters(pre_tokenizer) -> list[str]:
    """Characters that the regex module takes for letters or digits but the tokenizer, of an older Unicode, does not."""
    unassigned = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
    return [c for c in regex.findall(r"[\p{L}\p{N}]", unassigned)
            if len(pre_tokenizer.pre_tokenize_str(f"!{c}!")) == 1]


class Counter:
    """Counts tokens of texts in UTF-8."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        cut = stated["pre_tokenizer"]
        if stated["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("only vocabularies that cut texts as they are, by the byte-level pattern")
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)).encode()) if special else None
        newer = _newer_letters(Tokenizer.from_file(path).pre_tokenizer)
        self.least = min(newer, default=chr(0x10FFFF))
        odd = "[" + "".join(map(regex.escape, newer)) + "]" if newer else "(?!)"
        plain = {"L": r"\p{L}", "N": r"\p{N}", "other": r"[^\s\p{L}\p{N}]"}
        self.unicode = regex.compile(_PATTERN.format(**plain))
        self.older = regex.compile(_PATTERN.format(
            L=rf"(?:(?!{odd})\p{{L}})", N=rf"(?:(?!{odd})\p{{N}})", other=rf"(?:[^\s\p{{L}}\p{{N}}]|{odd})"))
        self.known = Remembered(MEMORY)

    def _cut(self, text: bytes) -> list:
        """Pre-tokens: bytes of an ASCII text, strings of others."""
        if text.isascii():
            return _ASCII.findall(text)
        shown = text.decode()
        return (self.unicode if max(shown) < self.least else self.older).findall(shown)

    def counts(self, texts: list[bytes]) -> list[int]:
        cut, total = [], [0] * len(texts)
        for i, text in enumerate(texts):
            if self.special and b"<" in text and (found := self.special.findall(text)):
                total[i] = len(found)
                cut.append([p for piece in self.special.split(text) for p in self._cut(piece)])
            else:
                cut.append(self._cut(text))
        fresh = self.known.missing(set().union(*cut))
        _, sizes = self.merges.apply([p if isinstance(p, bytes) else p.encode() for p in fresh])
        self.known.young.update(zip(fresh, sizes.tolist(), strict=True))
        count = self.known.young.__getitem__
        return [n + sum(map(count, parts)) for n, parts in zip(total, cut, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer_path).counts
        for batch in slices(batches):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(counts(texts), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        work, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
