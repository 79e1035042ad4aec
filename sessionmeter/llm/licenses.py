"""License scan: Aho-Corasick finds tags and notices, a shunting-yard parser reads expressions.

Whole texts are lower-cased (A-Z), turned into words of 0-9, a-z and non-ASCII characters, and
one automaton pass over the words finds notice phrases and the identifier tag. Where the tag
stands, the expression after it is cut from the text as written and parsed.

Null and empty texts have no words and no finds. Rows are independent: repeated rows give
repeated results, an empty table gives an empty one, other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

# Phrases of the base search and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices of well-known licenses.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TAG = "spdx license identifier"
TAG_TEXT = re.compile(rb"spdx-license-identifier\s*:", re.I)
#: What an expression may consist of; it ends with the line.
EXPRESSION = re.compile(rb"[ \t]*((?:[A-Za-z0-9.+:-]+|[()]|[ \t])*)")
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
CONFIDENCE = {"tag": 1.0, "base": 0.9, "notice": 0.7}

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def parse_expression(text: str):
    """Shunting-yard: license ids, ``and``/``or``/``with`` and brackets to a nested tuple.

    Returns a name or (operator, left, right). Reads as far as the text is a valid expression,
    so that prose after it does no harm; None if there is not even one license id.
    """
    output: list = []
    operators: list[str] = []
    whole = None
    operand_next = True

    def reduce_top() -> None:
        right, left = output.pop(), output.pop()
        output.append((operators.pop(), left, right))

    def value_now():
        """The value if the input ended here; None while a bracket is open."""
        if "(" in operators:
            return None
        held, waiting = list(output), list(operators)
        while waiting:
            right, left = held.pop(), held.pop()
            held.append((waiting.pop(), left, right))
        return held[0]

    for token in TOKEN.findall(text):
        word = token.lower()
        if operand_next:
            if token == "(":
                operators.append("(")
                continue
            if token == ")" or word in PRECEDENCE:
                break
            output.append(word.rstrip(".:"))
            operand_next = False
        elif token == ")":
            while operators and operators[-1] != "(":
                reduce_top()
            if not operators:
                break
            operators.pop()
        elif word in PRECEDENCE:
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[word]:
                reduce_top()
            operators.append(word)
            operand_next = True
            continue
        else:
            break
        whole = value_now() or whole
    return whole


def license_ids(tree) -> set[str]:
    """License names in an expression; the exception after ``with`` is not a license."""
    if tree is None:
        return set()
    if isinstance(tree, str):
        return {tree} if tree else set()
    operator, left, right = tree
    return license_ids(left) | (set() if operator == "with" else license_ids(right))


def allowed(tree, permitted: set[str]) -> bool:
    """Whether the expression can be satisfied with permitted licenses only."""
    if tree is None:
        return False
    if isinstance(tree, str):
        return tree in permitted
    operator, left, right = tree
    if operator == "with":
        return allowed(left, permitted)
    both = allowed(left, permitted), allowed(right, permitted)
    return any(both) if operator == "or" else all(both)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICES), ("tag", {TAG: None})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    found.make_automaton()
    return found


def scan(text: bytes) -> tuple[int, list[tuple[str, str, int]]]:
    """Number of words, and finds (kind, label, first word) of a text in UTF-8."""
    words = text.translate(_WORDS).split()
    # One character per byte: positions stay comparable and the phrases are ASCII.
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    finds, tagged = [], False
    at = word = 0
    for end, (kind, label, length) in automaton().iter(line):
        start = end - length
        if kind == "tag":
            tagged = True
            continue
        if start >= at:
            word, at = word + line.count(" ", at, start), start
            finds.append((kind, label, word))
        else:
            finds.append((kind, label, line.count(" ", 0, start)))
    if tagged:
        for match in TAG_TEXT.finditer(text):
            before = len(text[:match.start()].translate(_WORDS).split())
            tree = parse_expression(EXPRESSION.match(text, match.end())[1].decode("ascii"))
            finds += [("tag", name, before) for name in sorted(license_ids(tree))]
    return len(words), finds


_FOUND = "doc_id long, n_words long, finds array<struct<kind:string,label:string,word:long>>"


def license_finds(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and all finds: kind (tag, base, notice), label, index of the first word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64())]))
        for batch in slices(batches):
            results = [scan(text) for text in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in results], pa.int64()),
                 pa.array([[dict(zip(("kind", "label", "word"), f, strict=True)) for f in finds] for _, finds in results], kind)],
                names=["doc_id", "n_words", "finds"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, _FOUND)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract, from the operator's finds.

    score is that of the surest find: tag 1.0, phrase of the base search 0.9, other notice 0.7.
    """
    found = license_finds(docs)
    base = F.filter("finds", lambda f: f["kind"] == "base")
    labels = lambda finds: F.array_join(F.array_sort(F.array_distinct(F.transform(finds, lambda f: f["label"]))), ",")
    score = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda f: f["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda f: f["word"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("finds")).alias("labels"),
        F.coalesce(F.array_max(F.transform("finds", lambda f: score[f["kind"]])), F.lit(0.0)).alias("score"))
