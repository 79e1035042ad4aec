"""Turn repair, token counts and periodic runs against plain versions, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionmeter.llm import mergetables, periodicruns, queries, tokencounts, turnrepair, wordtokens

from .test_operators import TEXTS, docs, nothing, prose, sha  # noqa: F401  fixtures

WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string, code int, cost string, pass int"


# --- op11 ---

def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Left-to-right search over (row, state) with whole audits, instead of spans."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    faults, seen = [], set()
    for role, text in rows:
        filled = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not filled else "duplicate" if (role, text) in seen else "truncated" if filled[-1] not in ".!?" else "")
        seen.add((role, text))

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                for to in "ua":
                    new = (cost + 3, audit + "I", [*lines, names[to] + ":"])
                    if (to := step.get((state, to))) and (to not in states or new < states[to]):
                        states[to] = new
        return states

    states = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def offer(state, new):
            if state is not None and (state not in after or new < after[state]):
                after[state] = new
        for state, (cost, audit, lines) in states.items():
            offer(state, (cost + 4, audit + "D", lines))
            if fault in ("", "truncated"):
                extra = 3 * bool(fault)
                offer(step.get((state, role[:1])), (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
                for to in "ua":
                    offer(step.get((state, to)), (cost + 3 + extra, audit + "R", [*lines, f"{names[to]}:{text}"]))
        states = inserted(after)
    cost, audit, lines = min(states[q] for q in ("", "a") if q in states)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    return counts, illegal, cost, audit, lines


def plain_report(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in plain_damage([r for r in rows if r[0] == conv])]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = {t for t, _, _ in own if t is not None}
        counts, illegal, cost, audit, lines = plain_repair([r[1:] for r in own])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, sha("\n".join(lines)))
    return out


def talk(rng: random.Random, conv: int | None, n: int):
    said = ["Yes.", "No!", "and then", "", " \t", "Why? ", "…", "ok.\n", "Well. then", None, "é"]
    return [(conv, None if rng.random() < 0.05 else rng.randrange(2 * n), rng.choice(["user", "assistant", "user", "assistant", "system", "User", "", None, "unknown"]),
             rng.choice(said) if rng.random() < 0.5 else f"text {rng.randrange(99)}.") for _ in range(n)]


def test_turn_repair_against_search(spark):
    rng = random.Random(5)
    rows = [r for conv in range(60) for r in talk(rng, conv if conv else None, rng.choice([1, 2, 3, 5, 9, 17, 40]))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"line {t}.") for t in range(300)]
    rows += [(101, 5, "user", "Same.")] * 4
    dropped = next(i for i in range(5000, 10**6) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows.append((dropped, 1, "user", "gone"))
    frame = spark.createDataFrame([(*r, 7, "x", 9) for r in rows], TURNS)
    found = turnrepair.digest(frame).collect()
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(found) == len(got) and got == plain_report(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", sha(""))
    texts: dict = {}
    for r in turnrepair.repaired(turnrepair.damaged(frame)).collect():
        texts.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    for conv, report in got.items():
        assert sha("\n".join(line for _, line in sorted(texts.get(conv, [])))) == report[-1]


def test_turn_repair_of_whole_conversations(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."),
            (2, 0, "user", "One."), (2, 1, "user", "Two."), (3, 0, "assistant", "Alone.")]
    frame = turnrepair.as_they_are(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: (r.cost, r.audit) for r in turnrepair.reports(frame).collect()}
    assert got == {1: (0, "KKK"), 2: (3, "KR"), 3: (3, "IK")}
    empty = spark.createDataFrame([], TURNS)
    assert turnrepair.digest(empty).collect() == turnrepair.repaired(turnrepair.as_they_are(empty)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=40))
def test_spans_give_the_cheapest_audit(codes):
    initials, texts = ["system", "user", "assistant", "?"], {0: "x{}.", 1: " ", 3: "x{}"}
    rows, twice = [], []
    for i, c in enumerate(codes):
        fault = 1 if c % 4 == 2 else c % 4
        rows.append((initials[c // 4], texts[fault].format(i)))
        twice.append(c - c % 4 + fault)
    _, _, cost, audit, _ = plain_repair(rows)
    assert turnrepair.cheapest(bytes(twice)) == (cost, audit.encode())


def test_long_conversation_is_parsed_in_linear_steps():
    codes = bytes(random.Random(2).choices([0, 4, 4, 8, 8, 12, 1, 7, 11], k=20_000))
    cost, audit = turnrepair.cheapest(codes)
    assert cost > 0 and len(audit) - audit.count(b"I") == len(codes)


# --- op12 ---

@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTE_MODEL)


def test_token_counts(docs, nothing, byte_tokenizer):  # noqa: F811
    extra = docs.withColumns({"n_bytes": F.lit("x"), "over_limit": F.lit("y")})
    found = Counter(tuple(r) for r in tokencounts.count_tokens(extra, BYTE_MODEL).collect())
    want = Counter()
    for d, t in TEXTS:
        n = len(byte_tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[(d, len((t or "").encode()), n, n > 512)] += 1
    assert found == want
    assert tokencounts.count_tokens(nothing, BYTE_MODEL).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(
    st.sampled_from(["<|endoftext|>", "<|endoftext", "<|startoftext|>", "'ll", "'s", "aaaa", "    ", "\r\n", "՘", "꟎", " the", "…"]),
    st.text(alphabet=st.one_of(st.sampled_from("etaoin srh  \n\t\x0b\x1c\x85\xa0　.,'_-0123456789éß日🙂\x00²½"),
                               st.characters(exclude_categories=["Cs"])), max_size=12)), max_size=8).map("".join))
def test_token_count_of_any_text(byte_tokenizer, text):
    assert tokencounts.counter(BYTE_MODEL).counts([text.encode()]) == [len(byte_tokenizer.encode(text, add_special_tokens=False).ids)]


def test_token_counts_of_very_long_pretokens(byte_tokenizer):
    rng = random.Random(4)
    texts = ["a" * 50_001, "ab" * 20_000, "".join(rng.choices("abcdefgh", k=60_000)), "=-" * 30_000 + "<|endoftext|>" * 7, "日本" * 9_000]
    want = [len(byte_tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokencounts.Counter(BYTE_MODEL).counts([t.encode() for t in texts]) == want


def test_merged_symbols_are_the_ids(byte_tokenizer):
    parts = [b"", b" whole", b"tokenization", b"", b"\xff\xfe", b" aaaaaaa", b""]
    symbols, counts = mergetables.Merges(BYTE_MODEL).apply(parts)
    plain = [p for p in parts if p and p != b"\xff\xfe"]
    want = [byte_tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in plain]
    at = 0
    for part, n in zip(parts, counts.tolist(), strict=True):
        if part in plain:
            assert symbols[at:at + n].tolist() == want[plain.index(part)]
        at += n
    assert at == len(symbols) and [n for p, n in zip(parts, counts) if not p] == [0, 0, 0]


# --- op13 ---

def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            own = w[i:j + q]
            if j > i and len(own) >= max(6, 4 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((i, len(own), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_run_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark, docs, nothing):  # noqa: F811
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randrange(40)) * rng.randrange(1, 9) + rng.choices("ab", k=30))) for i in range(1000, 1150)]
    rows += [(2000, "x " * 500 + "y " * 3 + "x y z " * 200), (2001, prose(9, 700))]
    table = docs.select("doc_id", "text", F.lit(1).alias("start"), F.lit("q").alias("period")).unionByName(
        spark.createDataFrame([(*r, 2, "r") for r in rows], "doc_id long, text string, start int, period string"))
    found = Counter(tuple(r) for r in periodicruns.digest(table).collect())
    assert found == Counter(plain_run_row(d, t) for d, t in [*TEXTS, *rows])
    assert periodicruns.digest(nothing).collect() == periodicruns.collapse(nothing).collect() == []
    kept = {r.doc_id: (r.runs, r.collapsed) for r in periodicruns.collapse(table).collect()}
    runs, text = kept[2000]
    assert [tuple(r) for r in runs][0] == (0, 500, 1) and text == "x y y y x y z"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 7)), max_size=8))
def test_all_runs_are_found(pieces):
    words = [str(x).encode() for block, times in pieces for x in block * times]
    (found, kept), (again, _) = periodicruns._results([words, words])
    assert found == again == plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    assert kept == [x for i, x in enumerate(words) if i not in gone]


def test_registered():
    assert {"op11_turn_repair", "op12_token_counts", "op13_periodic_runs"} <= set(queries.QUERIES)


# --- word tokens of op7 ---

@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD_MODEL)


def _word_ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in wordtokens.WordTokenizer(WORD_MODEL).encode([t.encode() for t in texts])]


def test_word_ids_with_special_tokens(word_library):
    texts = ["<|endoftext|>", "a<|startoftext|>b", "!<|endoftext|>!", "x <|endoftext|> y", "<|endoftext|><|startoftext|>", "<|ENDOFTEXT|>",
             "<|endof", "é<|endoftext|>", "", "'", "'l", "'ll", "it's'sx", "''s", "'reading", "ΑΣ", "é", "\0", "\0\0", "꟎ x",
             "averyveryveryverylongword", "averyveryveryverylongworD averyveryveryverylongwore", "a" * 30_000]
    assert _word_ids(texts) == [word_library.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_ids_of_random_strings(word_library):
    rng = random.Random(8)
    alphabet = [*"etaoin srh  ETS\n\t\r\x0b\x0c\x1c\x85\xa0　.,'_-=0123456789éÉßẞ日🙂\x00İΣσ's", "<|endoftext|>", "<|startoftext|>", "<|", "'ll", "'RE", "é"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(25))) for _ in range(20_000)]
    found = [ids for i in range(0, len(texts), 4000) for ids in _word_ids(texts[i:i + 4000])]
    assert found == [word_library.encode(t, add_special_tokens=False).ids for t in texts]


def test_alike_mixed_keys_are_told_apart(monkeypatch, word_library):
    monkeypatch.setattr(wordtokens, "_FACTORS", np.zeros(2, np.uint64))  # every key mixes to its size
    texts = ["one two six ten", "red tan"]
    assert _word_ids(texts) == [word_library.encode(t, add_special_tokens=False).ids for t in texts]
