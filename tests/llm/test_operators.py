"""The operators against plain versions, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionmeter.llm import (
    components, embeddings, fingerprints, languages, licenses, packing, pii, queries, sentencepieces, simhash, substrings, urls,
)

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, held string"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(n))


SHARED = prose(1000, 70)
TEXTS = [
    (1, prose(1, 120)), (2, prose(2, 40) + " " + SHARED + " " + prose(3, 40)), (3, prose(4, 10) + "\n" + SHARED),
    (4, prose(1, 120)), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r "), (8, "Released under the MIT License."),
    (9, "mail a@b.co_d@e.fr from 10.0.0.1, 999.1.1.1; card 4111 1111 1111 1111. Call +1 (555) 010-2030 now"),
    (10, "été ÉTÉ 日本語 🙂 cc by nc CC-BY-NC, Apache License, Version 2.0"), (11, "x"), (12, prose(5, 3000)),
    (13, prose(1, 119) + " changed"), (13, prose(6, 60)), (1, prose(1, 120)), (None, prose(7, 55)), (None, None),
    (14, "na " * 400), (15, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\ncode"),
    (16, "a" * 30000), (17, "DE89370400440532013000 and DE89370400440532013001"),
]


@pytest.fixture(scope="module")
def docs(spark):
    langs = [None if i % 5 == 4 else "en" for i in range(len(TEXTS))]
    return spark.createDataFrame([(d, t, lang, None, None, i, "h") for i, ((d, t), lang) in enumerate(zip(TEXTS, langs, strict=True))], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables(spark, nothing):
    for fn in (fingerprints.edited_pairs, fingerprints.fingerprints, simhash.digest, pii.digest, languages.digest,
               licenses.digest, substrings.digest):
        assert fn(nothing).collect() == []
    assert sentencepieces.digest(nothing, PIECE_MODEL).collect() == []
    assert packing.pack_documents(nothing, WORD_MODEL).collect() == []
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).collect() == []


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edited_fingerprints(spark, docs, parts):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        pairs = fingerprints.edited_pairs(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    found = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in pairs.collect()), key=str)
    rows = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    texts = [t or "" for _, t in rows]
    want = sorted(((d, len(t), sha(fingerprints.edited(t, texts[(i + 1) % len(texts)])))
                   for i, ((d, _), t) in enumerate(zip(rows, texts, strict=True))), key=str)
    assert found == want


def test_the_order_of_many_ranges_is_a_small_plan(spark):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    sizes = []
    try:
        for parts in (50, 3000):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = spark.range(20_000).selectExpr("id * 7 doc_id", "'t' text")
            ordered, count = fingerprints._in_order(rows)
            assert count > 0.9 * parts
            plan = ordered._jdf.queryExecution().analyzed()
            # Every expression is named in the text of the plan; the two constant texts of numbers are taken out.
            sizes.append(len(re.sub(r"null|[0-9, ]+", "", plan.toString())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert abs(sizes[0] - sizes[1]) < 200


def plain_sketch(text: str) -> bytes:
    """The fingerprint of one text, parsed name by name in plain integers."""
    whole, odd = (1 << 64) - 1, int(fingerprints._ODD)
    places = [int(p) for p in fingerprints._PLACES]

    def mix(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & whole
        return x ^ x >> 32

    def parse(names):
        runs = []
        for name in names:
            if runs and runs[-1][0] == name:
                runs[-1][1] += 1
            else:
                runs.append([name, 1])
        names = [name if n == 1 else mix(name + n * odd & whole) for name, n in runs]
        label = names
        for _ in range(fingerprints.ROUNDS):
            tossed = []
            for i, now in enumerate(label):
                differing = now ^ label[i - 1] if i else now | 1 << 63
                place = (differing & -differing).bit_length() - 1 if differing else 64
                tossed.append(2 * place + (now >> min(place, 63) & 1))
            label = tossed
        begins = [i for i in range(len(names)) if i == 0 or i < len(names) - 1 and label[i - 1] < label[i] > label[i + 1]]
        out = []
        for first, end in zip(begins, [*begins[1:], len(names)], strict=True):
            total = sum(mix(names[j]) * places[j - first & 63] for j in range(first, end))
            out.append(mix(total + (end - first) * odd & whole))
        return out

    best: dict[int, int] = {}
    names, level = [mix(ord(c) + 1) for c in text], 0
    while names:
        names, level = parse(names), level + 1
        seen = Counter()
        for name in names:
            spread = mix(name ^ 0x5851F42D4C957F2D ^ seen[name] * places[1] & whole)
            seen[name] += 1
            value = (spread << 7 & whole) >> 1 | (level == 1) << 63
            best[spread >> 57] = min(best.get(spread >> 57, whole), value)
        if len(names) == 1:
            break
    return bytes(best[i] % 255 + 1 if i in best else 0 for i in range(fingerprints.SLOTS))


def test_fingerprints_equal_a_plain_parser(docs):
    rng = np.random.default_rng(5)
    texts = ["", "a", "aaaa", "ab" * 300, *(t for _, t in TEXTS if t),
             *("".join(chr(97 + c) for c in rng.integers(0, k, n)) for k in (2, 4, 26) for n in (1, 2, 3, 7, 50, 400, 3000))]
    assert [r.tobytes() for r in fingerprints._sketched(texts)] == [plain_sketch(t) for t in texts]
    found = {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprints(docs).collect()}
    assert found == {(d, plain_sketch(t or "").hex()) for d, t in TEXTS}


def test_fingerprints_follow_likeness(docs):
    by = {}
    for r in fingerprints.fingerprints(docs).collect():
        by.setdefault(r.doc_id, []).append(r.fingerprint)
    assert by[1] == [by[4][0]] * 2 and set(by[6][0]) == {"0"} and by[11] != by[6]
    a, b, c = prose(11, 500), prose(12, 500), prose(13, 30)
    own, cut, moved, other = fingerprints._sketched([a, fingerprints.edited(a, b), c + a, b])[:, None]
    assert 0.2 < fingerprints.likeness(own, cut)[0] < 0.5
    assert fingerprints.likeness(own, moved)[0] > 0.8 and fingerprints.likeness(own, other)[0] < 0.1


def test_equal_substrings_have_equal_phrases():
    inner = prose(14, 300)
    codes = [np.frombuffer((p + inner).encode("utf-32-le"), "<u4").astype(np.uint64) for p in ("", "zz", "a longer start ")]
    names = [set(fingerprints.phrases(c, np.zeros(len(c), np.int64))[0].tolist()) for c in codes]
    assert len(names[0] & names[1] & names[2]) > 0.95 * len(names[0])


def plain_simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, linked) -> list[int]:
    label = list(range(len(keys)))
    for _ in keys:
        for i in range(len(keys)):
            for j in range(len(keys)):
                if linked(keys[i], keys[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_simhash(docs):
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest(docs).collect()), key=str)
    prints = [plain_simhash(t) for _, t in TEXTS]
    label = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {c: min((d for (d, _), k in zip(TEXTS, label, strict=True) if k == c and d is not None), default=None) for c in label}
    assert found == sorted(((d, f"{p:016x}", smallest[c]) for (d, _), p, c in zip(TEXTS, prints, label, strict=True)), key=str)


def test_ball_hashing_finds_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in range(7)]
    prints = np.unique(np.array(near, np.uint64))
    for t in (6, 9):
        label = np.arange(len(prints))
        for check in range(1 << t):
            for a, b in zip(*simhash.meet(prints, check, t, 4), strict=True):
                assert (int(a) ^ int(b)).bit_count() <= 64
                x, y = label[np.searchsorted(prints, a)], label[np.searchsorted(prints, b)]
                label[label == max(x, y)] = min(x, y)
        want = plain_components([int(p) for p in prints], lambda a, b: (a ^ b).bit_count() <= 4)
        assert len(set(zip(label.tolist(), want, strict=True))) == len(set(want)) == len(set(label.tolist()))


def test_a_large_ball_works_in_passes(monkeypatch):
    rng = np.random.default_rng(4)
    prints = np.unique(np.array([sum(1 << int(k) for k in rng.choice(64, 2, replace=False)) for _ in range(300)], np.uint64))
    whole = simhash.meet(prints, 0, 6, 4)
    monkeypatch.setattr(simhash, "PASS", 1 << 12)
    for a, b in zip(whole, simhash.meet(prints, 0, 6, 4), strict=True):
        assert np.array_equal(a, b)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)] + [(500, 500), (601, 600), (600, 601)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 180)}, 600: 600, 601: 600}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text: str) -> list[str]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and plain_luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD_TEXTS = [
    "a@b.c_d@e.f x@y @z.w a@b a@b.c.d.@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1 1..2.3.4.5", "🙂 +12 345 678 9)) +1((((( é +49 30 1234567-",
    "4111 1111 1111 1111x4111-1111-1111-1111,4111111111111111 4111  1111", "1 " * 5000, "%" * 3000 + "@", "+" + "(" * 3000, " ".join(["a@b.cc"] * 500),
]


def test_personal_data(spark, docs):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    for frame, texts in ((docs, TEXTS), (odd, list(enumerate(ODD_TEXTS)))):
        found = Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.digest(frame).collect())
        want = Counter()
        for d, t in texts:
            spans = plain_spans(t or "")
            want[(d, sha(",".join(spans)), *(sum(s.startswith(k) for s in spans) for k in PATTERNS))] += 1
        assert found == want


def test_checksums_context_and_redaction(spark, docs):
    by = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert by[17].spans == "iban:0:22"  # the other fails mod 97
    assert dict(zip((s.split(":")[0] for s in by[9].spans.split(",")), by[9].scores, strict=False))["phone"] == pytest.approx(0.8)
    done = pii.redact(docs)
    assert done.columns == docs.columns
    text = {r.row: r.text for r in done.collect()}
    assert text[8] == "mail [EMAIL][EMAIL] from [IP], 999.1.1.1; card [CARD]. Call [PHONE] now"
    assert text[4] is None and text[0] == TEXTS[0][1] and len(text) == len(TEXTS)


def test_language_held_out_accuracy(spark):
    table = queries.table(spark, "/root/testdata/sf0.001", "documents")
    rows = languages.digest(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_language_odd_rows(spark, docs, nothing):
    by = {r.row: r for r in languages.predict(docs, languages.train(docs)).collect()}
    assert by[0].lang_pred == "en" and by[0].score == 1.0 and by[0].held == "h"
    assert all(by[i].lang_pred == "und" and by[i].score == 0.0 for i in (4, 5, 6, 16))
    assert {r.lang_pred for r in languages.predict(docs, languages.train(nothing)).collect()} == {"und"}


def test_language_counts_are_naive_bayes(spark):
    frame = spark.createDataFrame([("ab ab", "x"), ("cd", "y"), ("cd", "y")], "text string, lang string")
    model = languages.train(frame)
    assert model.labels == ["x", "y"] and np.allclose(np.exp(model.prior), [1 / 3, 2 / 3])
    assert np.allclose(np.exp(model.weights.astype(float)).sum(axis=0), 1, atol=1e-3)
    labels, score = languages.score([b"AB", b"dc"], model)
    assert labels == ["x", "y"] and (score > 0.5).all()


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 16))
    vectors = np.concatenate([base, base[:30] + 0.12 * rng.standard_normal((30, 16)), base[:10], base[5:6].repeat(20, 0)])
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(vectors)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[0][1], None), (204, [None] + rows[0][1][1:], 0),
             (205, rows[0][1][:8], 0), (206, [float("inf")] * 16, 0), (None, rows[0][1], 0), (0, rows[0][1], 0), (207, [], 0)]
    found = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())

    def linked(a, b):
        if a is b or a[2] is None or a[2] != b[2] or not a[1] or not b[1] or len(a[1]) != len(b[1]):
            return False
        x, y = (np.array([np.nan if v is None else v for v in r[1]], float) for r in (a, b))
        if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
            return False
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93

    label = plain_components(rows, linked)
    smallest = {c: min((r[0] for r, k in zip(rows, label, strict=True) if k == c and r[0] is not None), default=None) for c in label}
    want = Counter((r[0], sum(linked(r, o) for o in rows), smallest[c], r[0] == smallest[c]) for r, c in zip(rows, label, strict=True))
    assert found == want


def test_embeddings_hot_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(9)
    rows = [(i, (np.ones(8) + 0.05 * rng.standard_normal(8)).tolist(), 1) for i in range(100)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(99, 0)}


@pytest.mark.parametrize("block", [2048, 2])
def test_embedding_chains_with_the_largest_id_in_the_middle(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    angles = [[0, 40, 20]] + [np.random.default_rng(k).permutation(np.arange(0, 12 * 20, 20)).tolist() for k in range(3)]
    rows = [(100 * k + i, [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))], k) for k, ds in enumerate(angles) for i, d in enumerate(ds)]
    label = plain_components(rows, lambda a, b: a is not b and a[2] == b[2] and np.dot(a[1], b[1]) >= 0.93)
    links = [sum(a is not b and a[2] == b[2] and np.dot(a[1], b[1]) >= 0.93 for b in rows) for a in rows]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=1 - 1e-9).collect()}
    assert found == {r[0]: (n, rows[c][0], rows[c][0] == r[0]) for r, n, c in zip(rows, links, label, strict=True)}


@pytest.mark.parametrize("same", [True, False])
def test_a_bucket_hands_on_all_that_is_connected(same):
    angles = np.radians(np.random.default_rng(4).permutation(np.arange(0, 300, 12)))
    unit, ids = np.stack([np.cos(angles), np.sin(angles)], 1), np.random.default_rng(5).permutation(len(angles)) + 10
    rows = (unit, np.zeros((len(ids), 1), np.int64), np.ones(len(ids), np.int64), ids, 0)
    half = lambda k: tuple(x[k::2] if isinstance(x, np.ndarray) else x for x in rows)
    one, two = (rows, rows) if same else (half(0), half(1))
    got, count, least = embeddings._compare(one, two, 0.93, same)
    places = {n: np.flatnonzero(ids == n)[0] for n in got}
    side = dict.fromkeys(got, 0) if same else {n: k for k, x in enumerate((one, two)) for n in x[3]}
    linked = lambda x, y: x != y and (same or side[x] != side[y]) and unit[places[x]] @ unit[places[y]] >= 0.93
    label = plain_components(list(got), linked)
    assert count.tolist() == [sum(linked(x, y) for y in got) for x in got]
    assert least.tolist() == [min(n for n, k in zip(got, label, strict=True) if k == c) for c in label]


def test_rotation_is_orthogonal_and_balanced():
    sample = np.random.default_rng(1).standard_normal((2000, 16))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    rotation = embeddings.learn_rotation(sample, 0)
    assert np.allclose(rotation @ rotation.T, np.eye(16)) and abs((sample @ rotation > 0).mean(axis=0) - 0.5).max() < 0.05


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def test_sentencepiece_digest(docs, library):
    want = Counter()
    for d, t in TEXTS:
        ids = library.encode(t or "", add_eos=True)
        want[(d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))] += 1
    assert Counter(tuple(r) for r in sentencepieces.digest(docs, PIECE_MODEL).collect()) == want
    back = sentencepieces.decode_documents(sentencepieces.encode_documents(docs, PIECE_MODEL), PIECE_MODEL)
    assert Counter(tuple(r) for r in back.collect()) == Counter((d, t or "") for d, t in TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("etaoin srh  \n\t.,'▁_-=0123456789éß日本🙂\x00"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_sentencepiece_any_text(library, text):
    pieces = sentencepieces.load(PIECE_MODEL)
    ids = library.encode(text, add_eos=True)
    count, shown, decoded = pieces.round_trip(text.encode())
    assert [int(i) for i in shown.split()] == ids and count == len(ids)
    assert decoded.decode() == library.decode(ids) == pieces.decode(ids).decode()


@pytest.mark.parametrize("few", [0, 16, 10**9])
def test_sentencepiece_searches_together(library, monkeypatch, few):
    """New parts are searched in rounds, not piece by piece in Python; by rounds or one by one the ids are the library's."""
    monkeypatch.setattr(sentencepieces, "FEW", few, raising=False)
    pieces = sentencepieces.Pieces(PIECE_MODEL)
    calls, compatible = [], pieces.compatible
    monkeypatch.setattr(pieces, "compatible", lambda *pair: calls.append(pair) or compatible(*pair))
    rng = np.random.default_rng(few % 7)
    kinds = [list("etaoinsrh  "), list("ab"), list("  \n="), list("日本語的是é🙂\x00\x01▁ "),
             [library.id_to_piece(i).replace("▁", " ") for i in range(300, 30000, 17)]]
    texts = [prose(few % 5, 2000), "", *["".join(rng.choice(kinds[i % 5], rng.integers(1, 50))) for i in range(1000)]]
    for text, (count, shown, decoded) in zip(texts, pieces.round_trips([t.encode() for t in texts]), strict=True):
        ids = library.encode(text, add_eos=True)
        assert [int(i) for i in shown.split()] == ids and count == len(ids) and decoded.decode() == library.decode(ids)
    assert len(calls) < 1000


def test_packing_digest(docs):
    tokenizer = Tokenizer.from_file(WORD_MODEL)
    rows = packing.pack_documents(docs, WORD_MODEL).collect()
    want = Counter()
    for d, t in TEXTS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[(d, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    counts = Counter(r.length for r in rows)
    assert len(by) == packing.lower_bound(counts, 2048)


def least_bins(lengths: list[int], capacity: int) -> int:
    best = len(lengths)

    def place(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bin_completion_is_optimal_on_small_cases(lengths):
    fillings = packing.plan(dict(Counter(lengths)), 20)
    used = Counter()
    for f in fillings:
        assert sum(n * c for n, c in f.parts) <= 20
        for n, c in f.parts:
            used[n] += c * f.times
    assert used == Counter(lengths)
    assert sum(f.times for f in fillings) == (least_bins(sorted(lengths, reverse=True), 20) if lengths else 0)


@pytest.mark.parametrize("counts", [
    {1: 3000}, {1: 100_000}, {1000: 100, 1: 5000}, {1025: 500, 1: 1_000_000, 700: 333}, dict.fromkeys(range(1, 400), 1_000_000)])
def test_packing_of_very_many_short_pieces(counts):
    fillings = packing.plan(dict(counts))
    used = Counter()
    for f in fillings:
        assert f.times > 0 and sum(n * c for n, c in f.parts) <= 2048
        for n, c in f.parts:
            used[n] += c * f.times
    assert used == counts
    assert sum(f.times for f in fillings) == packing.lower_bound(counts, 2048)


def test_packing_widens_the_search_until_the_bound():
    counts = {33: 1, 57: 2, 16: 1, 20: 2, 15: 1, 39: 2, 32: 2, 44: 2, 38: 1, 55: 1, 45: 2, 36: 1, 22: 1, 37: 1, 24: 1, 41: 1}
    fillings = packing.plan(dict(counts), 100)
    used = Counter()
    for f in fillings:
        assert sum(n * c for n, c in f.parts) <= 100
        for n, c in f.parts:
            used[n] += c * f.times
    assert used == counts and sum(f.times for f in fillings) == packing.lower_bound(counts, 100) == 8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_decreasing_by_piece(lengths):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(30 - n)
    fillings = packing.best_fit(dict(Counter(lengths)), 30)
    assert sorted(30 - sum(n * c for n, c in f.parts) for f in fillings for _ in range(f.times)) == sorted(rooms)


def test_packing_of_thousands_of_empty_texts(spark):
    rows = [(i, None if i % 2 else "") for i in range(5000)] + [(5000 + i, "x " * 999) for i in range(100)]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORD_MODEL).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in rows)
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = [offset + length for offset, length in sorted(places)]
        assert [offset for offset, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by) == packing.lower_bound(Counter(r.length for r in found), 2048)


def test_packing_ranks_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 2)
    ranks: dict[int, list[int]] = {}
    for r in packing._ranked(packing.pieces(docs.unionByName(docs), WORD_MODEL)).collect():
        ranks.setdefault(r.length, []).append(r["rank"])
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())


def test_url_rules(spark):
    pages = [
        "https://www.example.com/en/1", "http://EXAMPLE.com/en/", "https://a.example.com/en", "https://example.com", "http://x.net/es/a?b",
        "http://x.net/esa", "ftp://net/fr/", None, "", "no scheme", "http://notexample.com/en/", "http://spam-farm.example.org/en/1",
        "http://foo.net/x.com/", "http://a.com:80/", "http://com/", "x://y?z#com/", "http://x.net#/es/", "http://a.b\n.com/q",
    ]
    rows = [(i, u, "p") for i, u in enumerate(pages)] * 2
    found = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), queries.URL_RULES).collect()}
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    for i, url in enumerate(pages):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None), url
        assert r.verdict == (max(fits)[2] if fits else "block" if "spam" in host else "allow")


def test_url_rules_are_filed_under_rare_tokens(spark):
    counts = urls.token_counts(spark.createDataFrame([(["a", "b"],), (["b"],), (None,)], "tokens array<string>"), ["a", "b", "c"])
    assert counts == {"a": 1, "b": 2, "c": 0}
    assert urls.rule("example.com/en/a", "block").tokens == ["example", "com", "en"]


def plain_licenses(text: str | None):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    return (len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({h[1] for h in hits})))


def test_licenses(docs):
    rows = licenses.digest(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == Counter(
        (d, *plain_licenses(t)) for d, t in TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[15].labels == "apache-2.0,gpl-2.0,mit" and by[15].score == 1.0
    assert by[8].labels == "mit" and by[8].score == 0.9 and by[6].score == 0.0


def test_license_expressions():
    tree = licenses.parse_expression("MIT OR Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0")
    assert tree == ("or", "mit", ("and", "apache-2.0", ("with", "gpl-2.0", "classpath-exception-2.0")))
    assert licenses.allowed(tree, {"mit"}) and not licenses.allowed(tree, {"apache-2.0"})
    assert licenses.allowed(tree, {"apache-2.0", "gpl-2.0"}) and licenses.license_ids(tree) == {"mit", "apache-2.0", "gpl-2.0"}
    for text, want in (("", None), ("AND", None), ("(MIT", None), ("MIT)", "mit"), ("(MIT OR (ISC))", ("or", "mit", "isc")),
                       ("MIT OR", "mit"), ("MIT see file", "mit"), ("(" * 5 + "MIT" + ")" * 5, "mit")):
        assert licenses.parse_expression(text) == want, text


def plain_removed(rows):
    words = {(d, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    order = lambda d: (d is None, d or 0)
    first: dict[tuple, tuple] = {}
    for (d, _), w in words.items():
        for i in range(len(w) - 49):
            key = tuple(w[i:i + 50])
            first[key] = min(first.get(key, order(d)), order(d))
    out = Counter()
    for d, t in rows:
        w, gone = words[(d, t)], set()
        for i in range(len(w) - 49):
            if first[tuple(w[i:i + 50])] < order(d):
                gone.update(range(i, i + 50))
        out[(d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    return out


def test_substrings(docs):
    assert Counter(tuple(r) for r in substrings.digest(docs).collect()) == plain_removed(TEXTS)


def test_substrings_of_random_copies(spark):
    rng = np.random.default_rng(5)
    vocabulary = [chr(97 + i) for i in range(3)]
    base = [vocabulary[i] for i in rng.integers(0, 3, 400)]
    rows = []
    for d in range(40):
        a, b = sorted(rng.integers(0, 400, 2).tolist())
        rows.append((d, " ".join([*base[a:b], *[vocabulary[i] for i in rng.integers(0, 3, 30)], *base[:a]])))
    rows.append((40, " ".join(["a"] * 200)))
    rows.append((41, " ".join(["a"] * 90 + ["b"] + ["a"] * 49)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in substrings.digest(frame).collect()) == plain_removed(rows)


def test_repeated_spans_name_their_source(docs):
    spans = [r for r in substrings.repeated_spans(docs).collect() if r.doc == 3]
    assert {r.first_doc for r in spans} == {2}
    covered = {i for r in spans for i in range(r.start, r.start + r["count"])}
    assert covered == set(range(10, 31))  # windows of the shared passage, after ten words
    whole = [r for r in substrings.repeated_spans(docs).collect() if r.doc == 4 and r.path]
    assert len({r.path for r in whole}) <= 3 and sum(r["count"] for r in whole) > 40


def test_queries_with_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, sql in queries.SQL.items():
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        df = queries.QUERIES[name](spark, sf_dir)
        assert sorted(df.columns) == sorted(columns)
        assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(result.fetchall())


def test_texts_with_equal_32_bit_hashes_stay_apart(spark):
    """Rows that share their doc_id (or lack one) and the hash of their text, of different lengths."""
    many = spark.range(300_000).select(F.concat(F.lit(prose(50, 60) + " "), F.when(F.col("id") % 2 == 0, F.lit(prose(51, 60) + " ")).otherwise(""),
                                                F.col("id").cast("string")).alias("text"), (F.col("id") % 2).alias("kind"))
    alike = many.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).filter("size(texts) > 1").limit(3).collect()
    assert alike
    for ids in [(1, None, None), (1, 2, 2)]:
        for found in alike:
            rows = list(zip(ids, [prose(50, 60) + " " + prose(51, 60), *found.texts[:2]], strict=True))
            got = substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            want = plain_repeats(rows)
            assert Counter(tuple(r) for r in got) == want


def plain_repeats(rows):
    words = [t.split() for _, t in rows]
    rank = [(d is None, d or 0) for d, _ in rows]
    first: dict[tuple, tuple] = {}
    for w, k in zip(words, rank, strict=True):
        for i in range(len(w) - 49):
            key = tuple(w[i:i + 50])
            first[key] = min(first.get(key, k), k)
    out = Counter()
    for (d, _), w, k in zip(rows, words, rank, strict=True):
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < k for j in range(i, i + 50)}
        out[(d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    return out
