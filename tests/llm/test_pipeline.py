"""Every stage against a plain version of what it does to its own input."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from sessionmeter.llm import languages, pii
from sessionmeter.llm.common import stored

from .test_operators import SHARED, plain_components, plain_simhash, plain_spans, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Further columns, named like those the operators add or use inside.
CLASHING = ["row", "doc", "r1", "r2", "kept", "n_words", "n_removed", "score", "lang_pred", "pii", "held", "held_columns", "spans", "text_key", "fingerprint"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output rows of each stage."""
    folder = str(tmp_path_factory.mktemp("tables"))
    english = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*COLUMNS)
    odd = [(1001, None), (1002, ""), (1003, "123 456"), (1004, prose(1, 90)), (1005, prose(1, 90)), (1005, prose(1, 90)), (1005, prose(9, 70)),
           (None, prose(21, 60)), (None, prose(22, 60)), (1006, prose(2, 30) + " " + SHARED), (1007, prose(3, 30) + " " + SHARED + " " + prose(4, 30)),
           (1008, SHARED), (1009, "write to a@b.cc or 4111 1111 1111 1111, " + prose(5, 30))]
    rows = spark.createDataFrame([(d, t, "en", None, None) for d, t in odd], english.schema)
    english.unionByName(rows).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder))
        found[name] = (docs, [tuple(r[c] for c in COLUMNS) for r in docs.collect()], out)
        docs = out
    return found, folder


def texts(out) -> Counter:
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_columns_stay(steps):
    for name, (_, _, out) in list(steps[0].items())[:-1]:
        assert out.columns == COLUMNS, name


def test_clashing_columns_stay(spark, steps):
    """Every stage hands on columns whose names its operator uses, with the same values, and gives the same texts."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _, out = steps[0][name]
        wide = docs.filter("doc_id % 3 <> 1 or doc_id > 1000").withColumns({c: F.concat_ws("/", F.lit(c), F.xxhash64("source", F.col("doc_id")).cast("string")) for c in CLASHING})
        got = stage(spark, stored(wide), steps[1])
        assert got.columns == [*COLUMNS, *CLASHING], name
        wrong = got.filter(" or ".join(f"`{c}` is distinct from concat_ws('/', '{c}', cast(xxhash64(source, doc_id) as string))" for c in CLASHING))
        assert wrong.count() == 0 and got.count() > 0, name
    assert stage(spark, wide, steps[1]).count() >= got.count()


def test_language_stage(steps):
    docs, rows, out = steps[0]["language"]
    model = languages.train(docs.filter(~languages.held_out(docs["doc_id"])))
    labels, score = languages.score([(r[1] or "").encode() for r in rows], model)
    want = Counter((r[0], r[1], label) for r, label, s in zip(rows, labels, score, strict=True) if label != "und" and s >= 0.5)
    assert Counter((r.doc_id, r.text, r.lang) for r in out.collect()) == want
    assert len(rows) - 3 >= sum(want.values()) >= len(rows) - 8


def test_near_duplicate_stage(steps):
    _, rows, out = steps[0]["near duplicates"]
    label = plain_components([plain_simhash(r[1]) for r in rows[:]], lambda a, b: (a ^ b).bit_count() <= 4)
    found = texts(out)
    assert sum(found.values()) == len(set(label))
    for c in set(label):
        group = [(r[0], r[1]) for r, k in zip(rows, label, strict=True) if k == c]
        least = min((d for d, _ in group if d is not None), default=None)
        assert sum(found[(d, t)] for d, t in set(group)) == 1
        assert any(found[(d, t)] for d, t in group if d == least)


def test_passage_stage(steps):
    _, rows, out = steps[0]["repeated passages"]
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1]) for r in rows]
    rank = [(r[0] is None, r[0] or 0) for r in rows]
    first: dict[tuple, tuple] = {}
    for w, k in zip(words, rank, strict=True):
        for i in range(len(w) - 49):
            key = tuple(w[i:i + 50])
            first[key] = min(first.get(key, k), k)
    want = Counter()
    for r, w, k in zip(rows, words, rank, strict=True):
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < k for j in range(i, i + 50)}
        if len(gone) < len(w) or not w:
            want[(r[0], " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1])] += 1
    assert texts(out) == want
    assert sum(SHARED[:150] in t for _, t in want) == 1


def test_personal_data_stage(steps):
    _, rows, out = steps[0]["personal data"]
    masks = {k.name: k.mask for k in pii.KINDS}
    want = Counter()
    for d, t, *_ in rows:
        spans = sorted((int(s.split(":")[1]), -int(s.split(":")[2]), s.split(":")[0]) for s in plain_spans(t))
        text, at = "", 0
        for start, end, kind in spans:
            if -end > at:
                text, at = text + t[at:max(at, start)] + masks[kind], -end
        want[(d, text + t[at:])] += 1
    ibans = sum("[IBAN]" in t for _, t in texts(out))
    assert sum((want - texts(out)).values()) <= ibans
    assert not [s for _, t in texts(out) for s in plain_spans(t)]


def test_packing_stage(steps):
    _, rows, out = steps[0]["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[(d, k // 2048, zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in out.collect()) == want


def test_run_is_the_stages(spark, steps):
    found, folder = steps
    last = Counter((r.doc_id, r.piece, r.ids_crc32) for r in found["packing"][2].collect())
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == last


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{n}" for n in range(1, 14)}
