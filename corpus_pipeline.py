"""From documents to training sequences: STAGES in order, each over all rows its predecessor kept.

Every stage takes and returns the columns of documents; the last returns packed pieces. Null
and empty texts fall at the first stage (no language); repeated rows, ties and columns beyond
those of documents pass through unchanged, whatever their names; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmeter.llm import languages, packing, pii, simhash, substrings
from sessionmeter.llm.common import HELD, packed, stored, unpacked
from sessionmeter.llm.queries import tokenizer_file

#: Posterior probability below which no language is taken as recognised.
LEAST_SCORE = 0.5


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters or without a clear language go; ``lang`` becomes the language found."""
    model = languages.train(docs.filter(~languages.held_out(F.col("doc_id"))))
    judged = languages.predict(packed(docs, "text"), model)
    clear = judged.filter((F.col("lang_pred") != languages.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return unpacked(clear, docs, "text", lang=F.col("lang_pred"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest doc_id stays, once if it is repeated."""
    return simhash.one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a text without any stays as written, one left without words goes."""
    cut = substrings.remove_repeats(packed(docs, "doc_id", "text"))
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    shorter = F.col("n_removed") > 0
    return unpacked(left, docs, "doc_id", "text", text=F.when(shorter, F.col("kept")).otherwise(F.col("text")),
                    n_chars=F.when(shorter, F.length("kept").cast("long")).otherwise(F.col(HELD)["n_chars"]))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every e-mail address, IP, card, phone number and IBAN becomes a mask; no row goes."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place in sequences of at most 2,048 tokens."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language", recognise_language),
    ("near duplicates", one_of_each_group),
    ("repeated passages", cut_repeats),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: A trained model, SimHash and tokenizers are beyond SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
