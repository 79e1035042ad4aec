"""The registered queries of this package and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    embeddings, fingerprints, languages, licenses, packing, periodicruns, pii, sentencepieces, simhash, substrings,
    tokencounts, turnrepair, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary, installed on every machine beside the tokenizer libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


# The rules of the contract.
URL_RULES = [
    urls.rule("com/", "allow"), urls.rule("example.com/en/", "block"), urls.rule("www.example.com/en/", "allow"),
    urls.rule("net/es/", "block"), urls.rule("net/fr/", "block"),
]


@query("op8_url_filter", r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN position('://' IN coalesce(url, '')) > 0
         THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule, verdict, host, path) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
  ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), fits AS (
  SELECT page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM split s JOIN rules r
    ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, f.rule,
  CASE WHEN f.rule IS NOT NULL THEN f.verdict
       WHEN regexp_matches(s.host || s.path, '^([^/]*[.-])?(spam|pills|casino|viagra|porn|xxx|warez|malware|phishing)[.-]')
       THEN 'block' ELSE 'allow' END AS verdict
FROM split s LEFT JOIN fits f USING (page_id)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_licenses")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


@query("op10_substrings", r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM texts WHERE len(words) >= 50
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM starts
), firsts AS (
  SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
  FROM windows JOIN firsts USING (h) WHERE first_doc < doc_id
), marked AS (
  SELECT doc_id, list(i) AS gone FROM covered GROUP BY doc_id
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept, count(*) AS n_kept
  FROM placed p ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, (len(t.words) - coalesce(k.n_kept, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.digest(table(spark, sf_dir, "documents"))


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


@query("op5_embeddings")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_turn_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.digest(table(spark, sf_dir, "conversations"))


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodicruns.digest(table(spark, sf_dir, "documents"))
