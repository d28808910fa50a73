"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, licenses, mixing, pii, quality, simhash, syncmers, token_output, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("group")


#: Documents have no paths: their source is the top directory, and the id says
#: how far below it they lie, in directories of a thousand and of fifty ids.
DOCUMENT_PATH = (
    "source || CASE doc_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '/' || (doc_id div 1000) || '/' "
    "ELSE '/' || (doc_id div 1000) || '/' || (doc_id div 50) || '/' END || doc_id || '.txt'"
)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(DOCUMENT_PATH).alias("path"))
    return licenses.scan(docs)


def _of_kind(k: int) -> Callable:
    return lambda span: span["kind"] == k


def pii_digest(docs: DataFrame) -> DataFrame:
    found = pii.find(docs)
    counts = [
        F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(pii.KINDS[:4])
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.spelt(F.col("base")), 256).alias("base_sha256"),
        pii.spelt(F.array_sort(F.concat("base", "added"))).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
        F.size(F.filter("added", _of_kind(pii.KINDS.index("secret")))).cast("long").alias("n_secret"),
    )


def op3_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_table(spark, sf_dir, "documents"))


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_likeness(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumn("n_passages", F.size("passages")).drop("passages")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_pii_candidates": op3_pii_candidates,
    "op4_syncmer_fingerprints": op4_syncmer_fingerprints,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_toxic_segments": op6_toxic_segments,
    "op7_url_filter": op7_url_filter,
    "op8_source_mixing": op8_source_mixing,
    "op9_token_output": op9_token_output,
    "op10_quality_classifier": op10_quality_classifier,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS5 = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS5} AS w FROM documents),
b AS (SELECT item_id, {_WORDS5} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, least(len(w), 13) AS n,
         array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
),
m AS (SELECT rid, i, n, item FROM dw JOIN iw USING (n, phrase)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""

_OP7 = r"""
WITH r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
s AS (SELECT row_number() OVER () AS rid, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT rid, page_id,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
f AS (SELECT rid, rhost || rpath AS rule, verdict,
  row_number() OVER (PARTITION BY rid ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (rid)
"""

ORACLES: dict[str, str] = {
    "op2_license_scan": licenses.oracle(DOCUMENT_PATH.replace(" div ", " // ")),
    "op7_url_filter": _OP7,
    "op5_benchmark_decontamination": _OP5,
}
