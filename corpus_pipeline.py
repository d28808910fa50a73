"""From raw documents to coded token ids: the stages of a training corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, mixing, quality, simhash, token_output
from leafmill.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


KEY = ("_key", "_key2")
#: Keys of dropped rows that are broadcast, 16 bytes each; if there are more,
#: texts are shuffled to them.
MOST_GONE = 1 << 20


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with 128 bits of hash of the whole row.  Rows are judged by it
    one by one, whatever their ids; only equal rows share a key, and a fate."""
    cells = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    return docs.withColumns({k: F.xxhash64(F.lit(i), *cells) for i, k in enumerate(KEY)})


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    gone = F.broadcast(gone) if gone.count() <= MOST_GONE else gone
    return _keyed(docs).join(gone, list(KEY), "left_anti").drop(*KEY)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects, each row by its own
    text and groups."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, whole=True).where("keep").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: that with the least doc_id,
    null ids last, then the least key; of equal rows one."""
    scratch, work = Scratch(spark, "dedup"), Scratch(spark, "simhash")
    found = simhash.near_duplicates(_keyed(docs), extra=KEY, scratch=work)
    groups = found.groupBy("group", F.col("doc_id").isNull().alias("last"), "doc_id", *KEY).agg(F.count(F.lit(1)).alias("n"))
    groups = scratch.keep(groups, "groups")
    work.drop()
    first = F.min(F.struct("last", "doc_id", *KEY)).alias("first")
    heads = scratch.keep(groups.groupBy("group").agg(first).select("first.*").join(groups.select(*KEY, "n"), list(KEY)).select(*KEY, "n"), "heads")
    others = groups.select(*KEY).join(heads, list(KEY), "left_anti")
    repeated = heads.where("n > 1").select(*KEY)
    gone = scratch.keep(others.unionByName(repeated), "gone")
    kept = _without(docs, gone)
    if repeated.isEmpty():
        return kept
    return kept.unionByName(_keyed(docs).join(repeated, list(KEY), "left_semi").dropDuplicates(list(KEY)).drop(*KEY))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of the benchmark."""
    scratch, work = Scratch(spark, "decontaminated"), Scratch(spark, "decontaminate")
    rows = _keyed(docs).withColumn("key", F.struct(*KEY))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(rows, benchmark, id_col="key", scratch=work)
    gone = scratch.keep(found.where("contaminated").select("key.*").distinct(), "gone")
    work.drop()
    return _without(docs, gone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as the mix takes it.  Null texts
    have no words, a null source is one of its own and comes last."""
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes and reads back the ids; a row for each document written, repeated
    rows and null texts included."""
    return token_output.token_output(docs)


STAGES = [
    ("quality_classifier", filter_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Fingerprints and drawing by hash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``; each one's result is
    written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
