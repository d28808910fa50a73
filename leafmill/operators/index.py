"""Keyed tables of an index: upserts, document states, incremental runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import ids

STATUSES = ("pending", "parsed", "embedded", "profiled", "failed")
SKIPPED_SUFFIXES = (".db", ".sqlite", ".sqlite3", ".db-wal", ".db-shm", ".sqlite-wal", ".sqlite-shm")
SKIPPED_NAMES = (".DS_Store", "Thumbs.db")


class FingerprintMismatchError(ValueError):
    """The index was made with another embedding."""


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` replaces rows of the same key; null is a key like others."""
    keys = new.select(F.col(key).alias("_key")).distinct()
    return existing.join(keys, existing[key].eqNullSafe(keys["_key"]), "left_anti").unionByName(new)


def replace_documents(existing: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of the documents in ``new`` give way to it, so a document that
    shrank leaves nothing behind."""
    return upsert(existing, new, key)


def skipped(name: Column) -> Column:
    """Whether a file's name is that of a database or of desktop litter."""
    endings = [F.lower(name).endswith(s) for s in SKIPPED_SUFFIXES]
    out = name.isin(*SKIPPED_NAMES)
    for e in endings:
        out = out | e
    return out


def set_job(rows: DataFrame, document: Column | str, job_id: str | None) -> DataFrame:
    """Stamps a document's rows with a job; None makes them common property."""
    return rows.withColumn("job_id", F.when(F.col("document_id") == document, F.lit(job_id)).otherwise(F.col("job_id")))


def fingerprint(provider: str, model: str, dim: int, unit: bool, sparse: bool) -> str:
    return f"{provider}:{model}:{dim}:norm={unit}:sparse={sparse}"


def check_fingerprint(stored: str | None, current: str) -> str:
    if stored is not None and stored != current:
        raise FingerprintMismatchError(f"the index was built with {stored}, the configuration says {current}")
    return current


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: (document_id, path, content_hash, size, modified_at,
    content), without databases and desktop litter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.where(~skipped(F.element_at(F.split(path, "/"), -1))).select(
        ids.uuid5(path).alias("document_id"),
        path.alias("path"),
        ids.content_hash(F.col("content")).alias("content_hash"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
        "content",
    )


def diff(found: DataFrame, state: DataFrame) -> DataFrame:
    """What must be done for each found file: ``new``, ``changed`` or ``same``,
    from (document_id, content_hash) of both sides."""
    known = state.select("document_id", F.col("content_hash").alias("_known"))
    verdict = F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("content_hash"), "same").otherwise("changed")
    return found.join(known, "document_id", "left").withColumn("action", verdict).drop("_known")


def to_do(found: DataFrame, state: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Files to work on.  One whose content is known is left alone, unless it is
    still pending, or failed and ``retry_failed`` asks for it."""
    again = ["pending", "failed"] if retry_failed else ["pending"]
    done = state.where(~F.col("status").isin(again))
    return found.join(done.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")


def stranded(state: DataFrame, root: str) -> DataFrame:
    """Documents below a folder that an interrupted run left half done."""
    from leafmill.operators.filters import under

    return state.where(F.col("status").isin("parsed", "embedded") & under(root))


def begin(state: DataFrame, work: DataFrame) -> DataFrame:
    """State after files have been entered as pending."""
    fresh = work.select(
        "document_id", "path", "content_hash", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("chunk_count")
    )
    return upsert(state.select(*fresh.columns), fresh, "document_id")


def status_counts(state: DataFrame, root: str | None = None) -> DataFrame:
    """(status, n) of the documents, below a folder if one is given."""
    from leafmill.operators.filters import under

    return (state if root is None else state.where(under(root))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def transition(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Applies (document_id, status, error, chunk_count); unknown statuses are
    an error, a null chunk_count keeps the old one."""
    new = updates.select("document_id", F.col("status").alias("_s"), F.col("error").alias("_e"), F.col("chunk_count").alias("_c"))
    ok = F.col("_s").isNull() | F.col("_s").isin(*STATUSES)
    out = state.join(new, "document_id", "left").withColumn(
        "status", F.when(ok, F.coalesce("_s", "status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.col("_s"))).cast("string"))
    )
    out = out.withColumn("error", F.when(F.col("_s").isNotNull(), F.col("_e")).otherwise(F.col("error")))
    return out.withColumn("chunk_count", F.coalesce("_c", "chunk_count")).drop("_s", "_e", "_c")


def listed(state: DataFrame, limit: int) -> DataFrame:
    """The first rows of the state by document_id."""
    return state.orderBy("document_id").limit(limit)


def job_counts(state: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, documents, chunks): what a job's run has indexed, from the state
    and (document_id, job_id); null is the common archive."""
    done = state.where("status = 'profiled'").join(jobs, "document_id")
    return done.groupBy("job_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("chunk_count").alias("chunks"))


def progress(state: DataFrame) -> DataFrame:
    """One row: how many documents have come how far."""
    at = F.col("status")
    return state.agg(
        F.count_if(at.isin("parsed", "embedded", "profiled")).alias("parsed"),
        F.count_if(at.isin("embedded", "profiled")).alias("embedded"),
        F.count_if(at == "profiled").alias("profiled"),
        F.count_if(at == "failed").alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def best_parse(attempts: DataFrame) -> DataFrame:
    """Of each document's attempts (document_id, seq, parser, quality, status)
    the best that did not fail; the earlier on ties; else the first failure."""
    ok = F.col("status") != "failed"
    order = F.struct(ok.alias("ok"), F.when(ok, F.col("quality")).otherwise(0.0).alias("q"), (-F.col("seq")).alias("s"))
    return attempts.groupBy("document_id").agg(
        F.max_by("parser", order).alias("parser"), F.max_by("status", order).alias("status"), F.max_by("quality", order).alias("quality")
    )


def parser_failures(attempts: DataFrame) -> DataFrame:
    """Failures and the first error of each parser."""
    failed = attempts.where("status = 'failed'")
    return failed.groupBy("parser").agg(F.count(F.lit(1)).alias("n"), F.min_by("error", F.struct("document_id", "seq")).alias("first_error"))
