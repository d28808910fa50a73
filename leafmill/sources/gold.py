"""Gold questions and their corpora as DataFrames.

Questions are (question, doc_ids, chunk_ids, question_type, language, source,
doc_files, reference_answer); corpora are (document_id, chunk_id, text).
"""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import ids

QUESTIONS = (
    "question string, doc_ids array<string>, chunk_ids array<string>, question_type string, language string, source string, "
    "doc_files array<string>, reference_answer string"
)
ARTICLES = (
    "article struct<id:string>, chunks array<struct<id:string,content:string>>, "
    "questions struct<items:array<struct<question:string,answer:string,category:string,related_chunk_ids:array<string>>>>"
)
PAIRS = "id string, context string, question string, answers struct<text:array<string>>"


def manual(spark: SparkSession, path: str) -> DataFrame:
    """A hand-made YAML set, which names documents by file."""
    rows = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    lists = lambda r, k: sorted(set(r.get(k) or []))
    made = [
        (
            r["question"], lists(r, "relevant_doc_ids"), lists(r, "relevant_chunk_ids"), r.get("question_type", "unknown"), r.get("language", "tr"),
            "manual", lists(r, "relevant_doc_files"), r.get("reference_answer", ""),
        )
        for r in rows
    ]
    return spark.createDataFrame(made, QUESTIONS)


def resolve_files(questions: DataFrame, folder: str) -> DataFrame:
    """Fills empty document ids from file names in a folder."""
    path = lambda f: F.concat(F.lit(folder.rstrip("/") + "/"), f)
    found = F.transform("doc_files", lambda f: ids.uuid5(path(f)))
    return questions.withColumn("doc_ids", F.when(F.size("doc_ids") > 0, F.col("doc_ids")).otherwise(found))


def articles(spark: SparkSession, path: str, source: str, language: str = "tr") -> tuple[DataFrame, DataFrame]:
    """(questions, corpus) from JSON files of one article each, with chunks
    whose ids are the article's own."""
    rows = spark.read.schema(ARTICLES).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    whole = lambda c: F.concat(F.col("article.id"), F.lit("::"), c)
    asked = rows.select("article", F.explode("questions.items").alias("q"))
    questions = asked.select(
        "q.question",
        F.array("article.id").alias("doc_ids"),
        F.transform("q.related_chunk_ids", whole).alias("chunk_ids"),
        F.coalesce("q.category", F.lit("unknown")).alias("question_type"),
        F.lit(language).alias("language"),
        F.lit(source).alias("source"),
        F.array().cast("array<string>").alias("doc_files"),
        F.coalesce("q.answer", F.lit("")).alias("reference_answer"),
    )
    corpus = rows.select("article", F.explode("chunks").alias("c"))
    return questions, corpus.select(F.col("article.id").alias("document_id"), whole(F.col("c.id")).alias("chunk_id"), F.col("c.content").alias("text"))


def parallel(spark: SparkSession, asked: str, answered: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(questions, corpus) from JSON lines in two languages that share ids:
    questions of the one, contexts of the other, each id once."""
    q = spark.read.schema(PAIRS).json(asked)
    own = F.array("id")
    questions = q.select(
        "question", own.alias("doc_ids"), own.alias("chunk_ids"), F.lit("crosslingual").alias("question_type"), F.lit("tr").alias("language"),
        F.lit(source).alias("source"), F.array().cast("array<string>").alias("doc_files"), F.coalesce(F.get("answers.text", F.lit(0)), F.lit("")).alias("reference_answer"),
    )
    c = spark.read.schema(PAIRS).json(answered).groupBy("id").agg(F.min("context").alias("text"))
    return questions, c.select(F.col("id").alias("document_id"), F.col("id").alias("chunk_id"), "text")
