"""Evidence and citations of a question-answering loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = r"⟦([^⟦⟧]+)⟧"
ABSTAIN = "BULAMADIM"
TOOL_ROWS = "array<struct<doc_id:string,chunk_id:string,page:int,section:string,text:string,score:double,error:string>>"
MOST_CHARS = 12_000
CUT_MARK = "\n[…]"


def tool_rows(payload: Column) -> Column:
    """Rows of a tool's JSON answer; malformed ones are null."""
    return F.from_json(payload, TOOL_ROWS)


def evidence_pool(messages: DataFrame) -> DataFrame:
    """From (conv_id, turn, payload): the first row of each chunk that a tool
    returned without an error, numbered by appearance."""
    rows = messages.select("conv_id", "turn", F.posexplode(tool_rows(F.col("payload"))).alias("ix", "r")).select("conv_id", "turn", "ix", "r.*")
    rows = rows.where("error is null and chunk_id is not null")
    first = F.row_number().over(Window.partitionBy("conv_id", "chunk_id").orderBy("turn", "ix"))
    return rows.withColumn("k", first).where("k = 1").drop("k", "error")


def cited_ids(answer: Column) -> Column:
    """Marked ids, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(MARK), F.lit(1)))


def answer_sources(answers: DataFrame, pool: DataFrame, fallback: int = 3) -> DataFrame:
    """Sources of (conv_id, answer): the cited chunks of the pool in order of
    mention; without any, and unless the answer abstains, its first rows."""
    asked = answers.select("conv_id", "answer", F.posexplode_outer(cited_ids(F.col("answer"))).alias("seq", "chunk_id"))
    cited = asked.join(pool.select("conv_id", "chunk_id", "doc_id"), ["conv_id", "chunk_id"])
    cited = cited.select("conv_id", "chunk_id", "doc_id", "seq")
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "ix"))
    rest = (
        pool.join(answers.where(~F.col("answer").contains(ABSTAIN)).select("conv_id"), "conv_id", "left_semi")
        .join(cited.select("conv_id").distinct(), "conv_id", "left_anti")
        .withColumn("seq", order - 1)
        .where(F.col("seq") < fallback)
        .select("conv_id", "chunk_id", "doc_id", "seq")
    )
    return cited.unionByName(rest)


def documents_seen(rows: DataFrame) -> DataFrame:
    """Documents of tool rows (conv_id, turn, ix, doc_id, chunk_id, page), each
    once, in the order seen: those of chunks before those named without one, and
    with the chunk's page if both are there."""
    seen = rows.where("doc_id is not null").withColumn("named_only", F.col("chunk_id").isNull())
    first = seen.groupBy("conv_id", "doc_id").agg(F.min_by(F.struct("page"), F.struct("named_only", "turn", "ix"))["page"].alias("page"), F.min(F.struct("named_only", "turn", "ix")).alias("at"))
    order = Window.partitionBy("conv_id").orderBy("at")
    return first.withColumn("seq", F.row_number().over(order) - 1).drop("at")


def summaries(chunks: DataFrame, limit: int = 600) -> DataFrame:
    """(document_id, summary): a document's chunks in order, joined by spaces
    and cut, for corpora without profiles."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "chunk_id", "text"))), lambda c: c["text"])
    return chunks.groupBy("document_id").agg(F.substring(F.array_join(parts, " "), 1, limit).alias("summary"))


def listing(profiles: DataFrame, limit: int = 50) -> DataFrame:
    """Profiles by file name, cut after that."""
    return profiles.orderBy("filename", "document_id").limit(limit)


def plain_answer(answer: Column) -> Column:
    return F.trim(F.regexp_replace(answer, r"\s*" + MARK, ""))


def history(turns: DataFrame) -> DataFrame:
    """Turns that a model may see again: of both sides, with content."""
    return turns.where(F.col("role").isin("user", "assistant") & (F.length(F.coalesce("text", F.lit(""))) > 0))


def document_text(chunks: DataFrame, prefix: str | None = None, job: str | None = None) -> DataFrame:
    """(document_id, text): chunks in order, joined by lines and cut; of one
    section if ``prefix`` is given.  Without a job, common documents only."""
    rows = chunks.where(F.col("job_id").isNull() if job is None else F.col("job_id") == job)
    if prefix is not None:
        rows = rows.where(F.col("section_path").startswith(prefix))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "chunk_id", "text"))), lambda c: c["text"])
    whole = rows.groupBy("document_id").agg(F.array_join(parts, "\n").alias("text"))
    cut = F.when(F.length("text") > MOST_CHARS, F.concat(F.substring("text", 1, MOST_CHARS), F.lit(CUT_MARK))).otherwise(F.col("text"))
    return whole.select("document_id", cut.alias("text"))


def document_outline(chunks: DataFrame) -> DataFrame:
    """Distinct section paths of each document, in order of appearance."""
    paths = chunks.where("section_path is not null").groupBy("document_id", "section_path").agg(F.min(F.struct("start", "chunk_id")).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "section_path"))), lambda p: p["section_path"])
    return paths.groupBy("document_id").agg(listed.alias("sections"))
