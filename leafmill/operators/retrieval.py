"""Top-k search over chunks and profiles, fusion, reranking, neighbours.

Every search takes and returns DataFrames; ties are broken by id.  A batch of
queries is one plan: postings are joined to query terms on the term, so the
corpus is read once for all of them and nothing is compared pair by pair except
dense vectors and substrings, where blocks of queries are sent to the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import lexical
from leafmill.operators.dense import blocks, nearest
from leafmill.operators.filters import Filters, chunk_predicate, in_documents, profile_predicate
from leafmill.scratch import Scratch

K1, B = 1.5, 0.75
RRF_K = 60
#: Queries of a substring search in one pass; more take further passes.
MOST_QUERIES = 10_000
#: Distinct query terms that a lexical search may broadcast.
MOST_TERMS = 200_000


def small(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` to be broadcast if there are at most ``most``, else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def top(rows: DataFrame, k: int, *order: Column, by: str | None = None) -> DataFrame:
    """The first k rows, of each ``by`` if given, numbered in ``rank``."""
    if by is None:
        rows = rows.orderBy(*order).limit(k)
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_id, term, tf) of every chunk."""
    rows = chunks.select("chunk_id", F.explode(lexical.terms(F.col(text))).alias("term"))
    return rows.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _candidates(chunks: DataFrame, filters: Filters | None, doc_ids) -> DataFrame:
    return in_documents(chunks.where(chunk_predicate(filters or Filters())), doc_ids)


def bm25(queries: DataFrame, chunks: DataFrame, k: int, filters: Filters | None = None, doc_ids=None, text: str = "text") -> DataFrame:
    """Okapi BM25 of ``queries`` (query_id, query): (query_id, chunk_id, score,
    rank).  Frequencies and lengths are those of the filtered candidates."""
    scratch = Scratch(chunks.sparkSession, "bm25")
    asked = scratch.keep(queries.select("query_id", F.explode(lexical.query_terms(F.col("query"))).alias("term")), "asked")
    # The empty term, which no text has, stands once for each chunk and its length.
    marked = asked.select("term").unionByName(asked.sparkSession.createDataFrame([("",)], "term string")).distinct()
    listed = _candidates(chunks, filters, doc_ids).select("chunk_id", lexical.terms(F.col(text)).alias("terms"))
    listed = listed.select("chunk_id", F.greatest(F.size("terms"), F.lit(1)).alias("dl"), F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    # Terms that nobody asks for go before anything is shuffled; texts are read once.
    tf = listed.join(small(marked, MOST_TERMS), "term", "left_semi").groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = scratch.keep(tf, "postings")
    whole = tf.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("dl")) / F.sum("tf")).alias("avgdl")).first()
    tf, n, avgdl = tf.where("term <> ''"), whole.n or 0, whole.avgdl or 1.0
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    scored = tf.join(weights, "term").withColumn("gain", gain).join(asked, "term")
    scored = scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum("gain"), 6).alias("score")).where("score > 0")
    return top(scored, k, F.desc("score"), F.asc("chunk_id"), by="query_id")


def text_membership(queries: DataFrame, chunks: DataFrame, k: int, filters: Filters | None = None, doc_ids=None, text: str = "text") -> DataFrame:
    """Chunks by how many of the query's terms they contain as substrings,
    then by how often.  Score: the number of distinct terms."""
    asked = queries.select("query_id", lexical.query_terms(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    rows = _candidates(chunks, filters, doc_ids).select("chunk_id", F.lower(F.col(text)).alias("body"))
    pairs: DataFrame | None = None
    for block in blocks(asked, MOST_QUERIES):
        met = rows.join(F.broadcast(block))
        pairs = met if pairs is None else pairs.unionByName(met)
    counts = F.transform("terms", lambda t: lexical.occurrences(F.col("body"), t))
    scored = pairs.select("query_id", "chunk_id", counts.alias("c")).select(
        "query_id",
        "chunk_id",
        F.size(F.filter("c", lambda n: n > 0)).cast("double").alias("score"),
        F.aggregate("c", F.lit(0).cast("long"), lambda a, n: a + n).alias("occurrences"),
    )
    return top(scored.where("score > 0"), k, F.desc("score"), F.desc("occurrences"), F.asc("chunk_id"), by="query_id")


def sparse(queries: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Dot products of sparse vectors: ``queries`` (query_id, token, q) and
    ``weights`` (chunk_id, token, w).  Only positive scores remain."""
    pairs = weights.join(queries, "token").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("q") * F.col("w")), 6).alias("score"))
    return top(pairs.where("score > 0"), k, F.desc("score"), F.asc("chunk_id"), by="query_id")


def sparse_terms(queries: DataFrame, chunks: DataFrame, k: int, filters: Filters | None = None, doc_ids=None, text: str = "text") -> DataFrame:
    """Sparse search where a text's vector has the counts of its terms, a
    query's has ones: what a sparse encoder is given in its place."""
    rows = _candidates(chunks, filters, doc_ids)
    weights = postings(rows, text).select("chunk_id", lexical.term_id(F.col("term")).alias("token"), F.col("tf").cast("double").alias("w"))
    asked = queries.select("query_id", F.explode(lexical.query_terms(F.col("query"))).alias("term"))
    return sparse(asked.select("query_id", lexical.term_id(F.col("term")).alias("token"), F.lit(1.0).alias("q")), weights, k)


def dense(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "chunk_id", vector: str = "dense") -> DataFrame:
    """Exact cosine top k of ``queries`` (query_id, vector) over ``rows``."""
    found = nearest(queries, rows, k, id_col, vector)
    return top(found, k, F.desc("score"), F.asc(id_col), by="query_id")


def search_chunks(queries: DataFrame, chunks: DataFrame, k: int, filters: Filters | None = None, doc_ids=None) -> DataFrame:
    return dense(queries, _candidates(chunks, filters, doc_ids), k)


def search_profiles(queries: DataFrame, profiles: DataFrame, k: int, filters: Filters | None = None) -> DataFrame:
    return dense(queries, profiles.where(profile_predicate(filters or Filters())), k, "document_id")


def fuse(rankings: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, chunk_id, rank); ties go to what an
    earlier list, or an earlier rank, shows first."""
    every = None
    for i, r in enumerate(rankings):
        part = r.select("query_id", "chunk_id", "rank", F.lit(i).alias("list"))
        every = part if every is None else every.unionByName(part)
    scored = every.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"), F.min(F.struct("list", "rank")).alias("first")
    )
    return top(scored, k, F.desc("score"), F.col("first.list"), F.col("first.rank"), by="query_id").drop("first")


def rerank_reversed(hits: DataFrame, k: int) -> DataFrame:
    """A deterministic stand-in for a reranking service: the list backwards."""
    out = top(hits.drop("rerank_score").withColumnRenamed("rank", "before"), k, F.desc("before"), by="query_id")
    return out.withColumn("rerank_score", F.round(1.0 / F.col("rank"), 6)).drop("before")


def search(
    strategy: str,
    semantic: Callable[[int], DataFrame],
    keyword: Callable[[int], DataFrame],
    k: int,
    rerank: Callable[[DataFrame, int], DataFrame] | None = None,
    candidates: int = 50,
) -> DataFrame:
    """Dispatch over strategies; with a reranker more is fetched, then cut."""
    fetch = max(k, candidates) if rerank else k
    if strategy == "semantic":
        hits = semantic(fetch)
    elif strategy == "keyword":
        hits = keyword(fetch)
    elif strategy == "hybrid":
        hits = fuse([semantic(fetch), keyword(fetch)], fetch)
    else:
        raise ValueError(f"unknown strategy {strategy!r}: semantic, keyword or hybrid")
    return rerank(hits, k) if rerank else hits


def display_names(hits: DataFrame, profiles: DataFrame) -> DataFrame:
    """``hits`` with ``filename``: the profile's, or the id of a document
    without one."""
    names = profiles.select("document_id", "filename")
    return hits.join(names, "document_id", "left").withColumn("filename", F.coalesce("filename", "document_id"))


def positions(chunks: DataFrame) -> DataFrame:
    """Chunks with their place in the document."""
    by = Window.partitionBy("document_id").orderBy("start", "chunk_id")
    return chunks.withColumn("pos", F.row_number().over(by))


def expand_neighbours(hits: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """``hits`` (query_id, chunk_id, rank) with the text of the chunk and its
    neighbours within ``width``.  A sibling goes to the first hit, by rank,
    whose window holds it; every hit keeps its own chunk."""
    placed = positions(chunks).select("document_id", "chunk_id", "pos", "text")
    own = hits.join(placed.drop("text"), "chunk_id").select("query_id", "rank", "chunk_id", "document_id", "pos")
    window = own.select("*", F.explode(F.sequence(F.col("pos") - width, F.col("pos") + width)).alias("at"))
    siblings = placed.select("document_id", F.col("pos").alias("at"), F.col("chunk_id").alias("sibling"), F.col("text").alias("part"))
    seen = window.join(siblings, ["document_id", "at"])
    first = F.row_number().over(Window.partitionBy("query_id", "sibling").orderBy("rank"))
    kept = seen.withColumn("turn", first).where((F.col("turn") == 1) | (F.col("sibling") == F.col("chunk_id")))
    merged = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])
    return kept.groupBy("query_id", "rank", "chunk_id").agg(F.array_join(merged, "\n").alias("text"))


def expand_context(hits: DataFrame, chunks: DataFrame, before: int = 500, after: int = 500) -> DataFrame:
    """Whole neighbouring chunks on either side until each side's characters
    reach its budget, joined without a separator."""
    placed = positions(chunks).select("document_id", "chunk_id", "pos", "text")
    own = hits.select("chunk_id").distinct().join(placed.select("document_id", "chunk_id", F.col("pos").alias("at")), "chunk_id")
    rows = placed.select("document_id", "pos", "text").join(own, "document_id")
    key = ["document_id", "chunk_id"]
    size = F.length("text")
    back = Window.partitionBy(*key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.coalesce(F.sum(F.when(F.col("pos") < F.col("at"), size)).over(back), F.lit(0)))
    rows = rows.withColumn("right", F.coalesce(F.sum(F.when(F.col("pos") > F.col("at"), size)).over(ahead), F.lit(0)))
    near = (F.col("pos") == F.col("at")) | ((F.col("pos") < F.col("at")) & (F.col("left") < before)) | (
        (F.col("pos") > F.col("at")) & (F.col("right") < after)
    )
    merged = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return rows.where(near).groupBy(*key).agg(F.array_join(merged, "").alias("text"))
