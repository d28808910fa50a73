"""Queries over the engine's operators, each with the SQL that says the same.

The tables stand in for an archive: documents are files (``source`` the folder
and job), their sentences chunks, ``embeddings`` chunk vectors with ``label`` as
their document, ``benchmark`` questions, ``labels`` verdicts, ``events`` a log.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import headings, ids, lexical, quality, splitting, vectors
from leafmill.operators import answers, evaluation, index, retrieval
from leafmill.operators.filters import Filters, profile_predicate
from leafmill.scratch import Scratch, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows  # what is done to their texts takes long


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("chunk_id", F.col("doc_id").cast("string"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.posexplode(splitting.sentences(F.col("text"))).alias("start", "text"), F.col("source").alias("job_id")
    )
    return rows.withColumn("chunk_id", ids.chunk_id(F.col("document_id"), F.col("start")))


# SQL building blocks.
_STOP = ", ".join(f"'{w}'" for w in sorted(set(lexical.STOPWORDS)))


def _terms_sql(text: str) -> str:
    words = rf"regexp_extract_all(lower(translate({text}, 'İI', 'iı')), '[\p{{L}}\p{{N}}\p{{M}}_]+')"
    return f"list_filter({words}, lambda w: w NOT IN ({_STOP}))"


_SENTENCES = "list_filter(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')"
_CHUNKS = f"""s AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, source AS job_id, {_SENTENCES} AS parts FROM documents),
c AS (SELECT document_id, job_id, unnest(range(0, len(parts))) AS start, unnest(parts) AS text FROM s),
ch AS (SELECT *, document_id || ':' || CASE WHEN start < 100000 THEN lpad(CAST(start AS VARCHAR), 5, '0') ELSE CAST(start AS VARCHAR) END AS chunk_id FROM c)"""
_LOW, _UP = "abcdefghijklmnopqrstuvwxyzçğiöşü", "ABCDEFGHIJKLMNOPQRSTUVWXYZÇĞİÖŞÜ"

ASK = "stupid trash and the idiot of ention"
_ASK = f"'{ASK}'"


def _ask(spark: SparkSession, text: str = ASK) -> DataFrame:
    return spark.createDataFrame([(1, text)], "query_id int, query string")


# --- scans and identity -----------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash, length(text) AS n_chars FROM documents")
def scan_fingerprint(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"), F.length("text").cast("long").alias("n_chars"))


@query(
    rf"""WITH h AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path,
    sha1(unhex('{ids.URL_NAMESPACE}') || encode(source || '/' || doc_id || '.txt')) AS x FROM documents)
SELECT doc_id, path, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' ||
  ['8','9','a','b'][(strpos('0123456789abcdef', x[17]) - 1) % 4 + 1] || x[18:20] || '-' || x[21:32] AS document_id FROM h"""
)
def document_uuid5(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"))
    return d.withColumn("document_id", ids.uuid5(F.col("path")))


# --- text quality -----------------------------------------------------------

_FW = ", ".join(f"'{w}'" for w in sorted(set(quality.TURKISH_WORDS + quality.ENGLISH_WORDS)))
_TRW = ", ".join(f"'{w}'" for w in sorted(set(quality.TURKISH_WORDS)))
_RUNS = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyzçğıöşü")
_T = "regexp_extract_all(translate(text, '{1}', '{0}'), '[a-zçğıöşü]+')".format(_LOW, _UP)
def quality_sql(documents: str = "documents") -> str:
    return rf"""q0 AS (SELECT doc_id, text, lang, source, {_T} AS toks FROM {documents}),
q1 AS (SELECT *, list_filter(toks, lambda t: length(t) >= 2) AS long FROM q0),
q2 AS (SELECT *,
  CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) = 0 THEN 0.0 ELSE
    length(regexp_replace(text, '[^A-Za-zçğıöşüÇĞİÖŞÜ]', '', 'g')) / length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))::DOUBLE END AS script,
  CASE WHEN len(long) = 0 THEN 0.0 ELSE len(list_filter(long, lambda t: regexp_matches(t, '[aeıioöuü]'))) / len(long)::DOUBLE END AS vowels,
  CASE WHEN len(toks) = 0 THEN 0.0 ELSE len(list_filter(toks, lambda t: t IN ({_FW}))) / len(toks)::DOUBLE END AS words,
  CASE WHEN len(long) = 0 THEN 0.0 ELSE len(list_filter(long, lambda t: regexp_matches(t, '{_RUNS}'))) / len(long)::DOUBLE END AS runs,
  CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^\x{{FFFD}}\x00-\x08\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')) / length(text)::DOUBLE END AS bad
  FROM q1),
q3 AS (SELECT *, CASE WHEN len(toks) = 0 THEN 0.0 ELSE (script + vowels + words) / 3 * (1 - runs) END AS plausible FROM q2)"""


_QUALITY = quality_sql()


@query(
    f"""WITH {_QUALITY} SELECT doc_id, len(toks) AS n_tokens, round(script, 6) AS script_validity, round(vowels, 6) AS vowel_rate,
round(words, 6) AS function_words, round(runs, 6) AS repetition, round(plausible, 6) AS plausibility, round(bad, 6) AS bad_chars FROM q3"""
)
def text_quality(spark, sf_dir):
    ratios = ("script_validity", "vowel_rate", "function_words", "repetition", "plausibility", "bad_chars")
    rows = quality.measure(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), *[F.round(r, 6).alias(r) for r in ratios])


@query(
    f"""WITH {_QUALITY}, h AS (SELECT doc_id, toks, text, len(list_filter(toks, lambda t: t IN ({_TRW}))) AS a,
len(list_filter(toks, lambda t: t IN ({_FW}) AND t NOT IN ({_TRW}))) AS b FROM q3)
SELECT doc_id, CASE WHEN len(toks) = 0 THEN NULL WHEN regexp_matches(text, '[çğıöşüÇĞİÖŞÜ]') THEN 'tr' WHEN a = 0 AND b = 0 THEN NULL
WHEN a > b THEN 'tr' ELSE 'en' END AS language FROM h"""
)
def chunk_language(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", quality.detect_language(F.col("text")).alias("language"))


# --- terms and lexical search -----------------------------------------------

_TF = f"""t AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, unnest({_terms_sql('text')}) AS term FROM documents),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY ALL)"""


@query(f"WITH {_TF} SELECT * FROM tf")
def term_frequency(spark, sf_dir):
    return retrieval.postings(documents(spark, sf_dir))


@query(f"WITH {_TF} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def document_frequency(spark, sf_dir):
    return retrieval.postings(documents(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _bm25_sql(asked: str, where: str, k: int) -> str:
    """``asked``: SQL of (query_id, term)."""
    return f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {_terms_sql('text')} AS terms FROM documents WHERE {where}),
w AS (SELECT count(*) AS n, avg(greatest(len(terms), 1)) AS avgdl FROM d),
q AS ({asked}),
tf AS (SELECT chunk_id, greatest(len(terms), 1) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term), w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s WHERE score > 0)
SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= {k}"""


_ASKED = f"SELECT 1 AS query_id, unnest(list_distinct({_terms_sql(_ASK)})) AS term"


@query(_bm25_sql(_ASKED, "lang IN ('en', 'de')", 10))
def bm25_search(spark, sf_dir):
    d = documents(spark, sf_dir).withColumnRenamed("lang", "language")
    return retrieval.bm25(_ask(spark), d, 10, Filters(languages=["en", "de"]))


def _questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_BATCH = f"SELECT item_id AS query_id, unnest(list_distinct({_terms_sql('text')})) AS term FROM benchmark"


@query(_bm25_sql(_BATCH, "true", 5))
def batch_search(spark, sf_dir):
    return retrieval.bm25(_questions(spark, sf_dir), documents(spark, sf_dir), 5)


_MEMBER = f"""q AS (SELECT list_distinct({_terms_sql(_ASK)}) AS terms),
m AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, list_transform(terms, lambda t: (length(text) - length(replace(lower(text), t, ''))) // length(t)) AS c FROM documents, q),
mm AS (SELECT chunk_id, len(list_filter(c, lambda n: n > 0))::DOUBLE AS score, list_sum(c)::BIGINT AS occurrences FROM m),
member AS (SELECT 1 AS query_id, *, row_number() OVER (ORDER BY score DESC, occurrences DESC, chunk_id)::INT AS rank FROM mm WHERE score > 0)"""


@query(f"WITH {_MEMBER} SELECT * FROM member WHERE rank <= 10")
def text_search(spark, sf_dir):
    return retrieval.text_membership(_ask(spark), documents(spark, sf_dir), 10)


@query(
    f"""WITH {_TF}, s AS (SELECT 1 AS query_id, chunk_id, round(sum(tf::DOUBLE), 6) AS score FROM tf
  WHERE term IN (SELECT unnest({_terms_sql(_ASK)})) GROUP BY chunk_id),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 10"""
)
def sparse_search(spark, sf_dir):
    return retrieval.sparse_terms(_ask(spark), documents(spark, sf_dir), 10)


# --- dense search -------------------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), F.col("embedding").alias("dense"))


def _asked_vectors(spark, sf_dir) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


def _dense_sql(where: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, e.vec_id AS chunk_id, {_COS} AS score FROM embeddings e, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 10"""


@query(_dense_sql("true"))
def semantic_search(spark, sf_dir):
    return retrieval.dense(_asked_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10)


@query(_dense_sql("e.label IN (1, 3, 5)"))
def semantic_scoped(spark, sf_dir):
    scope = spark.createDataFrame([("1",), ("3",), ("5",)], "document_id string")
    from leafmill.operators.filters import in_documents

    return retrieval.dense(_asked_vectors(spark, sf_dir), in_documents(_vectors(spark, sf_dir), scope), 10)


@query(
    """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
p AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL), c AS (SELECT CAST(label AS VARCHAR) AS document_id, list(v ORDER BY i) AS dense FROM p GROUP BY label),
q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, document_id, round(list_cosine_similarity(dense, q.embedding::DOUBLE[]), 6) AS score FROM c, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 5"""
)
def profile_search(spark, sf_dir):
    parts = _vectors(spark, sf_dir).select("document_id", F.posexplode("dense").alias("i", "v"))
    means = parts.groupBy("document_id", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    profiles = means.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("dense"))
    return retrieval.dense(_asked_vectors(spark, sf_dir), profiles, 5, "document_id")


def _embedding_sql(text: str, dim: int = 8) -> str:
    return f"""list_transform(range(0, {dim}), lambda i: (strpos('0123456789abcdef', sha256({text} || ':0')[i * 2 + 1]) - 1) * 16 / 255.0::DOUBLE
 + (strpos('0123456789abcdef', sha256({text} || ':0')[i * 2 + 2]) - 1) / 255.0::DOUBLE - 0.5)"""


@query(f"SELECT doc_id, list_transform({_embedding_sql('text', 32)}, lambda x: round(x, 6)) AS raw, 32 AS dim FROM documents")
def fake_embedding(spark, sf_dir):
    raw = F.transform(vectors.hash_embedding(F.col("text"), 32, False), lambda x: F.round(x, 6))
    return documents(spark, sf_dir).select("doc_id", raw.alias("raw"), F.lit(32).alias("dim"))


def _hash_dense(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = documents(spark, sf_dir).select("chunk_id", vectors.hash_embedding(F.col("text")).alias("dense"))
    return _ask(spark).select("query_id", vectors.hash_embedding(F.col("query")).alias("vector")), rows


_HYBRID = f"""{_MEMBER},
v AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {_embedding_sql('text')} AS x FROM documents), qv AS (SELECT {_embedding_sql(_ASK)} AS y),
sem0 AS (SELECT chunk_id, round(list_cosine_similarity(x, y), 6) AS score FROM v, qv),
sem AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM sem0),
u AS (SELECT chunk_id, rank, 0 AS l FROM sem WHERE rank <= 20 UNION ALL SELECT chunk_id, rank, 1 FROM member WHERE rank <= 20),
f AS (SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min({{'l': l, 'r': rank}}) AS first FROM u GROUP BY chunk_id),
hy AS (SELECT 1 AS query_id, chunk_id, score, row_number() OVER (ORDER BY score DESC, first.l, first.r)::INT AS rank FROM f)"""


def _hybrid(spark, sf_dir, k: int) -> DataFrame:
    asked, rows = _hash_dense(spark, sf_dir)
    return retrieval.search(
        "hybrid",
        lambda n: retrieval.dense(asked, rows, n),
        lambda n: retrieval.text_membership(_ask(spark), documents(spark, sf_dir), n),
        k,
    )


@query(f"WITH {_HYBRID} SELECT * FROM hy WHERE rank <= 20")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, 20)


@query(
    f"""WITH {_HYBRID}, top AS (SELECT * FROM hy WHERE rank <= 20),
r AS (SELECT query_id, chunk_id, score, row_number() OVER (ORDER BY rank DESC)::INT AS rank FROM top)
SELECT *, round(1.0::DOUBLE / rank, 6) AS rerank_score FROM r WHERE rank <= 5"""
)
def rerank_fake(spark, sf_dir):
    return retrieval.rerank_reversed(_hybrid(spark, sf_dir, 20), 5)


# --- chunks and context -------------------------------------------------------


@query(f"WITH {_CHUNKS} SELECT document_id, chunk_id, start::INT AS start, text FROM ch")
def sentence_split(spark, sf_dir):
    return sentence_chunks(spark, sf_dir).select("document_id", "chunk_id", "start", "text")


def _hits(chunks: DataFrame) -> DataFrame:
    """The longest sentences that hold a common word: the hits to be expanded."""
    rows = chunks.where(F.lower("text").contains("the")).select("chunk_id", F.length("text").alias("n"))
    return retrieval.top(rows, 10, F.desc("n"), F.asc("chunk_id")).select(F.lit(1).alias("query_id"), "chunk_id", "rank")


_HITS = """h AS (SELECT chunk_id, row_number() OVER (ORDER BY length(text) DESC, chunk_id)::INT AS rank FROM ch WHERE contains(lower(text), 'the') QUALIFY rank <= 10)"""


@query(
    f"""WITH {_CHUNKS}, {_HITS}, p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY start, chunk_id) AS pos FROM ch),
w AS (SELECT h.rank, h.chunk_id, s.chunk_id AS sib, s.pos, s.text FROM h JOIN p o USING (chunk_id) JOIN p s ON s.document_id = o.document_id AND s.pos BETWEEN o.pos - 1 AND o.pos + 1),
k AS (SELECT *, row_number() OVER (PARTITION BY sib ORDER BY rank) AS turn FROM w)
SELECT 1 AS query_id, rank, chunk_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM k WHERE turn = 1 OR sib = chunk_id GROUP BY rank, chunk_id"""
)
def neighbour_expand(spark, sf_dir):
    chunks = sentence_chunks(spark, sf_dir)
    return retrieval.expand_neighbours(_hits(chunks), chunks, 1)


@query(
    f"""WITH {_CHUNKS}, {_HITS}, p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY start, chunk_id) AS pos FROM ch),
w AS (SELECT o.document_id, h.chunk_id, o.pos AS own, s.pos, s.text FROM h JOIN p o USING (chunk_id) JOIN p s ON s.document_id = o.document_id),
e AS (SELECT *, coalesce(sum(CASE WHEN pos < own THEN length(text) END) OVER (PARTITION BY chunk_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  coalesce(sum(CASE WHEN pos > own THEN length(text) END) OVER (PARTITION BY chunk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM w)
SELECT document_id, chunk_id, string_agg(text, '' ORDER BY pos) AS text FROM e WHERE pos = own OR (pos < own AND l < 500) OR (pos > own AND r < 500) GROUP BY ALL"""
)
def expand_context(spark, sf_dir):
    chunks = sentence_chunks(spark, sf_dir)
    return retrieval.expand_context(_hits(chunks), chunks)


@query(
    f"""WITH {_CHUNKS}, t AS (SELECT document_id, string_agg(text, chr(10) ORDER BY start, chunk_id) AS x FROM ch WHERE job_id = 'src1' GROUP BY document_id)
SELECT document_id, CASE WHEN length(x) > 12000 THEN x[1:12000] || chr(10) || '[…]' ELSE x END AS text FROM t"""
)
def get_document(spark, sf_dir):
    rows = sentence_chunks(spark, sf_dir).withColumn("section_path", F.lit(None).cast("string"))
    return answers.document_text(rows, job="src1")


#: Marks put before a document's sentences, in turn: numbers of one, two and
#: three parts, an article, a chapter, an annex, and none.
_MARKS = ("1. ", "1.2 ", "Madde 3 ", "ON BİRİNCİ BÖLÜM ", "EK-A ", "", "1.2.3 ")
_LINES = rf"""s AS (SELECT doc_id, {_SENTENCES} AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(parts))) AS ix, regexp_replace(unnest(parts), '\s+$', '') AS part FROM s),
m AS (SELECT *, ix // 9 + 1 AS n, CASE ix % 7 WHEN 0 THEN (ix // 9 + 1) || '. ' WHEN 1 THEN (ix // 9 + 1) || '.' || (ix % 9) || ' '
  WHEN 2 THEN 'Madde ' || ix || ' ' WHEN 3 THEN 'ON BİRİNCİ BÖLÜM ' WHEN 4 THEN 'EK-A ' WHEN 5 THEN '' ELSE (ix // 9 + 1) || '.' || (ix % 9) || '.1 ' END AS mark FROM l),
k AS (SELECT doc_id, ix, mark || part AS line, n < 100 AND length(mark || part) <= 80 AS fits, length(trim(part, ' ' || chr(9) || '-–—:')) <= 40 AS short, trim(mark) AS mark FROM m),
h AS (SELECT *, CASE ix % 7 WHEN 0 THEN CASE WHEN fits AND short THEN 1 END WHEN 1 THEN CASE WHEN fits THEN 2 END WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1
  WHEN 6 THEN CASE WHEN fits THEN 3 END END AS level, CASE WHEN ix % 7 IN (2, 3, 4) AND NOT short THEN mark ELSE line END AS title FROM k)"""


def _numbered(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(splitting.sentences(F.col("text"))).alias("ix", "line"))
    n, m = F.expr("ix div 9 + 1"), F.col("ix") % 9
    marks = [
        F.concat(n, F.lit(". ")), F.concat(n, F.lit("."), m, F.lit(" ")), F.concat(F.lit("Madde "), F.col("ix"), F.lit(" ")),
        F.lit(_MARKS[3]), F.lit(_MARKS[4]), F.lit(_MARKS[5]), F.concat(n, F.lit("."), m, F.lit(".1 ")),
    ]
    mark = F.element_at(F.array(*marks), F.col("ix") % 7 + 1)
    return rows.select("doc_id", "ix", F.concat(mark, F.regexp_replace("line", r"\s+$", "")).alias("line"))


@query(f"WITH {_LINES} SELECT doc_id, ix::INT AS ix, line, level::INT AS level FROM h")
def heading_levels(spark, sf_dir):
    return _numbered(spark, sf_dir).select("doc_id", "ix", "line", headings.heading_level(F.col("line")).cast("int").alias("level"))


@query(
    f"""WITH {_LINES}, u AS (SELECT *, max(CASE WHEN level = 1 THEN ix END) OVER w AS up1, max(CASE WHEN level = 2 THEN ix END) OVER w AS up2
  FROM h WHERE level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT u.doc_id, u.ix::INT AS ix, concat_ws(' > ', CASE WHEN u.level > 1 THEN a.title END, CASE WHEN u.level = 3 AND up2 > coalesce(up1, -1) THEN b.title END, u.title) AS section_path
FROM u LEFT JOIN h a ON a.doc_id = u.doc_id AND a.ix = up1 LEFT JOIN h b ON b.doc_id = u.doc_id AND b.ix = up2"""
)
def section_paths(spark, sf_dir):
    line = F.col("line")
    rows = _numbered(spark, sf_dir).select("doc_id", "ix", headings.heading_level(line).alias("level"), headings.heading_title(line).alias("title"))
    listed = F.array_sort(F.collect_list(F.struct("ix", F.col("level").cast("int").alias("level"), "title"))).alias("h")
    docs = rows.where("level is not null").groupBy("doc_id").agg(listed)
    paths = headings.section_paths(F.transform("h", lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"))))
    return docs.select("doc_id", F.explode(F.arrays_zip(F.transform("h", lambda x: x["ix"]).alias("ix"), paths.alias("section_path"))).alias("z")).select("doc_id", "z.*")


# --- profiles -----------------------------------------------------------------

_PROFILES = """p AS (SELECT CAST(d.doc_id AS VARCHAR) AS document_id, source || '/' || d.doc_id || '.txt' AS path, d.doc_id || '.txt' AS filename, lang AS language,
  CASE WHEN source IN ('src1', 'src2') THEN source END AS job_id, quality::DOUBLE AS parse_quality, n_chars FROM documents d LEFT JOIN labels USING (doc_id))"""


def _profiles(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
        F.concat("doc_id", F.lit(".txt")).alias("filename"),
        F.col("lang").alias("language"),
        F.when(F.col("source").isin("src1", "src2"), F.col("source")).alias("job_id"),
        F.col("quality").cast("double").alias("parse_quality"),
        "n_chars",
    )


@query(f"WITH {_PROFILES} SELECT * FROM p WHERE job_id IS NULL AND language IN ('en', 'fr') AND parse_quality >= 0.5 AND starts_with(path, 'src1')")
def filter_profiles(spark, sf_dir):
    f = Filters(languages=["en", "fr"], path_prefix="src1", min_parse_quality=0.5, unscoped_excludes_other_jobs=True)
    return _profiles(spark, sf_dir).where(profile_predicate(f))


@query(
    f"""WITH {_TF}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT chunk_id, term, round(tf * ln((1.0 + n) / (1 + df)), 6) AS weight FROM tf JOIN df USING (term), n WHERE length(term) > 2),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, term)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 10"""
)
def keywords_tfidf(spark, sf_dir):
    """Keywords by tf-idf, which stands in for an external extractor."""
    d = documents(spark, sf_dir)
    tf = retrieval.postings(d)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    rows = tf.where(F.length("term") > 2).join(df, "term").join(F.broadcast(n))
    rows = rows.select("chunk_id", "term", F.round(F.col("tf") * F.log((1.0 + F.col("n")) / (1 + F.col("df"))), 6).alias("weight"))
    return retrieval.top(rows, 10, F.desc("weight"), F.asc("term"), by="chunk_id")


@query()
def keywords_local(spark, sf_dir):
    """Keyphrases of each document by its own statistics."""
    from leafmill.functions import keywords

    return keywords.extract(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))


@query()
def section_chunks(spark, sf_dir):
    """Section-aware chunks of documents whose lines carry numbers."""
    lines = _numbered(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("ix").alias("block_ix"), F.col("line").alias("text"), F.lit(1).alias("page_no"), F.lit("text").alias("kind")
    )
    from leafmill.operators import sections

    rows = sections.sectioned(lines).select("document_id", "block_ix", "text", "page_no", "kind", "level", "title", "path", "gap")
    return splitting.chunk_documents(rows)


# --- index state --------------------------------------------------------------


def _chunk_rows(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), "text", F.lit(None).cast("string").alias("job_id"))


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS document_id, CASE WHEN lang = 'fr' THEN upper(text) ELSE text END AS text, NULL::VARCHAR AS job_id FROM documents")
def upsert_chunks(spark, sf_dir):
    fresh = table(spark, sf_dir, "documents").where("lang = 'fr'").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), lexical.upper(F.col("text")).alias("text"), F.lit(None).cast("string").alias("job_id")
    )
    return index.upsert(_chunk_rows(spark, sf_dir), fresh, "chunk_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS document_id, text, CASE WHEN source = 'src7' THEN 'job-1' END AS job_id FROM documents")
def set_job_id(spark, sf_dir):
    return index.set_job(_chunk_rows(spark, sf_dir), F.lit("src7"), "job-1")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN lang = 'de' THEN 'new' WHEN lang = 'fr' THEN 'changed' ELSE 'same' END AS action,
 sha256(text) AS content_hash FROM documents"""
)
def incremental_diff(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), ids.content_hash(F.col("text")).alias("content_hash"), "lang")
    state = found.where("lang <> 'de'").withColumn("content_hash", F.when(F.col("lang") == "fr", "old").otherwise(F.col("content_hash")))
    return index.diff(found.drop("lang"), state)


_STATUS = "CASE event_type WHEN 'click' THEN 'parsed' WHEN 'view' THEN 'embedded' WHEN 'purchase' THEN 'profiled' WHEN 'error' THEN 'failed' ELSE 'pending' END"


@query(
    f"""WITH s AS (SELECT {_STATUS} AS status FROM events)
SELECT count(*) FILTER (status IN ('parsed', 'embedded', 'profiled')) AS parsed, count(*) FILTER (status IN ('embedded', 'profiled')) AS embedded,
 count(*) FILTER (status = 'profiled') AS profiled, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM s"""
)
def state_progress(spark, sf_dir):
    return index.progress(table(spark, sf_dir, "events").select(F.expr(_STATUS).alias("status")))


def _attempts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as document_id", "event_id as seq", "event_type as parser", "round(value, 6) as quality",
        "case when event_id % 4 = 0 then 'failed' else 'ok' end as status", "concat('error ', event_id) as error",
    )


_ATTEMPTS = "a AS (SELECT CAST(user_id AS VARCHAR) AS document_id, event_id AS seq, event_type AS parser, round(value, 6) AS quality, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events)"


@query(
    f"""WITH {_ATTEMPTS}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY status <> 'failed' DESC, CASE WHEN status = 'failed' THEN 0 ELSE quality END DESC, seq) AS k FROM a)
SELECT document_id, parser, status, quality FROM r WHERE k = 1"""
)
def best_parse(spark, sf_dir):
    return index.best_parse(_attempts(spark, sf_dir))


@query(
    f"""WITH {_ATTEMPTS}, f AS (SELECT *, row_number() OVER (PARTITION BY parser ORDER BY document_id, seq) AS k, count(*) OVER (PARTITION BY parser) AS n FROM a WHERE status = 'failed')
SELECT parser, n, 'error ' || seq AS first_error FROM f WHERE k = 1"""
)
def parser_failures(spark, sf_dir):
    return index.parser_failures(_attempts(spark, sf_dir))


@query(f"WITH {_TF} SELECT * FROM tf")
def stream_index(spark, sf_dir):
    """Postings by an available-now stream with a keyed replacement per batch."""
    from leafmill.streaming import index as stream

    scratch = Scratch(spark, "stream")
    done: dict[str, DataFrame] = {}

    def apply(batch: DataFrame, number: int) -> None:
        fresh = retrieval.postings(batch.withColumn("chunk_id", F.col("doc_id").cast("string")))
        old = done.get("rows")
        done["rows"] = scratch.keep(fresh if old is None else index.replace_documents(old, fresh, "chunk_id"), f"batch-{number}")

    stream.run_available(stream.table_stream(spark, f"{sf_dir}/documents.parquet"), f"{scratch.root}/checkpoint", apply)
    return done["rows"]


# --- answers ------------------------------------------------------------------


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND length(coalesce(text, '')) > 0")
def history_filter(spark, sf_dir):
    return answers.history(table(spark, sf_dir, "conversations"))


def _tool_messages(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    row = F.struct(
        F.concat(F.lit("d"), F.col("turn") % 3).alias("doc_id"), F.concat(F.lit("c"), F.col("turn") % 4).alias("chunk_id"), F.col("text").alias("text")
    )
    return t.select("conv_id", "turn", F.to_json(F.array(row)).alias("payload"))


_POOL = """t AS (SELECT conv_id, turn, 'd' || (turn % 3) AS doc_id, 'c' || (turn % 4) AS chunk_id, text FROM conversations),
pool AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conv_id, chunk_id ORDER BY turn) = 1)"""


@query(f"WITH {_POOL} SELECT * FROM pool")
def evidence_pool(spark, sf_dir):
    return answers.evidence_pool(_tool_messages(spark, sf_dir)).select("conv_id", "turn", "doc_id", "chunk_id", "text")


@query(
    f"""WITH {_POOL}, a AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'no marks' WHEN conv_id % 3 = 1 THEN 'x ⟦c1⟧ y ⟦c0⟧ z ⟦c1⟧ ⟦c9⟧' ELSE 'BULAMADIM' END AS answer FROM conversations GROUP BY conv_id),
m AS (SELECT a.conv_id, chunk_id, seq FROM a, (VALUES ('c1', 0), ('c0', 1)) v(chunk_id, seq) WHERE a.conv_id % 3 = 1),
c AS (SELECT m.conv_id, m.chunk_id, doc_id, seq FROM m JOIN pool USING (conv_id, chunk_id)),
r AS (SELECT conv_id, chunk_id, doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM pool
  WHERE conv_id % 3 <> 2 AND conv_id NOT IN (SELECT conv_id FROM c))
SELECT conv_id, chunk_id, doc_id, seq::INT AS seq FROM c UNION ALL SELECT conv_id, chunk_id, doc_id, seq::INT FROM r WHERE seq < 3"""
)
def answer_sources(spark, sf_dir):
    pool = answers.evidence_pool(_tool_messages(spark, sf_dir))
    said = F.expr("case conv_id % 3 when 0 then 'no marks' when 1 then 'x ⟦c1⟧ y ⟦c0⟧ z ⟦c1⟧ ⟦c9⟧' else 'BULAMADIM' end")
    asked = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("answer", said)
    return answers.answer_sources(asked, pool)


# --- evaluation ---------------------------------------------------------------

_GOLD = "gold AS (SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_RANKED = "(" + _bm25_sql(_BATCH, "true", 20).replace("WITH d AS", "WITH dd AS").replace("FROM d)", "FROM dd)").replace("FROM d),", "FROM dd),") + ")"
_METRICS = f"""{_GOLD}, ranked AS (SELECT query_id, chunk_id AS document_id, rank FROM {_RANKED}),
g AS (SELECT gold.query_id, count(*) AS n, count(*) FILTER (rank <= @k@) AS found, max(1.0::DOUBLE / rank) AS mrr, sum(CASE WHEN rank <= @k@ THEN 1 / log2(rank + 1.0) END) AS dcg
  FROM gold LEFT JOIN ranked USING (query_id, document_id) GROUP BY 1),
e AS (SELECT item_id AS query_id, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS question_type, 'benchmark' AS goldset,
  round(coalesce(found / n::DOUBLE, 0), 6) AS recall, round(coalesce(mrr, 0), 6) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n, @k@) + 1), lambda i: 1 / log2(i + 1.0))), 0), 6) AS ndcg
  FROM benchmark LEFT JOIN g ON g.query_id = item_id)"""


def _metrics_sql(k: int, tag: str = "") -> str:
    """The metrics at k; ``tag`` tells the names of several apart."""
    sql = _METRICS.replace("@k@", str(k))
    for name in ("gold", "ranked", "g", "e"):
        sql = re.sub(rf"\b{name}\b(?=\.| AS \(|$)|(?<=FROM ){name}\b|(?<=JOIN ){name}\b", name + tag, sql)
    return sql


def _gold(spark, sf_dir) -> DataFrame:
    """Documents that hold a question's passage.  A passage's longest inner word
    stands whole in any text around it; documents with that word are looked at,
    and all of them for the passages, few by a check, that have no such word."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    inner = F.split("passage", r"\s+")
    inner = F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    b = Scratch(spark, "gold").keep(b.withColumn("key", F.when(key != "", key)), "passages")
    words = d.select("document_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("key"))
    near = words.join(retrieval.small(b.where("key is not null"), retrieval.MOST_QUERIES), "key").select("document_id", "query_id", "passage")
    hit = d.join(near, "document_id").where(F.col("text").contains(F.col("passage"))).select("query_id", "document_id")
    for block in retrieval.blocks(b.where("key is null")):
        short = d.join(F.broadcast(block), F.col("text").contains(F.col("passage")))
        hit = hit.unionByName(short.select("query_id", "document_id"))
    return hit.distinct()


def _metrics(spark, sf_dir, *ks: int, depth: int = 20) -> list[DataFrame]:
    """The metrics at each k, over one ranking and one set of gold documents."""
    scratch = Scratch(spark, "metrics")
    hits = retrieval.bm25(_questions(spark, sf_dir), documents(spark, sf_dir), depth)
    ranked = scratch.keep(evaluation.ranked_documents(hits.withColumnRenamed("chunk_id", "document_id")), "ranked")
    gold = scratch.keep(_gold(spark, sf_dir), "gold")
    q = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(F.length("text") < 200, "short").otherwise("long").alias("question_type"), F.lit("benchmark").alias("goldset")
    )
    return [evaluation.retrieval_metrics(q, gold, ranked, k) for k in ks]


@query(f"WITH {_metrics_sql(10)} SELECT * FROM e")
def ir_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, 10)[0]


@query(
    f"""WITH {_metrics_sql(10)} SELECT goldset, coalesce(question_type, 'all') AS question_type, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg
FROM e GROUP BY GROUPING SETS ((goldset, question_type), (goldset))"""
)
def ir_metrics_rollup(spark, sf_dir):
    mean = {m: F.round(F.avg(m), 6) for m in ("recall", "mrr", "ndcg")}
    return evaluation.roll_up(_metrics(spark, sf_dir, 10)[0], ["goldset", "question_type"], ["goldset"], {"n": F.count(F.lit(1)), **mean})


@query(
    f"""WITH {_metrics_sql(1)}, {_metrics_sql(5, "5")}
SELECT 1 AS k, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM e UNION ALL SELECT 5, round(avg(recall), 6), round(avg(ndcg), 6) FROM e5"""
)
def parameter_sweep(spark, sf_dir):
    parts = [
        m.agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg")).select(F.lit(k).alias("k"), "recall", "ndcg")
        for k, m in zip((1, 5), _metrics(spark, sf_dir, 1, 5), strict=True)
    ]
    return parts[0].unionByName(parts[1])


_VERDICTS = """v AS (SELECT doc_id, lang AS question_type, 'labels' AS goldset, CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 END AS answer_correct,
 CASE WHEN toxic IS NULL THEN NULL ELSE 1 - toxic * 0.5::DOUBLE END AS "precision", toxic::DOUBLE AS recall, doc_id % 7 AS tool_calls FROM documents LEFT JOIN labels USING (doc_id))"""


@query(
    f"""WITH {_VERDICTS} SELECT goldset, coalesce(question_type, 'all') AS question_type, count(*) AS n, count(answer_correct) AS n_judged,
round(avg(answer_correct::INT), 6) AS accuracy, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(tool_calls), 6) AS tool_calls
FROM v GROUP BY GROUPING SETS ((goldset, question_type), (goldset))"""
)
def agent_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select(
        F.col("lang").alias("question_type"),
        F.lit("labels").alias("goldset"),
        (F.col("quality") == 1).alias("answer_correct"),
        (1 - F.col("toxic") * 0.5).alias("precision"),
        F.col("toxic").cast("double").alias("recall"),
        (F.col("doc_id") % 7).alias("tool_calls"),
    )
    return evaluation.roll_up(rows, ["goldset", "question_type"], ["goldset"], evaluation.answer_metrics())


@query(
    """WITH s AS (SELECT doc_id, ['d' || (doc_id % 4), 'd' || (doc_id % 3)] AS cited, list_transform(range(0, doc_id % 4), lambda i: 'd' || i) AS gold FROM documents),
x AS (SELECT *, len(list_intersect(list_distinct(cited), list_distinct(gold))) AS b, len(list_distinct(cited)) AS c, len(gold) AS g FROM s)
SELECT doc_id, CASE WHEN g > 0 THEN round(b / c::DOUBLE, 6) END AS "precision", CASE WHEN g > 0 THEN round(b / g::DOUBLE, 6) END AS recall,
CASE WHEN g = 0 THEN NULL WHEN b = 0 THEN 0 ELSE round(2.0::DOUBLE * b / (c + g), 6) END AS f1 FROM x"""
)
def citation_scores(spark, sf_dir):
    d = F.col("doc_id")
    gold = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < d % 4), lambda i: F.concat(F.lit("d"), i))
    cited = F.array(F.concat(F.lit("d"), d % 4), F.concat(F.lit("d"), d % 3))
    s = evaluation.citation_scores(cited, gold)
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(s[n], 6).alias(n) for n in ("precision", "recall", "f1")])
