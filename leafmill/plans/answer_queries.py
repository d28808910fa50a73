"""Queries over profiles, filters, answers and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import profile, splitting
from leafmill.operators import answers, evaluation, index, retrieval
from leafmill.operators.filters import Filters, profile_predicate
from leafmill.plans.queries import _BATCH, _CHUNKS, _GOLD, _HITS, _bm25_sql, _gold, _hits, _questions, _terms_sql, documents, query, sentence_chunks, table
from leafmill.scratch import Scratch

# --- profiles and filters -----------------------------------------------------

_PROFILES = """p AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, source || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS filename, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS language,
  ['txt', 'md', 'pdf'][doc_id % 3 + 1] AS doc_type, CASE WHEN doc_id % 4 = 0 THEN source END AS job_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * (doc_id % 500) END AS modified_at,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE ['t' || (doc_id % 5), 't' || (doc_id % 3)] END AS topics, (doc_id % 100) / 100.0::DOUBLE AS parse_quality FROM documents)"""


def _profiles(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.cast("string").alias("document_id"), F.concat("source", F.lit("/"), i, F.lit(".txt")).alias("path"), F.concat(i, F.lit(".txt")).alias("filename"),
        F.when(i % 6 != 0, F.col("lang")).alias("language"), F.element_at(F.array(F.lit("txt"), F.lit("md"), F.lit("pdf")), (i % 3 + 1).cast("int")).alias("doc_type"),
        F.when(i % 4 == 0, F.col("source")).alias("job_id"), F.when(i % 10 != 0, F.expr("timestamp '2020-01-01' + make_interval(0, 0, 0, cast(doc_id % 500 as int))")).alias("modified_at"),
        F.when(i % 7 != 0, F.array(F.concat(F.lit("t"), i % 5), F.concat(F.lit("t"), i % 3))).alias("topics"), F.expr("(doc_id % 100) / 100.0D").alias("parse_quality"),
    )


@query(
    f"""WITH {_PROFILES} SELECT document_id FROM p WHERE list_has_any(topics, ['t1', 't9']) AND modified_at >= TIMESTAMP '2020-03-01' AND modified_at <= TIMESTAMP '2020-12-01'
 AND doc_type IN ('txt', 'pdf')"""
)
def filter_topics_dates(spark, sf_dir):
    f = Filters(topics=["t1", "t9"], date_from="2020-03-01", date_to="2020-12-01", doc_types=["txt", "pdf"])
    return _profiles(spark, sf_dir).where(profile_predicate(f)).select("document_id")


@query(f"WITH {_PROFILES} SELECT document_id, filename, job_id FROM p WHERE job_id IN ('src0', 'src1', 'src2', 'src3') AND parse_quality >= 0.25 ORDER BY filename, document_id LIMIT 50")
def list_documents(spark, sf_dir):
    f = Filters(job_ids=["src0", "src1", "src2", "src3"], min_parse_quality=0.25)
    return answers.listing(_profiles(spark, sf_dir).where(profile_predicate(f))).select("document_id", "filename", "job_id")


@query(f"WITH {_PROFILES} SELECT document_id, CASE WHEN document_id::INT % 5 = 0 THEN 'new' ELSE filename END AS filename, CASE WHEN document_id::INT % 5 = 0 THEN 'j' ELSE job_id END AS job_id FROM p")
def upsert_profiles(spark, sf_dir):
    rows = _profiles(spark, sf_dir).select("document_id", "filename", "job_id")
    fresh = rows.where("cast(document_id as int) % 5 = 0").select("document_id", F.lit("new").alias("filename"), F.lit("j").alias("job_id"))
    return index.upsert(rows, fresh, "document_id")


_W = r"[\p{L}\p{N}\p{M}_]"
_FOUND = "list_filter(list_transform({}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"
_ENTITIES = _FOUND.format(
    " || ".join(
        f"regexp_extract_all(text, '{p}')"
        for p in (
            r"[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]{2})?\s?(?:TL|₺|USD|\$|EUR|€|TRY)", r"\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}\b",
            r"\b[0-9]{4}[/-][A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\b", rf"\b(?:{_W}|[.+-])+@(?:{_W}|-)+\.(?:{_W}|[.-])+\b", r"\b[0-9]{11}\b", r"\b[0-9]{10}\b",
            rf"[A-ZĞÜŞİÖÇ](?:{_W}|[ğüşıöç])+(?:\s+[A-ZĞÜŞİÖÇ](?:{_W}|[ğüşıöç])+)+",
        )
    )
)


@query(f"SELECT doc_id, list_sort(list_distinct({_ENTITIES})) AS found FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') || ' 12.500,00 TL 31/12/2020 ' || source AS text FROM documents)")
def entities(spark, sf_dir):
    """All kinds of entities; letters beyond ASCII are x, as the two engines
    bound words in different ways around them."""
    text = F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", "x"), F.lit(" 12.500,00 TL 31/12/2020 "), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(profile.entities(text)).alias("found"))


_META = "['Untitled', '  Own title ' || doc_id || ' ', '', 'Microsoft Word - x', NULL]"
_TITLES = f"""t AS (SELECT doc_id, source, lang, text, trim({_META}[doc_id % 5 + 1]) AS meta, CASE WHEN doc_id % 3 > 0 THEN 'Heading ' || lang END AS head, CASE WHEN doc_id % 2 = 0 THEN 'Large ' || source END AS big FROM documents),
u AS (SELECT *, coalesce(CASE WHEN meta <> '' AND NOT regexp_matches(meta, '^(microsoft word|untitled|document[0-9]*)', 'i') THEN meta END, head, big) AS title FROM t)"""


def _titled(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    meta = F.element_at(F.array(F.lit("Untitled"), F.concat(F.lit("  Own title "), i, F.lit(" ")), F.lit(""), F.lit("Microsoft Word - x"), F.lit(None)), (i % 5 + 1).cast("int"))
    sized = ((F.lit("small"), 9.0), (F.concat(F.lit("Large "), "source"), 14.0), (F.lit("also"), 14.0))
    blocks = F.when(i % 2 == 0, F.array(*[F.struct(F.lit(k).alias("ix"), t.alias("text"), F.lit(z).alias("font_size")) for k, (t, z) in enumerate(sized)]))
    rows = table(spark, sf_dir, "documents")
    return rows.withColumn("title", profile.title(meta, F.when(i % 3 > 0, F.concat(F.lit("Heading "), "lang")), profile.largest(blocks)))


@query(f"WITH {_TITLES} SELECT doc_id, title FROM u")
def profile_titles(spark, sf_dir):
    return _titled(spark, sf_dir).select("doc_id", "title")


_OUTLINE = "o AS (SELECT doc_id, list_concat(['A ' || doc_id], list_transform(range(0, least(doc_id % 9, 5)), lambda k: 'k' || k), ['B'], list_transform(range(0, least(doc_id % 4, 5)), lambda k: 'm' || k)) AS titles FROM documents)"


def _outline(i: Column) -> Column:
    entry = lambda level, title: F.struct(F.lit(level).alias("level"), title.alias("title"))
    kids = lambda n, mark: F.transform(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda k: k < n), lambda k: entry(3, F.concat(F.lit(mark), k)))
    deep = F.array(entry(5, F.lit("deeper")))
    return F.concat(F.array(entry(1, F.concat(F.lit("A "), i))), kids(i % 9, "k"), deep, F.array(entry(1, F.lit("B"))), kids(i % 4, "m"))


@query(f"WITH {_OUTLINE} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN replace(array_to_string(titles, ' · '), 'A ' || doc_id || ' · ', 'A ' || doc_id || ' · deeper · ') ELSE array_to_string(titles, ' · ') END AS outline FROM o")
def profile_outlines(spark, sf_dir):
    """The first entries of an outline: two tops, up to nine children, one deeper."""
    return table(spark, sf_dir, "documents").select("doc_id", profile.outline_text(_outline(F.col("doc_id"))).alias("outline"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE text[1:200] || chr(10) || '...' || chr(10) || right(text, 200) END AS body FROM documents")
def body_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", profile.body_excerpt(F.col("text"), 400).alias("body"))


_STRIPPED = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    f"""WITH {_TITLES}, b AS (SELECT *, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_STRIPPED})), lambda x: length(x) >= 60)[1][1:500], '') AS intro FROM u)
SELECT doc_id, concat_ws(chr(10), CASE WHEN length(title) > 0 THEN title END, 'Yol: ' || source || ' ' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Bölümler: ' || lang || ' · ' || source END,
 'Anahtar terimler: ' || lang || ', ' || source, CASE WHEN intro <> '' THEN 'Giriş: ' || intro END, CASE WHEN doc_id % 3 = 0 THEN 'Varlıklar: e' || doc_id || ', x' END, 'Tip: txt · ' || (doc_id % 9) || ' sayfa') AS text, intro[1:300] AS summary FROM b"""
)
def cheap_profile(spark, sf_dir):
    i, empty = F.col("doc_id"), F.array().cast("array<string>")
    rows = _titled(spark, sf_dir).withColumns(
        {"intro": profile.intro(F.split("text", "\n")), "words": profile.path_terms(F.concat("source", F.lit("/"), i, F.lit("_final.txt")))}
    )
    outline = F.when(i % 2 == 0, F.concat_ws(" · ", "lang", "source"))
    found = F.when(i % 3 == 0, F.array(F.concat(F.lit("e"), i), F.lit("x"))).otherwise(empty)
    text = profile.profile_text(F.col("title"), F.col("words"), outline, F.array("lang", "source"), F.col("intro"), found, F.lit("txt"), (i % 9).cast("int"))
    return rows.select("doc_id", text.alias("text"), F.substring("intro", 1, 300).alias("summary"))


@query(
    """WITH m AS (SELECT doc_id, ['Ozet bir. iki', 'yalniz', '', '', ''][doc_id % 5 + 1] AS s, [['rapor', 'a', 'b', 'c'], [], ['x'], [], ['b', 'q']][doc_id % 5 + 1] AS t, source, lang FROM documents)
SELECT doc_id, CASE WHEN s <> '' THEN s ELSE 'base ' || source END AS summary, CASE WHEN len(t) > 0 THEN t ELSE [lang] END AS topics, ['has_intro', 'has_llm_summary'] AS profile_source,
 s || chr(10) || 'Konular: ' || array_to_string(t, ', ') AS profile_text FROM m"""
)
def model_profiles(spark, sf_dir):
    """Profiles after a model has spoken, from five kinds of answers."""
    said = ("Ozet bir.\nKONULAR: A, b ,, C\n iki \nTIP: Rapor", "yalniz", "konular: x\ntip:", "", "TIP: a\nTIP: B\nKONULAR: b, Q")
    answer = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("doc_id") % 5 + 1).cast("int"))
    made = profile.model_profile(answer, F.concat(F.lit("base "), "source"), F.array("lang"), F.array(F.lit("has_intro")))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("m")).select("doc_id", "m.*")


# --- chunks -------------------------------------------------------------------

_SECTIONED = f"""WITH {_CHUNKS}, x AS (SELECT *, ['A', 'A > B', 'C', NULL][start % 4 + 1] AS section FROM ch)"""


def _sectioned(spark, sf_dir) -> DataFrame:
    path = F.element_at(F.array(F.lit("A"), F.lit("A > B"), F.lit("C"), F.lit(None)), (F.col("start") % 4 + 1).cast("int"))
    return sentence_chunks(spark, sf_dir).withColumns({"section_path": path, "job_id": F.lit(None).cast("string")})


@query(
    f"""{_SECTIONED}, t AS (SELECT document_id, string_agg(text, chr(10) ORDER BY start, chunk_id) AS x FROM x WHERE starts_with(section, 'A') GROUP BY document_id)
SELECT document_id, CASE WHEN length(x) > 12000 THEN x[1:12000] || chr(10) || '[…]' ELSE x END AS text FROM t"""
)
def get_section(spark, sf_dir):
    return answers.document_text(_sectioned(spark, sf_dir), "A")


@query(f"{_SECTIONED} SELECT document_id, list(section ORDER BY spot) AS sections FROM (SELECT document_id, section, min(start) AS spot FROM x WHERE section IS NOT NULL GROUP BY ALL) GROUP BY document_id")
def document_outlines(spark, sf_dir):
    return answers.document_outline(_sectioned(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT document_id, string_agg(text, ' ' ORDER BY start, chunk_id)[1:600] AS summary FROM ch GROUP BY document_id")
def document_summaries(spark, sf_dir):
    return answers.summaries(sentence_chunks(spark, sf_dir))


@query(f"WITH {_CHUNKS}, {_HITS} SELECT h.chunk_id, h.rank, CASE WHEN document_id::INT % 2 = 0 THEN document_id || '.txt' ELSE document_id END AS filename FROM h JOIN ch USING (chunk_id)")
def display_names(spark, sf_dir):
    chunks = sentence_chunks(spark, sf_dir)
    hits = _hits(chunks).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    known = _profiles(spark, sf_dir).where("cast(document_id as int) % 2 = 0")
    return retrieval.display_names(hits, known).select("chunk_id", "rank", "filename")


@query(
    """WITH r AS (SELECT n_regionkey, n_nationkey, trim(n_name) AS a, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_nationkey::VARCHAR END AS b FROM nation)
SELECT 'r' || n_regionkey AS document_id, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || a || ' | ' || b || ' |', chr(10) ORDER BY n_nationkey) AS text FROM r GROUP BY n_regionkey"""
)
def table_markdown(spark, sf_dir):
    """Table blocks, some rows of which lack a cell, as chunks."""
    n = table(spark, sf_dir, "nation")
    row = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit("\t "), "n_nationkey"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("line")))), lambda r: r["line"])
    none = F.lit(None).cast("string")
    blocks = n.groupBy("n_regionkey").agg(F.concat(F.lit("name\tkey\n"), F.array_join(rows, "\n")).alias("text"))
    blocks = blocks.select(
        F.concat(F.lit("r"), "n_regionkey").alias("document_id"), F.lit(0).alias("block_ix"), "text", F.lit(1).alias("page_no"), F.lit("table").alias("kind"),
        F.lit(None).cast("int").alias("level"), none.alias("title"), none.alias("path"),
    )
    return splitting.chunk_documents(blocks).select("document_id", "text")


# --- answers ------------------------------------------------------------------


@query(
    """WITH r AS (SELECT conv_id, turn, 'd' || (turn % 5) AS doc_id, CASE WHEN turn % 2 = 0 THEN 'c' || turn END AS chunk_id, turn AS page FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, doc_id ORDER BY chunk_id IS NULL, turn) AS k FROM r)
SELECT conv_id, doc_id, page, (row_number() OVER (PARTITION BY conv_id ORDER BY chunk_id IS NULL, turn) - 1)::INT AS seq FROM f WHERE k = 1"""
)
def documents_seen(spark, sf_dir):
    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(0).alias("ix"), F.concat(F.lit("d"), t % 5).alias("doc_id"), F.when(t % 2 == 0, F.concat(F.lit("c"), t)).alias("chunk_id"), t.alias("page"))
    return answers.documents_seen(rows)


@query("SELECT conv_id, turn, text AS answer FROM conversations")
def plain_answers(spark, sf_dir):
    """Answers without their marks: texts that were given some."""
    t = table(spark, sf_dir, "conversations")
    marked = F.concat(F.regexp_replace("text", r"([.,])", "$1"), F.lit(" ⟦c1⟧⟦c-2⟧"))
    return t.select("conv_id", "turn", answers.plain_answer(marked).alias("answer"))


@query("SELECT doc_id, [true, true, false, false, true][doc_id % 5 + 1] AS verdict FROM documents")
def judge_verdicts(spark, sf_dir):
    said = ("EVET", " evet, doğru\nHAYIR", "HAYIR\nEVET", "", "Evet.")
    answer = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.judge_verdict(answer).alias("verdict"))


@query(
    """SELECT lang, max({'v': (doc_id * 7) % 10, 's': doc_id % 4}).s AS best_recall, max({'v': (doc_id * 3) % 8, 's': doc_id % 4}).s AS best_mrr FROM documents GROUP BY lang"""
)
def best_settings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") * 7 % 10).alias("recall"), (F.col("doc_id") * 3 % 8).alias("mrr"), (F.col("doc_id") % 4).alias("setting"))
    return evaluation.best_per_column(d, ["lang"], ["recall", "mrr"], "setting")


# --- strategies ---------------------------------------------------------------

_SPARSE = f"""sd AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, unnest({_terms_sql('text')}) AS term FROM documents),
sq AS ({_BATCH}), ss AS (SELECT query_id, chunk_id, count(*) AS score FROM sd JOIN sq USING (term) GROUP BY ALL),
r_sparse AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ss QUALIFY rank <= 10)"""
_BM25 = f"r_bm25 AS (SELECT query_id, chunk_id, rank FROM ({_bm25_sql(_BATCH, 'true', 10)}))"
_FUSED = """u AS (SELECT query_id, chunk_id, rank, 0 AS l FROM r_bm25 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM r_sparse),
fu AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min({'l': l, 'r': rank}) AS first FROM u GROUP BY ALL),
r_fused AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first.l, first.r) AS rank FROM fu QUALIFY rank <= 10)"""


def _measured(name: str) -> str:
    return f"""SELECT '{name}' AS strategy, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM (
  SELECT item_id, coalesce(count(r.rank) / nullif(count(gold.document_id), 0)::DOUBLE, 0) AS recall, coalesce(max(1.0::DOUBLE / r.rank), 0) AS mrr
  FROM benchmark LEFT JOIN gold ON gold.query_id = item_id LEFT JOIN r_{name} r ON r.query_id = item_id AND r.chunk_id = gold.document_id GROUP BY item_id)"""


@query(f"WITH {_GOLD}, {_SPARSE}, {_BM25}, {_FUSED} {' UNION ALL '.join(_measured(n) for n in ('bm25', 'sparse', 'fused'))}")
def strategy_sweep(spark, sf_dir):
    """Recall and MRR of keyword searches and their fusion, over the same questions."""
    scratch = Scratch(spark, "sweep")
    asked, docs = _questions(spark, sf_dir), documents(spark, sf_dir)
    gold = scratch.keep(_gold(spark, sf_dir), "gold")
    ways = {"bm25": retrieval.bm25, "sparse": retrieval.sparse_terms}
    hits = {n: scratch.keep(f(asked, docs, 10), n) for n, f in ways.items()}
    hits["fused"] = retrieval.fuse([hits["bm25"], hits["sparse"]], 10)
    out: DataFrame | None = None
    for name, found in hits.items():
        ranked = evaluation.ranked_documents(found.withColumnRenamed("chunk_id", "document_id"))
        rows = evaluation.retrieval_metrics(asked.select("query_id"), gold, ranked, 10)
        part = rows.agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr")).select(F.lit(name).alias("strategy"), "recall", "mrr")
        out = part if out is None else out.unionByName(part)
    return out
