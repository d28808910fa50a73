"""Queries over parsers, the chain, the gate and the index state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import headings, ids, splitting
from leafmill.operators import evaluation, index, parsing, sections
from leafmill.operators.filters import under
from leafmill.plans.queries import _SENTENCES, quality_sql, query, sentence_chunks, table
from leafmill.sources import parsers

# --- parsers ------------------------------------------------------------------


def _files(rows: DataFrame, path, content) -> DataFrame:
    return rows.select(path.alias("path"), content.cast("binary").alias("content"))


def _blocks(files: DataFrame) -> DataFrame:
    return parsers.parse_files(files).select("path", F.explode("blocks").alias("b")).select("path", "b.ix", "b.text", "b.page_no", "b.kind", "b.level")


def _block_rows(parts: str) -> str:
    """SQL of numbered blocks from a relation of (path, ord, text, kind, level)."""
    return f"SELECT path, (row_number() OVER (PARTITION BY path ORDER BY ord) - 1)::INT AS ix, text, 1 AS page_no, kind, level::INT AS level FROM ({parts}) WHERE text <> ''"


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    rf"""WITH s AS (SELECT doc_id || '.txt' AS path, string_split_regex(text, '\n\s*\n') AS parts FROM documents),
p AS (SELECT path, unnest(range(0, len(parts))) AS ord, trim(unnest(parts), {_STRIP}) AS text, 'text' AS kind, NULL AS level FROM s)
{_block_rows('SELECT * FROM p')}"""
)
def text_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return _blocks(_files(d, F.concat("doc_id", F.lit(".txt")), F.encode("text", "UTF-8")))


_MD = """SELECT doc_id || '.md' AS path, 0 AS ord, 'Report ' || doc_id AS text, 'heading' AS kind, 1 AS level FROM documents
UNION ALL SELECT doc_id || '.md', 1, 'about ' || source, 'text', NULL FROM documents
UNION ALL SELECT doc_id || '.md', 2, 'Part ' || lang, 'heading', 3 FROM documents
UNION ALL SELECT doc_id || '.md', 3, trim(text, {strip}), 'text', NULL FROM documents
UNION ALL SELECT doc_id || '.md', 4, 'Deep', 'heading', 4 FROM documents
UNION ALL SELECT doc_id || '.md', 5, 'End', 'heading', 2 FROM documents""".format(strip=_STRIP)


def _markdown(spark, sf_dir) -> DataFrame:
    body = F.concat(
        F.lit("# Report "), F.col("doc_id"), F.lit("\nabout "), F.col("source"), F.lit("\n\n### Part "), F.col("lang"), F.lit(" ##\n"), F.col("text"),
        F.lit("\n#### Deep\n## End\n"),
    )
    return _files(table(spark, sf_dir, "documents"), F.concat("doc_id", F.lit(".md")), F.encode(body, "UTF-8"))


@query(_block_rows(_MD))
def markdown_blocks(spark, sf_dir):
    return _blocks(_markdown(spark, sf_dir))


@query(
    """WITH d AS (SELECT doc_id || '.md' AS path, 'Report ' || doc_id AS a, 'Part ' || lang AS b FROM documents)
SELECT path, 0 AS ord, 1 AS level, a AS title, a AS section FROM d UNION ALL SELECT path, 1, 3, b, a || ' > ' || b FROM d
UNION ALL SELECT path, 2, 4, 'Deep', a || ' > ' || b || ' > Deep' FROM d UNION ALL SELECT path, 3, 2, 'End', a || ' > End' FROM d"""
)
def markdown_outline(spark, sf_dir):
    rows = parsers.parse_files(_markdown(spark, sf_dir)).select("path", F.explode("outline").alias("o"))
    return rows.select("path", "o.ord", "o.level", "o.title", F.col("o.path").alias("section"))


def _tag(names: str, close: str = "") -> str:
    return rf"(?i)<{close}(?:{names})(?:\s[^>]*)?>"


_HTML = rf"""h0 AS (SELECT page_id || '.html' AS path, regexp_replace(regexp_replace(html, '(?is)<head>.*?</head>', '', 'g'), '(?s)<!--.*?-->|<![^>]*>', '', 'g') AS t FROM pages),
h1 AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(t, '{_tag("h([1-6])")}', chr(1) || '\1', 'g'), '(?i)<br>', chr(1) || '=', 'g'), '(?i)</h[1-6]>', chr(1) || '0', 'g') AS t FROM h0),
h2 AS (SELECT path, regexp_replace(regexp_replace(t, '{_tag("p|div|li|td|th|tr|table|section|article", "/")}', chr(1) || '=', 'g'), '<[a-zA-Z/][^>]*>', '', 'g') AS t FROM h1),
h3 AS (SELECT path, string_split('0' || t, chr(1)) AS parts FROM h2),
h4 AS (SELECT path, unnest(range(0, len(parts))) AS ord, unnest(parts) AS part FROM h3),
h5 AS (SELECT path, ord, part[1] AS mark, part[2:] AS raw FROM h4),
h6 AS (SELECT *, last_value(CASE WHEN mark <> '=' THEN mark END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ord) AS lv FROM h5),
h7 AS (SELECT path, ord, nullif(lv, '0') AS level, replace(replace(replace(replace(raw, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<') AS t FROM h6),
h8 AS (SELECT path, ord, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text, CASE WHEN level IS NULL THEN 'text' ELSE 'heading' END AS kind, level FROM h7)"""


def _pages(spark, sf_dir) -> DataFrame:
    return _files(table(spark, sf_dir, "pages"), F.concat("page_id", F.lit(".html")), F.encode("html", "UTF-8"))


@query(f"WITH {_HTML} {_block_rows('SELECT * FROM h8')}")
def html_blocks(spark, sf_dir):
    return _blocks(_pages(spark, sf_dir))


@query(f"WITH {_HTML} SELECT path, text AS title FROM h8 WHERE kind = 'heading' AND text <> ''")
def html_headings(spark, sf_dir):
    return _blocks(_pages(spark, sf_dir)).where("kind = 'heading'").select("path", F.col("text").alias("title"))


_SUFFIXES = (".txt", ".md", ".HTM", ".zip", "", ".PNG", ".docx", ".pdf")
_ENDING = f"[{', '.join(repr(s) for s in _SUFFIXES)}][doc_id % 8 + 1]"


@query(
    f"""SELECT 'f' || doc_id || {_ENDING} AS path, CASE WHEN doc_id % 8 < 3 THEN 'ok' ELSE 'failed' END AS status,
 ['text', 'text', 'text', 'none', 'none', 'ocr', 'docx', 'pdf'][doc_id % 8 + 1] AS parser,
 [NULL, NULL, NULL, 'no parser can handle .zip', 'no parser can handle a file without a suffix', 'RuntimeError: OCR is not installed',
  'BadZipFile: File is not a zip file', 'ValueError: not a PDF file'][doc_id % 8 + 1] AS error,
 ['text', 'text', 'text', '', '', 'ocr', 'docx', 'pdf,ocr,docling'][doc_id % 8 + 1] AS candidates FROM documents"""
)
def parse_dispatch(spark, sf_dir):
    ending = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("doc_id") % 8 + 1).cast("int"))
    files = _files(table(spark, sf_dir, "documents"), F.concat(F.lit("f"), "doc_id", ending), F.encode(F.concat("source", F.lit(" x")), "UTF-8"))
    rows = parsers.parse_files(files).select("path", "status", "parser", "error")
    return rows.withColumn("candidates", F.array_join(parsers.candidates(F.col("path")), ","))


# --- the chain and the gate ---------------------------------------------------

_GIVEN = """o AS (SELECT doc_id::VARCHAR AS document_id, p.cost, p.parser, (doc_id + p.k * 7) % 4 <> 0 AS ok, ((doc_id * 13 + p.k * 29) % 100) / 100.0::DOUBLE AS quality,
  CASE WHEN (doc_id + p.k) % 11 = 0 THEN NULL WHEN (doc_id + p.k * 3) % 6 = 0 THEN 'ocr' WHEN (doc_id + p.k * 3) % 6 = 1 THEN 'docling' END AS wish,
  (doc_id + p.k) % 11 = 0 AS lost, 'no ' || p.parser AS error
  FROM documents, (VALUES ('text', 5, 1), ('pdf', 10, 2), ('ocr', 100, 3), ('docling', 200, 4)) p(parser, cost, k) WHERE (doc_id // p.k) % 4 <> 3)"""


@query(
    f"""WITH RECURSIVE {_GIVEN},
c AS (SELECT document_id, list(parser ORDER BY cost) AS names FROM o GROUP BY document_id),
w AS (SELECT document_id, names, 0 AS n, []::VARCHAR[] AS tried, names[1] AS turn, false AS escalating, NULL::VARCHAR AS best, NULL::DOUBLE AS bq, NULL::VARCHAR AS bw, false AS bl,
  NULL::VARCHAR AS failed, NULL::VARCHAR AS unmet FROM c
  UNION ALL
  SELECT document_id, names, n + 1, tried || [turn],
    CASE WHEN ok THEN next_wish WHEN escalating THEN NULL ELSE rest[1] END, CASE WHEN ok THEN next_wish IS NOT NULL ELSE escalating END,
    CASE WHEN better THEN turn ELSE best END, CASE WHEN better THEN quality ELSE bq END, CASE WHEN better THEN wish ELSE bw END, CASE WHEN better THEN lost ELSE bl END,
    coalesce(failed, CASE WHEN NOT ok THEN turn END), CASE WHEN NOT ok AND escalating THEN error ELSE unmet END
  FROM (SELECT w.*, o.ok, o.quality, o.wish, o.lost, o.error, o.ok AND (w.best IS NULL OR o.quality > w.bq) AS better,
      list_filter(w.names, lambda x: NOT list_contains(w.tried || [w.turn], x)) AS rest,
      CASE WHEN list_contains(list_filter(w.names, lambda x: NOT list_contains(w.tried || [w.turn], x)), o.wish) THEN o.wish END AS next_wish
    FROM w JOIN o ON o.document_id = w.document_id AND o.parser = w.turn) s),
e AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC) = 1)
SELECT document_id, coalesce(best, failed) AS parser, CASE WHEN best IS NULL THEN 'failed' WHEN bl THEN 'degraded' WHEN bw IS NULL OR bw = best THEN 'ok' ELSE 'degraded' END AS status,
  coalesce(bq, 0) AS quality, CASE WHEN best IS NULL THEN 'no ' || failed WHEN bl THEN 'seen' WHEN bw IS NULL OR bw = best THEN NULL
    ELSE 'escalation to ' || bw || ' for seen gave nothing better' || coalesce(': ' || unmet, '') END AS error, array_to_string(tried, ',') AS tried FROM e"""
)
def parse_chain(spark, sf_dir):
    """The way through the chain, from what each parser would give."""
    links = spark.createDataFrame([("text", 5, 1), ("pdf", 10, 2), ("ocr", 100, 3), ("docling", 200, 4)], "parser string, cost int, k int")
    d = table(spark, sf_dir, "documents").select("doc_id").join(F.broadcast(links)).where("(doc_id div k) % 4 <> 3")
    lost = F.expr("(doc_id + k) % 11 = 0")
    wish = F.expr("CASE WHEN (doc_id + k) % 11 = 0 THEN NULL WHEN (doc_id + k * 3) % 6 = 0 THEN 'ocr' WHEN (doc_id + k * 3) % 6 = 1 THEN 'docling' END")
    outcome = F.struct(
        "parser", F.expr("(doc_id + k * 7) % 4 <> 0").alias("ok"), F.expr("((doc_id * 13 + k * 29) % 100) / 100.0D").alias("quality"), wish.alias("escalate_to"),
        lost.alias("unrecoverable"), F.lit("seen").alias("reason"), F.concat(F.lit("no "), "parser").alias("error"),
    )
    rows = d.select(F.col("doc_id").cast("string").alias("document_id"), "cost", outcome.cast(parsing.OUTCOME).alias("outcome"))
    return parsing.resolve(rows).withColumn("tried", F.array_join("tried", ","))


def _parsed(spark, sf_dir) -> DataFrame:
    """Documents as parsed files: their lines, and an empty table after those of
    every fourth; up to three pages, and images in every third."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.lit("text").alias("kind")))
    empty = F.array(F.struct(F.lit(" \t").alias("text"), F.lit("table").alias("kind")))
    blocks = F.when(F.col("doc_id") % 4 == 3, F.concat(lines, empty)).otherwise(lines)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", blocks.alias("blocks"))
    return d.withColumns({"page_count": F.expr("cast(doc_id % 4 as int)"), "image_count": F.expr("cast(doc_id % 3 as int)"), "status": F.lit("ok"), "parser": F.lit("text"), "error": F.lit(None).cast("string")})


_SHOWN = """SELECT doc_id, lang, source, CASE WHEN doc_id % 4 = 3 THEN text || chr(10) || ' ' || chr(9) ELSE text END AS text FROM documents"""
_FIGURES = f"""{quality_sql(f'({_SHOWN})')},
f AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE length(text) / (doc_id % 4)::DOUBLE END AS chars, bad, plausible, script, CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END AS empty, doc_id % 3 AS images FROM q3),
g AS (SELECT *, least(greatest(chars / 2666.5, 0), 1) * 0.39 + least(greatest((bad - 0.0648) / -0.0648, 0), 1) * 0.28 + least(greatest(plausible / 0.806, 0), 1) * 0.33 AS s,
  CASE WHEN chars < 25 THEN 'chars_per_page' WHEN script < 0.95 THEN 'script_validity' WHEN bad > 0.02 THEN 'bad_char_ratio' WHEN plausible < 0.57 THEN 'text_plausibility'
    WHEN empty >= 1 THEN 'empty_table_blocks' END AS trigger FROM f)"""


@query(f"WITH {_FIGURES} SELECT doc_id, round(chars, 6) AS chars, round(bad, 6) AS bad_chars, round(plausible, 6) AS plausibility, round(script, 6) AS script_validity, empty AS empty_tables FROM f")
def quality_components(spark, sf_dir):
    rows = parsing.measure(_parsed(spark, sf_dir))
    return rows.select("doc_id", *[F.round(c, 6).alias(c) for c in ("chars", "bad_chars", "plausibility", "script_validity")], "empty_tables")


@query(
    f"""WITH {_FIGURES} SELECT doc_id, round(s, 6) AS score, trigger, CASE trigger WHEN 'script_validity' THEN NULL WHEN 'empty_table_blocks' THEN 'docling' ELSE CASE WHEN trigger IS NOT NULL THEN 'ocr' END END AS escalate_to,
 coalesce(trigger = 'script_validity', false) AS unrecoverable, chars < 150 AND images > 0 AS image_heavy FROM g"""
)
def quality_gate(spark, sf_dir):
    rows = parsing.judged(_parsed(spark, sf_dir))
    return rows.select(
        "doc_id", F.round("outcome.quality", 6).alias("score"), F.col("outcome.reason").alias("trigger"), "outcome.escalate_to", "outcome.unrecoverable", "image_heavy"
    )


@query(
    f"""WITH {_FIGURES} SELECT lang, coalesce(trigger, 'none') AS trigger, count(*) AS n, {', '.join(f'round({f}({c}), 6) AS {f}_{a}' for a, c in (('chars', 'chars'), ('bad_chars', 'bad'), ('plausibility', 'plausible'), ('script_validity', 'script')) for f in ('min', 'max'))} FROM g GROUP BY ALL"""
)
def gate_calibration(spark, sf_dir):
    rows = evaluation.calibration(parsing.judged(_parsed(spark, sf_dir)), "lang")
    return rows.select("lang", "trigger", "n", *[F.round(c, 6).alias(c) for c in rows.columns[3:]])


# --- chunks -------------------------------------------------------------------

_END = r"([.!?…])(\s+)"
_PACKED = rf"""d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text FROM documents WHERE text <> ''),
g AS (SELECT document_id, string_split(regexp_replace(text, '(\n)(\s*\n)', chr(2) || '\1\2' || chr(2), 'g'), chr(2)) AS parts FROM d),
p0 AS (SELECT document_id, unnest(range(0, len(parts))) AS k, unnest(parts) AS part FROM g),
p AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY document_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at0 FROM p0),
s0 AS (SELECT document_id, k, at0, CASE WHEN length(part) <= 1200 THEN [part] ELSE string_split(regexp_replace(part, '{_END}', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS bits FROM p WHERE k % 2 = 0),
s1 AS (SELECT document_id, k, at0, unnest(range(0, len(bits))) AS j, unnest(bits) AS bit FROM s0),
s2 AS (SELECT *, at0 + coalesce(sum(length(bit)) OVER (PARTITION BY document_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at1 FROM s1),
s3 AS (SELECT document_id, k, j, at1 + CASE WHEN j > 0 THEN length(bit) - length(regexp_replace(bit, '^\s+', '')) ELSE 0 END AS a, at1 + length(bit) AS b FROM s2 WHERE trim(bit, {_STRIP}) <> ''),
s4 AS (SELECT document_id, k, j, a AS a0, b, unnest(CASE WHEN b - a <= 1200 THEN [a] ELSE range(a, b, 1200) END) AS a FROM s3),
u AS (SELECT document_id, a, CASE WHEN b - a0 > 1200 THEN least(b, a + 1200) ELSE b END AS b, row_number() OVER (PARTITION BY document_id ORDER BY a) AS i FROM s4),
w AS (SELECT document_id, i, a, b, 0 AS c, 1200 - (b - a) AS room FROM u WHERE i = 1
  UNION ALL SELECT u.document_id, u.i, u.a, u.b, CASE WHEN u.b - u.a <= w.room THEN w.c ELSE w.c + 1 END, CASE WHEN u.b - u.a <= w.room THEN w.room ELSE 1200 END - (u.b - u.a)
  FROM w JOIN u ON u.document_id = w.document_id AND u.i = w.i + 1),
x AS (SELECT document_id, c, min(a) AS a, max(b) AS b FROM w GROUP BY ALL),
y AS (SELECT x.*, text, greatest(0, a - 180) AS lo FROM x JOIN d USING (document_id)),
z AS (SELECT *, CASE WHEN c = 0 THEN a ELSE lo + length(regexp_extract(text[lo + 1 : a], '(?s)^(.*?[.!?…]\s+)', 1)) END AS st FROM y)"""


@query(f"WITH RECURSIVE {_PACKED} SELECT document_id || ':' || lpad(c::VARCHAR, 5, '0') AS chunk_id, document_id, text[st + 1 : b] AS text, st::INT AS start, b::INT AS \"end\" FROM z")
def chunk_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return splitting.split_texts(docs)


# --- sections -----------------------------------------------------------------

_STYLED = f"""s AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id, {_SENTENCES} AS parts FROM documents),
b AS (SELECT document_id, doc_id, unnest(range(0, len(parts))) AS ix, trim(unnest(parts), {_STRIP}) AS text FROM s),
z AS (SELECT *, ix % 7 = 3 AS bold, CASE WHEN ix % 11 = 5 THEN 14.0 WHEN (ix + doc_id) % 2 = 0 THEN 10.0 ELSE 11.0 END AS size FROM b),
m AS (SELECT document_id, size AS usual FROM (SELECT document_id, size, count(*) AS n FROM z GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, size) = 1),
y AS (SELECT z.*, length(text) <= 80 AND (bold OR size > 1.2 * usual) AS styled FROM z JOIN m USING (document_id))"""


@query(f"WITH {_STYLED} SELECT document_id, ix::INT AS block_ix, 1 AS level, text AS title, text AS path FROM y WHERE styled AND NOT regexp_matches(text, '^[0-9]')")
def styled_sections(spark, sf_dir):
    """Sections by type alone: bold blocks, and those larger than most."""
    rows = sentence_chunks(spark, sf_dir).select("document_id", F.col("start").alias("block_ix"), headings.strip(F.col("text")).alias("text"), F.lit(1).alias("page_no"), F.lit("text").alias("kind"))
    size = F.when(F.col("block_ix") % 11 == 5, 14.0).when((F.col("block_ix") + F.col("document_id").cast("int")) % 2 == 0, 10.0).otherwise(11.0)
    found = sections.by_patterns(rows.withColumns({"bold": F.col("block_ix") % 7 == 3, "font_size": size}))
    return found.where("level = 1 and not title rlike '^[0-9]'")


_ENTRIES = f"""s AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, {_SENTENCES} AS parts FROM documents),
b AS (SELECT document_id, unnest(range(0, len(parts))) AS ix, replace(lower(trim(unnest(parts), {_STRIP})), 'ß', 'ss') AS text FROM s),
w AS (SELECT document_id, ord, want, replace(lower(trim(parts[want + 1], {_STRIP})[1:12]), 'ß', 'ss') AS title FROM s, (VALUES (0, 2), (1, 5), (2, 9)) v(ord, want) WHERE len(parts) > 9),
e0 AS (SELECT w.document_id, min(ix) AS spot FROM w JOIN b USING (document_id) WHERE ord = 0 AND ix // 4 >= want // 4 AND starts_with(text, title) GROUP BY 1),
e1 AS (SELECT w.document_id, min(ix) AS spot FROM w JOIN b USING (document_id) JOIN e0 USING (document_id) WHERE ord = 1 AND ix // 4 >= want // 4 AND ix > e0.spot AND starts_with(text, title) GROUP BY 1),
e2 AS (SELECT w.document_id, min(ix) AS spot FROM w JOIN b USING (document_id) JOIN e1 USING (document_id) WHERE ord = 2 AND ix // 4 >= want // 4 AND ix > e1.spot AND starts_with(text, title) GROUP BY 1)"""


@query(
    f"WITH {_ENTRIES} SELECT document_id, spot::INT AS block_ix, 1 AS level, '0' AS path FROM e0 UNION ALL SELECT document_id, spot::INT, 2, '0 > 1' FROM e1 UNION ALL SELECT document_id, spot::INT, 2, '0 > 2' FROM e2"
)
def outline_sections(spark, sf_dir):
    """Where the entries of an outline begin: beginnings of some sentences, in lower case."""
    rows = sentence_chunks(spark, sf_dir).select("document_id", F.col("start").alias("block_ix"), headings.strip(F.col("text")).alias("text"), F.expr("cast(start div 4 + 1 as int)").alias("page_no"))
    chosen = rows.where("block_ix in (2, 5, 9)").join(rows.where("block_ix = 9").select("document_id"), "document_id", "left_semi")
    order = F.expr("case block_ix when 2 then 0 when 5 then 1 else 2 end")
    outline = chosen.select(
        "document_id", order.alias("ord"), F.when(order == 0, 1).otherwise(2).alias("level"), F.lower(F.substring("text", 1, 12)).alias("title"),
        F.element_at(F.array(F.lit("0"), F.lit("0 > 1"), F.lit("0 > 2")), order + 1).alias("path"), "page_no",
    )
    return sections.by_outline(rows, outline).select("document_id", "block_ix", "level", "path")


@query(
    """SELECT doc_id, nullif(trim(regexp_replace(CASE WHEN doc_id % 9 = 0 THEN chr(10) || '  ' ELSE text END, '\\s+', ' ', 'g')), '') AS title FROM documents"""
)
def flatten_titles(spark, sf_dir):
    t = F.when(F.col("doc_id") % 9 == 0, "\n  ").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", headings.flatten_title(t).alias("title"))


_ARTICLES = """d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, ['1', '2', (doc_id % 5)::VARCHAR] AS present FROM documents),
c AS (SELECT doc_id, document_id, k, CASE WHEN k = 2 THEN NULL ELSE (doc_id % (k + 2))::VARCHAR END AS up, ((doc_id + k) % 3)::VARCHAR AS body FROM d, range(3) r(k)),
p AS (SELECT document_id, list_distinct(list(up) FILTER (up IS NOT NULL)) AS ups, count(*) AS chunks, count(*) FILTER (up IS NOT NULL AND up <> body) AS wrong FROM c GROUP BY 1),
x AS (SELECT document_id, len(list_distinct(present)) AS articles, len(list_intersect(list_distinct(present), coalesce(ups, []))) AS found, chunks, wrong FROM d JOIN p USING (document_id))"""


@query(f"WITH {_ARTICLES} SELECT document_id, sum(articles)::BIGINT AS articles, sum(found)::BIGINT AS found, sum(chunks)::BIGINT AS chunks, sum(wrong)::BIGINT AS misattributed FROM x GROUP BY ROLLUP (document_id)")
def article_quality(spark, sf_dir):
    """Articles that sections name, and chunks below another article's heading."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("document_id"), "text")
    texts = d.select("document_id", F.concat(F.lit("MADDE 1 x\nmadde 2 "), "text", F.lit(" Madde "), F.col("doc_id") % 5).alias("text"))
    chunks = d.select("document_id", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    up = F.when(F.col("k") < 2, F.concat(F.lit("BÖLÜM > MADDE "), F.expr("doc_id % (k + 2)")))
    chunks = chunks.select("document_id", F.concat(F.lit("MADDE "), F.expr("(doc_id + k) % 3"), F.lit(" body")).alias("text"), up.alias("section_path"))
    return sections.article_recall(texts, chunks)


# --- state --------------------------------------------------------------------

_STATE = """st AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, source || '/' || doc_id AS path, sha256(text) AS content_hash,
 ['pending', 'parsed', 'embedded', 'profiled', 'failed'][doc_id % 5 + 1] AS status, CASE WHEN doc_id % 5 = 4 THEN 'bad' END AS error, (doc_id % 7)::INT AS chunk_count FROM documents)"""


def _state(spark, sf_dir) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in index.STATUSES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.concat("source", F.lit("/"), "doc_id").alias("path"), ids.content_hash(F.col("text")).alias("content_hash"),
        status.alias("status"), F.when(F.col("doc_id") % 5 == 4, "bad").alias("error"), (F.col("doc_id") % 7).cast("int").alias("chunk_count"),
    )


@query(f"WITH {_STATE} SELECT status, count(*) AS n FROM st WHERE path = 'src1' OR starts_with(path, 'src1/') GROUP BY status")
def status_counts(spark, sf_dir):
    return index.status_counts(_state(spark, sf_dir), "src1/")


@query(f"WITH {_STATE} SELECT document_id, status FROM st WHERE status IN ('parsed', 'embedded') AND starts_with(path, 'src2/')")
def resume_stranded(spark, sf_dir):
    return index.stranded(_state(spark, sf_dir), "src2").select("document_id", "status")


@query(
    f"""WITH {_STATE} SELECT document_id, path, content_hash, CASE WHEN document_id::INT % 3 = 0 THEN 'profiled' WHEN document_id::INT % 3 = 1 THEN 'failed' ELSE status END AS status,
 CASE WHEN document_id::INT % 3 = 0 THEN NULL WHEN document_id::INT % 3 = 1 THEN 'late' ELSE error END AS error, CASE WHEN document_id::INT % 3 = 0 THEN 9 ELSE chunk_count END AS chunk_count FROM st"""
)
def state_transition(spark, sf_dir):
    state = _state(spark, sf_dir)
    k = F.col("document_id").cast("int") % 3
    updates = state.where(k < 2).select("document_id", F.when(k == 0, "profiled").otherwise("failed").alias("status"), F.when(k == 1, "late").alias("error"), F.when(k == 0, 9).alias("chunk_count"))
    return index.transition(state, updates)


@query(
    f"""WITH {_STATE}, f AS (SELECT document_id, path, CASE WHEN document_id::INT % 2 = 0 THEN content_hash ELSE 'new' END AS content_hash, status AS was, error AS err, chunk_count AS cc FROM st)
SELECT document_id, path, content_hash, CASE WHEN again THEN 'pending' ELSE was END AS status, CASE WHEN again THEN NULL ELSE err END AS error, CASE WHEN again THEN 0 ELSE cc END AS chunk_count
FROM (SELECT *, content_hash = 'new' OR was = 'pending' AS again FROM f)"""
)
def begin_run(spark, sf_dir):
    """State after a run has entered new, changed and unfinished files."""
    state = _state(spark, sf_dir)
    found = state.select("document_id", "path", F.when(F.col("document_id").cast("int") % 2 == 0, F.col("content_hash")).otherwise("new").alias("content_hash"))
    return index.begin(state, index.to_do(found, state))


@query(f"WITH {_STATE} SELECT document_id, status FROM st ORDER BY document_id LIMIT 25")
def state_rows(spark, sf_dir):
    return index.listed(_state(spark, sf_dir), 25).select("document_id", "status")


@query(f"WITH {_STATE} SELECT source AS job_id, count(*) AS documents, sum(chunk_count)::BIGINT AS chunks FROM st JOIN documents ON CAST(doc_id AS VARCHAR) = document_id WHERE status = 'profiled' GROUP BY source")
def job_counts(spark, sf_dir):
    jobs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("job_id"))
    return index.job_counts(_state(spark, sf_dir), jobs)


_NAMES = ("a.txt", "state.DB", "x.sqlite3", ".DS_Store", "Thumbs.db", "notes.db.txt", "db-wal")


@query(
    f"""SELECT doc_id, name FROM (SELECT doc_id, {list(_NAMES)!r}[doc_id % 7 + 1] AS name FROM documents)
WHERE name NOT IN ('.DS_Store', 'Thumbs.db') AND NOT regexp_matches(lower(name), '\\.(db|sqlite|sqlite3|db-wal|db-shm|sqlite-wal|sqlite-shm)$')"""
)
def kept_files(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return rows.where(~index.skipped(F.col("name")))


@query(f"WITH {_STATE} SELECT document_id FROM st WHERE path = 'src1' OR starts_with(path, 'src1/')")
def under_folder(spark, sf_dir):
    return _state(spark, sf_dir).where(under("src1")).select("document_id")


_SETTINGS = "'p' || n_nationkey || ':m:' || n_regionkey || ':norm=' || (n_nationkey % 2 = 0) || ':sparse=False'"


@query(f"SELECT n_nationkey, replace(replace({_SETTINGS}, 'true', 'True'), 'false', 'False') AS fingerprint FROM nation")
def index_fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()  # one for each nation: 25
    made = [(r.n_nationkey, index.fingerprint(f"p{r.n_nationkey}", "m", r.n_regionkey, r.n_nationkey % 2 == 0, False)) for r in rows]
    return spark.createDataFrame(made, table(spark, sf_dir, "nation").select("n_nationkey", F.lit("").alias("fingerprint")).schema)


@query(
    """WITH e AS (SELECT event_type, count(*) AS n, epoch(max(ts)) - epoch(min(ts)) AS s, sum(abs(value)) AS v FROM events GROUP BY event_type),
r AS (SELECT *, CASE WHEN s > 0 THEN n / s ELSE 0 END * 60 AS rate FROM e)
SELECT event_type, round(rate, 6) AS per_minute, round(CASE WHEN rate > 0 THEN 5000 / rate ELSE 0 END, 6) AS minutes, round(CASE WHEN s > 0 THEN v / s ELSE 0 END * 100, 6) AS embed_percent, round(v / n * 1000, 6) AS ms_per_call FROM r"""
)
def index_throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    rows = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("s"), F.sum(F.abs("value")).alias("v"))
    made = evaluation.throughput(F.col("n"), F.col("s"), F.col("v"), F.col("n"))
    return rows.select("event_type", made.alias("m")).select("event_type", *[F.round(f"m.{c}", 6).alias(c) for c in ("per_minute", "minutes", "embed_percent", "ms_per_call")])
