"""Cheap document profiles: path words, titles, entities, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.headings import strip

# Patterns of version suffixes, junk titles and entities.
VERSION_SUFFIX = r"(?i)[_-](v\d+|final|son|rev\d*|draft|taslak)$"
JUNK_TITLE = r"(?iu)^(microsoft word|untitled|document\d*|belge\d*|adsız)"
CAMEL = r"(?<=[a-zğüşıöç])(?=[A-ZĞÜŞİÖÇ])"
ENTITIES = (
    r"\d{1,3}(?:\.\d{3})+(?:,\d{2})?\s?(?:TL|₺|USD|\$|EUR|€|TRY)",
    r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b",
    r"\b\d{4}[/-][A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\b",
    r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    r"\b\d{11}\b",
    r"\b\d{10}\b",
    r"[A-ZĞÜŞİÖÇ][\wğüşıöç]+(?:\s+[A-ZĞÜŞİÖÇ][\wğüşıöç]+)+",
)


def path_terms(path: Column) -> Column:
    """Words of a path's parts, without suffixes and version marks."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    stems = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?<=.)\.[^.]*$", ""), VERSION_SUFFIX, ""))
    words = F.flatten(F.transform(stems, lambda s: F.split(F.regexp_replace(s, CAMEL, " "), r"[_\-\s]+")))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def title(meta: Column, first_heading: Column, largest: Column) -> Column:
    """The metadata's title unless it is junk, else the outline's, else the
    block in the largest type."""
    clean = strip(F.coalesce(meta, F.lit("")))
    return F.coalesce(F.when((clean != "") & ~clean.rlike(JUNK_TITLE), clean), first_heading, largest)


def intro(blocks: Column, limit: int = 500, least: int = 60) -> Column:
    """The first block of some length, cut."""
    return F.coalesce(F.substring(F.get(F.filter(F.transform(blocks, strip), lambda b: F.length(b) >= least), F.lit(0)), 1, limit), F.lit(""))


def entities(text: Column) -> Column:
    """Distinct values of all patterns, in the patterns' order."""
    found = [F.regexp_extract_all(text, F.lit(f"(?U){p}"), F.lit(0)) for p in ENTITIES]
    return F.array_distinct(F.filter(F.transform(F.concat(*found), strip), lambda x: x != ""))


def entities_by_place(text: Column) -> Column:
    """The same values, by where the pattern that first took them found them."""
    return F.transform(
        F.array_sort(F.transform(entities(text), lambda v: F.struct(F.instr(text, v).alias("at"), v.alias("value")))), lambda p: p["value"]
    )


def outline_text(outline: Column, nodes: int = 20, children: int = 5) -> Column:
    """Titles of the first top entries of an outline (ord, level, title, path)
    in preorder, each with its first children, joined by dots."""
    start = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("top"), F.lit(0).alias("child"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        above = F.array_append(F.filter(acc["open"], lambda level: level < o["level"]), o["level"])
        depth = F.size(above)
        top = acc["top"] + (depth == 1).cast("int")
        child = F.when(depth == 1, 0).otherwise(acc["child"] + (depth == 2).cast("int"))
        kept = (top <= nodes) & ((depth == 1) | ((depth == 2) & (child <= children)))
        out = F.when(kept, F.array_append(acc["out"], F.trim(o["title"]))).otherwise(acc["out"])
        return F.struct(above.alias("open"), top.alias("top"), child.alias("child"), out.alias("out"))

    return F.array_join(F.aggregate(outline, start, step, lambda acc: acc["out"]), " · ")


def largest(blocks: Column) -> Column:
    """The text of the first block in the largest type, of (ix, text,
    font_size); null if no block has a size."""
    sized = F.filter(blocks, lambda b: b["font_size"].isNotNull())
    best = F.array_max(F.transform(sized, lambda b: F.struct(b["font_size"].alias("size"), (-b["ix"]).alias("first"), b["text"].alias("text"))))
    return best["text"]


def body_excerpt(text: Column, limit: int = 8192) -> Column:
    """Whole if short, else its first and last halves."""
    half = limit // 2
    ends = F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.substring(text, -half, half))
    return F.when(F.length(text) <= limit, text).otherwise(ends)


def model_lines(answer: Column) -> Column:
    """struct(summary, topics, kind) of a model's answer: a line of topics, one
    of the kind of text, and all other lines together as the summary."""
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\r\n|[\n\r]"), strip), lambda x: x != "")
    rest = lambda x: strip(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1))
    # The labels that the model is asked for, in any case.
    topics, kind = r"(?iu)^KONULAR:", r"(?iu)^T[İIiı]P:"
    last = lambda p: F.try_element_at(F.transform(F.filter(lines, lambda x: x.rlike(p)), rest), F.lit(-1))
    said = F.transform(F.filter(F.transform(F.split(last(topics), ","), strip), lambda t: t != ""), F.lower)
    body = F.filter(lines, lambda x: ~x.rlike(topics) & ~x.rlike(kind))
    return F.struct(
        F.array_join(body, " ").alias("summary"),
        F.coalesce(said, F.array().cast("array<string>")).alias("topics"),
        F.nullif(F.lower(last(kind)), F.lit("")).alias("kind"),
    )


def model_profile(answer: Column, summary: Column, topics: Column, flags: Column) -> Column:
    """struct(summary, topics, profile_source, profile_text): a cheap profile's
    fields after a model has spoken.  The kind of text leads the topics; what the
    model left out stays."""
    made = model_lines(answer)
    merged = F.array_distinct(F.concat(F.array_compact(F.array(made["kind"])), made["topics"]))
    return F.struct(
        F.when(made["summary"] != "", made["summary"]).otherwise(summary).alias("summary"),
        F.when(F.size(merged) > 0, merged).otherwise(topics).alias("topics"),
        F.array_union(flags, F.array(F.lit("has_llm_summary"))).alias("profile_source"),
        F.concat(made["summary"], F.lit("\nKonular: "), F.array_join(merged, ", ")).alias("profile_text"),
    )


def profile_text(title_: Column, words: Column, outline: Column, keywords: Column, opening: Column, found: Column, kind: Column, pages: Column) -> Column:
    """The labelled lines that a profile is searched by; empty ones are left out."""
    line = lambda label, value: F.when(F.length(value) > 0, F.concat(F.lit(label), value))
    return F.concat_ws(
        "\n",
        F.when(F.length(title_) > 0, title_),
        line("Yol: ", words),
        line("Bölümler: ", outline),
        line("Anahtar terimler: ", F.array_join(keywords, ", ")),
        line("Giriş: ", opening),
        line("Varlıklar: ", F.array_join(F.slice(found, 1, 15), ", ")),
        F.concat(F.lit("Tip: "), kind, F.lit(" · "), pages.cast("string"), F.lit(" sayfa")),
    )
