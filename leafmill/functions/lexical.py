"""Search terms: folding, words, stop words, ids."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal in a lexical match.
STOPWORDS = """ve veya ile ya da ki de mi mı mu mü ise için gibi kadar göre bu şu o bir birçok her hangi hiç çok az en
daha ne nasıl niçin neden olan olarak olup ancak fakat ama yani iken üzere dolayı itibaren değil hem ilgili sonra önce
içinde üzerine kendi""".split()


def fold(text: Column) -> Column:
    """Lower case with the dotted and the dotless capital I kept apart."""
    return F.lower(F.translate(text, "İI", "iı"))


def _capital(c: str) -> str:
    """The capital of a character where that is one character, else itself."""
    for u in (c.upper(), c.title()):
        if len(u) == 1:
            return u
    return "ẞ" if c == "ß" else c


@cache
def _capitals() -> tuple[str, str]:
    """All characters that have a capital, and these."""
    pairs = [(c, u) for c in map(chr, range(0x110000)) if (u := _capital(c)) != c]
    return "".join(c for c, _ in pairs), "".join(u for _, u in pairs)


def upper(text: Column) -> Column:
    """Upper case character by character, as DuckDB has it: ß gives ẞ, not SS.
    The locale does not matter and no text gets longer."""
    return F.translate(text, *_capitals())


def terms(text: Column) -> Column:
    """All terms of a text, repeats included, stop words dropped."""
    words = F.regexp_extract_all(fold(text), F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def query_terms(text: Column) -> Column:
    """Distinct terms, in order of first appearance."""
    return F.array_distinct(terms(text))


def term_id(term: Column) -> Column:
    """A stable 32-bit id."""
    return F.crc32(F.encode(term, "UTF-8"))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty string."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")
