import random
import re
import unicodedata
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from leafmill.functions import headings, ids, lexical, profile, quality, splitting, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


def test_ids(spark):
    for s in ["/a/b.txt", "é/ğ.md"]:
        assert one(spark, ids.uuid5(F.col("p")), p=s) == str(uuid.uuid5(uuid.NAMESPACE_URL, s))
        assert one(spark, lexical.term_id(F.col("p")), p=s) == zlib.crc32(s.encode())
    assert one(spark, ids.chunk_id(F.col("d"), F.lit(7)), d="x") == "x:00007"


def test_folding_and_terms(spark):
    assert one(spark, lexical.terms(F.col("t")), t="İstanbul ve ISI için ISI") == ["istanbul", "ısı", "ısı"]
    assert one(spark, lexical.query_terms(F.col("t")), t="ve ile mi") == []
    assert one(spark, lexical.occurrences(F.col("t"), F.lit("aa")), t="aaaaa") == 2


def test_upper_of_every_character_is_that_of_the_sql(spark):
    import duckdb

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chars[i : i + 4096]) for i in range(0, len(chars), 4096)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(lexical.upper(F.col("t"))).collect()
    assert [r[0] for r in got] == [duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts]
    assert one(spark, lexical.upper(F.col("t")), t="Straße, ﬁn ŉ ǰ ᾳ") == "STRAẞE, ﬁN ŉ ǰ ᾼ"


def slow_quality(t):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZÇĞİÖŞÜ", "abcdefghijklmnopqrstuvwxyzçğiöşü")
    toks = re.findall("[a-zçğıöşü]+", t.translate(low))
    long = [x for x in toks if len(x) > 1]
    letters = [c for c in t if c.isalpha()]
    good = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZçğıöşüÇĞİÖŞÜ")
    share = lambda a, b: a / b if b else 0.0
    words = set(quality.TURKISH_WORDS + quality.ENGLISH_WORDS)
    s = share(sum(c in good for c in letters), len(letters))
    v = share(sum(any(c in "aeıioöuü" for c in x) for x in long), len(long))
    w = share(sum(x in words for x in toks), len(toks))
    r = share(sum(bool(re.search(r"(.)\1\1", x)) for x in long), len(long))
    bad = sum(c == "�" or unicodedata.category(c) == "Cc" and c not in "\n\r\t\f\v" for c in t)
    return [len(toks), s, v, w, r, (s + v + w) / 3 * (1 - r) if toks else 0.0, share(bad, len(t))]


def test_text_quality_against_plain_python(spark):
    rng = random.Random(1)
    bits = ["ve", "THE", "İçin", "xzt", "aaa", "Ödemeler", "Ã–deme", "кот", "7", " ", " ", "\n", "\x01", "�", ".", "ıIiİ", "b", "rrr", "𝒳", "漢字"]
    texts = ["", " ", "123", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(200))]
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(
        "t", quality.n_tokens(t), quality.script_validity(t), quality.vowel_rate(t), quality.function_word_rate(t), quality.repetition(t),
        quality.text_plausibility(t), quality.bad_char_ratio(t),
    )
    for r in df.collect():
        assert list(r)[1:] == pytest.approx(slow_quality(r[0])), r[0]
    names = ["t", "n_tokens", "script_validity", "vowel_rate", "function_words", "repetition", "plausibility", "bad_chars"]
    for r in quality.measure(df.select("t"), "t").select(*names).collect():
        assert list(r)[1:] == pytest.approx(slow_quality(r[0])), r[0]


@pytest.mark.parametrize(
    ("chars", "bad", "plausible", "script", "empty", "want"),
    [
        (10.0, 0.0, 0.7, 1.0, 0, ("ocr", "chars_per_page", False)),
        (900.0, 0.5, 0.1, 0.8, 0, (None, "script_validity", True)),
        (900.0, 0.03, 0.7, 1.0, 0, ("ocr", "bad_char_ratio", False)),
        (900.0, 0.0, 0.5, 1.0, 0, ("ocr", "text_plausibility", False)),
        (900.0, 0.0, 0.7, 1.0, 1, ("docling", "empty_table_blocks", False)),
        (900.0, 0.0, 0.7, 1.0, 0, (None, None, False)),
    ],
)
def test_gate(spark, chars, bad, plausible, script, empty, want):
    g = one(spark, quality.gate(F.col("c"), F.col("b"), F.col("p"), F.col("e"), F.col("s"), F.lit(1)), c=chars, b=bad, p=plausible, e=empty, s=script)
    assert (g.escalate_to, g.trigger, g.unrecoverable) == want and g.image_heavy == (chars < 150)
    with pytest.raises(ValueError):
        quality.QualityConfig(plausibility=(0.0, 0.8, 0.9))


@pytest.mark.parametrize(
    ("line", "level"),
    [
        ("BİRİNCİ BÖLÜM Genel", 1), ("On Birinci Bölüm", 1), ("MADDE 5 - Fesih", 2), ("madde 12", 2), ("GEÇİCİ MADDE 1 - x", 2), ("EK MADDE 2", 2),
        ("EK-1 Program", 1), ("EK A", 1), ("1. Genel", 1), ("1.1 Amaç", 2), ("3.2.1 Alt", 3), ("2024 yılında", None), ("01.01.2024 tarihinden", None),
        ("1.000.000 TL ödenir", None), ("1. " + "uzun " * 12, None), ("", None), ("ekmek aldı", None), ("1.", None), ("plain words", None),
    ],
)
def test_heading_levels(spark, line, level):
    assert one(spark, headings.heading_level(F.col("t")), t=line) == level


def test_heading_titles_and_paths(spark):
    assert one(spark, headings.heading_title(F.col("t")), t="MADDE 5 - Fesih") == "MADDE 5 - Fesih"
    assert one(spark, headings.heading_title(F.col("t")), t="MADDE 5 - " + "gövde " * 20) == "MADDE 5"
    assert one(spark, headings.flatten_title(F.col("t")), t=" a \n b ") == "a b"
    h = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(t).alias("title")) for n, t in [(1, "A"), (3, "B"), (2, "C"), (2, "D"), (1, "E")]])
    assert one(spark, headings.section_paths(h), x=1) == ["A", "A > B", "A > C", "A > D", "E"]


def test_splitting():
    assert splitting.split_spans("") == [] and splitting.split_spans("  \n ") == []
    text = "x" * 5000
    assert "".join(text[a:b] for a, b in splitting.split_spans(text, 400, 0)) == text
    rng = random.Random(2)
    for _ in range(50):
        words = [rng.choice(["alpha", "beta.", "gamma!", "\n\n", "d" * 90, "e…"]) for _ in range(rng.randint(1, 120))]
        text = " ".join(words)
        plain = splitting.split_spans(text, 80, 0)
        kept = re.sub(r"\s", "", "".join(text[a:b] for a, b in plain))
        assert kept == re.sub(r"\s", "", text)
        wide = splitting.split_spans(text, 80, 0.5)
        assert [b for _, b in wide] == [b for _, b in plain] and all(a <= c for (a, _), (c, _) in zip(wide, plain, strict=True))
    text = "One two three. Four five six. Seven eight nine. Ten eleven."
    assert [text[a:b] for a, b in splitting.split_spans(text, 32, 0.6)] == ["One two three. Four five six.", "Four five six. Seven eight nine. Ten eleven."]
    assert splitting.table_to_markdown("a|b\n\nc") == "| a | b |\n| --- | --- |\n| c |  |"


def test_chunk_documents(spark):
    rows = [
        ("d", 0, "preamble", 1, "text", None, None, None), ("d", 1, "BÖLÜM", 1, "heading", 1, "BÖLÜM", "BÖLÜM"),
        ("d", 2, "MADDE 1", 2, "heading", 2, "MADDE 1", "BÖLÜM > MADDE 1"), ("d", 3, "body of it", 2, "text", None, None, None),
        ("d", 4, "a|b\n1|2", 3, "table", None, None, None), ("d", 5, "EK-1", 4, "heading", 1, "EK-1", "EK-1"),
    ]
    df = spark.createDataFrame(rows, "document_id string, block_ix int, text string, page_no int, kind string, level int, title string, path string")
    got = splitting.chunk_documents(df).orderBy("chunk_id").collect()
    full = "\n\n".join(r[2] for r in rows)
    assert [r.chunk_id for r in got] == [f"d:{i:05d}" for i in range(4)]
    assert [r.text for r in got] == ["preamble", "MADDE 1\n\nbody of it", "| a | b |\n| --- | --- |\n| 1 | 2 |", "EK-1"]
    assert [r.page_no for r in got] == [1, 2, 3, 4] and got[1].section_path == "BÖLÜM > MADDE 1"
    assert full[got[1].start : got[1].end] == got[1].text and full[got[2].start : got[2].end] == "a|b\n1|2"


def test_profile(spark):
    assert one(spark, profile.path_terms(F.col("p")), p="/data/SatışRaporu_v2.pdf") == "data Satış Raporu"
    assert one(spark, profile.title(F.col("m"), F.lit("H"), F.lit("L")), m="Microsoft Word - x") == "H"
    got = one(spark, profile.entities_by_place(F.col("t")), t="Ali Veli 01.02.2024 tarihinde 1.250,00 TL ödedi, a@b.co ve 12345678901. Ali Veli.")
    assert got[:2] == ["Ali Veli", "01.02.2024"] and "a@b.co" in got and got.count("Ali Veli") == 1
    assert one(spark, profile.body_excerpt(F.col("t"), 10), t="0123456789abc") == "01234\n...\n89abc"


def test_vectors(spark):
    c = vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(7.0), F.lit(0.0)))
    assert one(spark, c, x=1) == 1.0
    zero = vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(3.0)))
    assert one(spark, zero, x=1) == 0.0
    v = one(spark, vectors.hash_embedding(F.col("t"), 40), t="abc")
    assert len(v) == 40 and sum(x * x for x in v) == pytest.approx(1)
    with pytest.raises(Exception, match="different lengths"):
        one(spark, vectors.cosine(F.array(F.lit(1.0)), F.array(F.lit(3.0), F.lit(1.0))), x=1)
