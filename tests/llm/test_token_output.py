import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from leafmill.llm import rans, token_output
from leafmill.llm.queries import QUERIES
from leafmill.scratch import Scratch


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 5000, rans.BLOCK, rans.BLOCK + 1, 100_003])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (np.minimum(rng.zipf(1.3, n), 50_256), np.zeros(n), rng.integers(0, 1 << 32, n)):
        ids = ids.astype("<u4")
        data = rans.encode(ids)
        assert (rans.decode(data) == ids).all() and len(rans.decode(data)) == n


def test_blocks_decode_alone_and_damage_shows():
    ids = np.random.default_rng(0).integers(0, 900, 3 * rans.BLOCK + 5).astype("<u4")
    data = rans.encode(ids)
    assert (rans.decode(data, slice(1, 2)) == ids[rans.BLOCK : 2 * rans.BLOCK]).all()
    assert (rans.decode(data, slice(3, 4)) == ids[3 * rans.BLOCK :]).all()
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 4
    with pytest.raises(ValueError):
        rans.decode(bytes(bad))
    skew = np.zeros(200_000, "<u4")
    skew[::100] = 7
    assert len(rans.encode(skew)) < 13 * 8 * rans.LANES + 2500  # lane states, and the 2 KB that the entropy asks for


def check(rows, docs):
    tok = Tokenizer.from_file(token_output.TOKENIZER)
    start = 0
    by = {r.doc_id: r for r in rows}
    for i, text in sorted(docs):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        r = by[i]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_query(spark, sf):
    rows = QUERIES["op9_token_output"](spark, sf).collect()
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    assert len(rows) == len(docs)
    check(rows, docs)


def test_odd_texts_and_small_segments(spark, monkeypatch):
    monkeypatch.setattr(token_output, "REMEMBERED", 20)
    texts = [None, "", " ", "  a", "a  b", "a \n b", "a\n \nb c", " a", "a ", "it's <|endoftext|> x", "  y  z", "tab\t x", "x\x1f y", "I 'm  ", "é 世界 🙂 ok", "one two three " * 2000]
    docs = [(i * 3 - 7, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", df_lit()).repartition(3)
    files = token_output.write(df, Scratch(spark, "t"), size=20)
    assert files.count() > 2
    rows = token_output.read(files).collect()
    check(rows, docs)
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z"), (1, "b")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id) for r in token_output.token_output(twice).collect())
    assert [i for _, i in got] == [1, 1, 1, None] and [s for s, _ in got] == [0, 2, 4, 6]
    assert token_output.token_output(df.limit(0)).count() == 0


PIECES = [" ", " ", " ", "\n", "\t", "\r", "'", "s", "ll", "re", "a", "Z", "é", "×", "÷", "ß", "ł", "1", "23", "!", "-", "<|endoftext|>", "\xa0", "\u2003",
          "\x1f", "\x85", "世", "я", "²", "ª", "»", "\u0301", "🙂", "\u200b", "\x0b", "\x0c", "\u3000", "...", "$", "\x00", "\u01c5"]


@pytest.mark.parametrize("seed", range(3))
def test_texts_of_odd_pieces(seed, monkeypatch):
    monkeypatch.setattr(token_output, "REMEMBERED", [0, 500, 1 << 20][seed])
    rng = np.random.default_rng(seed)
    encode, tok = token_output.Encoder(token_output.TOKENIZER), Tokenizer.from_file(token_output.TOKENIZER)
    for _ in range(4):
        texts = ["".join(rng.choice(PIECES, rng.integers(0, 14))) for _ in range(2000)]
        ids, counts = encode(pa.array([None, *texts, ""])[1:], 0)
        ends = np.cumsum(counts)
        for t, start, stop in zip([*texts, ""], ends - counts, ends, strict=True):
            assert ids[start:stop].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0], t


def test_tokenizers_that_are_not_cut():
    path = token_output.public_tokenizers.path("word_bpe_49k.json")
    encode, tok = token_output.Encoder(path), Tokenizer.from_file(path)
    texts = ["Two words", None, "", "it's 3 o'clock\n\nÉté"]
    ids, counts = encode(pa.array(texts), 7)
    assert ids.tolist() == [x for t in texts for x in [*tok.encode(t or "", add_special_tokens=False).ids, 7]]
    assert counts.sum() == len(ids)


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
