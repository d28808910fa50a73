import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute
from test_mixing import near
from test_simhash import groups, slow_print

from leafmill.llm import mixing, quality
from leafmill.scratch import Scratch


@pytest.fixture(scope="module")
def kept(spark, sf):
    scratch = Scratch(spark, "t")
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in cp.STAGES:
        out.append(scratch.keep(stage(spark, out[-1], sf), name))
    return out


def test_each_stage_on_its_own_input(spark, sf, kept):
    for df in kept[1:-1]:
        assert tuple(df.columns) == cp.COLUMNS
    rows = [sorted(map(tuple, df.collect()), key=repr) for df in kept]
    good = {r.doc_id for r in quality.classify(kept[0], spark.read.parquet(f"{sf}/labels.parquet")).where("keep").collect()}
    assert rows[1] == [r for r in rows[0] if r[0] in good]
    heads = groups([(r[0], slow_print(r[1])) for r in rows[1]])
    assert rows[2] == [r for r in rows[1] if heads[r[0]] == r[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute([(r[0], r[1]) for r in rows[2]], items) if r[5]}
    assert bad and rows[3] == [r for r in rows[2] if r[0] not in bad]
    drawn = mixing.mix(kept[3]).collect()
    near(drawn)
    times = {r.doc_id: len(r.shards) for r in drawn}
    assert rows[4] == sorted((r for r in rows[3] for _ in range(times[r[0]])), key=repr)
    last = kept[5].agg(F.count("*").alias("n"), F.max(F.expr("start + n_tokens")).alias("e"), F.sum("n_tokens").alias("s")).first()
    assert last.n == len(rows[4]) and last.e == last.s


def test_run(spark, sf, kept):
    got = cp.run(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(
        map(tuple, kept[5].select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    )


def test_stages_on_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (None, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (None, "", None, "s", 0), (3, "w " * 40_000, "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.limit(0)):
        for _, stage in cp.STAGES:
            assert stage(spark, docs, sf).count() <= 2 * len(rows)
    assert cp.drop_near_duplicates(spark, df, sf).where("doc_id = 2").count() == 1


def test_rows_are_judged_one_by_one(spark, sf):
    """Rows of one id, or without id, share no verdict unless they are equal."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    texts = [item, "plain words that nobody asks for " * 3, "other words of another text and nothing else here", "x y z"]
    rows = [(i, t, "en", "s", 1) for i in (None, 5) for t in texts for _ in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in cp.drop_contaminated(spark, df, sf).collect()]
    assert sorted(left, key=repr) == sorted(((i, t) for i, t, *_ in rows if t != item), key=repr)
    once = [(r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, df, sf).collect()]
    assert sorted(once) == sorted((5, t) for t in texts)
    assert sorted(r.text for r in cp.drop_near_duplicates(spark, df.where("doc_id is null"), sf).collect()) == sorted(texts)
