import pytest
from compare import rows_of, sql_rows

from leafmill.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_and_its_sql(spark, sf, name):
    got = rows_of(QUERIES[name](spark, sf))
    assert got[1]
    if name in SQL:
        want = sql_rows(SQL[name], sf)
        assert got[0] == want[0]
        assert got[1] == want[1]


def test_upsert_of_letters_whose_capitals_are_more_than_one(spark, tmp_path):
    texts = ["grüße aus der straße", "ﬁn ŉ ǰ և", "ᾳ ᾲ ᾼ ΐ ς σ", "iı é ÿ µ \U00010428", "", None]
    rows = [(i, t, lang, f"src{i % 2}") for i, (t, lang) in enumerate((t, lang) for t in texts for lang in ("fr", "de", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "rows"))
    next((tmp_path / "rows").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert rows_of(QUERIES["upsert_chunks"](spark, tmp_path)) == sql_rows(SQL["upsert_chunks"], tmp_path)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
