import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import quality as q
from leafmill.llm.joins import join_groups
from leafmill.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, sf).collect()}
    assert len(rows) == 10_000
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    out = [(rows[r.doc_id].keep, r.quality) for r in labels if q.held_out(r.doc_id)]
    right = sum(k == bool(y) for k, y in out)
    assert right / len(out) > 0.97
    assert sum(not k for k, y in out if y) <= 0.005 * len(out)


def test_rates_by_hand(spark):
    """Grouped sums and shrinkage against a plain loop."""
    df = spark.createDataFrame(
        [(i, "good plain text here " * (1 + i % 3) if i % 4 else "### $$$ @@@ ^^^", f"h{i % 3}", "en" if i % 2 else "fr") for i in range(60)],
        "doc_id long, text string, source string, lang string",
    )
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 60, 2)], "doc_id long, quality int")
    rows = q.classify(df, labels).collect()
    assert all(r.keep == bool(r.doc_id % 4) for r in rows)
    model = q.train(q.featured(df, "doc_id", "text", "source", "lang"), labels, "doc_id", "quality")
    base = np.log(model.prior / (1 - model.prior))
    p = {r.doc_id: 1 / (1 + np.exp(-(r.evidence + base))) for r in rows}
    prior = (sum(p.values()) + 1) / (len(p) + 2)

    def strength(groups):  # (parent rate, sum, n): spread = v / mean + v / (1 + strength), v = p (1 - p)
        n = sum(g[2] for g in groups)
        spread = sum(g[2] * (g[1] / g[2] - g[0]) ** 2 for g in groups) / n
        v = prior * (1 - prior)
        between = spread - v / (n / len(groups))
        return min(1e4, max(1.0, v / between - 1)) if between > v / 1e4 else 1e4

    def sums(key):
        out = {}
        for r in rows:
            s, n = out.get(key(r), (0.0, 0))
            out[key(r)] = (s + p[r.doc_id], n + 1)
        return out

    hosts, paths = sums(lambda r: r.host), sums(lambda r: (r.host, r.path))
    a = strength([(prior, *v) for v in hosts.values()])
    host = {h: (s + a * prior) / (n + a) for h, (s, n) in hosts.items()}
    b = strength([(host[h], *v) for (h, _), v in paths.items()])
    for r in rows:  # each by the others of its groups
        own = p[r.doc_id]
        others = (sum(p.values()) - own + 1) / (len(p) + 1)
        s, n = hosts[r.host]
        above = (s - own + a * others) / (n - 1 + a)
        s, n = paths[r.host, r.path]
        want = (s - own + b * above) / (n - 1 + b)
        assert r.host_rate == pytest.approx(above) and r.path_rate == pytest.approx(want)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(r.evidence + np.log(want / (1 - want))))))


def test_a_lone_document_is_judged_by_its_host(spark):
    """Its own evidence must not come back to it through a path of its own."""
    df = spark.createDataFrame(
        [(i, "good plain text here " * 3, "h", "en") for i in range(40)] + [(99, "### $$$ @@@ ^^^", "h", "own")],
        "doc_id long, text string, source string, lang string",
    )
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(99, 0)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in q.classify(df, labels).collect()}
    assert rows[99].path_rate == pytest.approx(rows[99].host_rate)


def test_whole_rows_and_odd_names(spark):
    df = spark.createDataFrame(
        [(1, "a b c", "h", "en", 5, None), (2, None, None, None, None, "x"), (2, None, None, None, None, "x")],
        "`doc.id` long, text string, source string, lang string, row int, path string",
    )
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = q.classify(df, labels.withColumnRenamed("doc_id", "doc.id"), "doc.id", whole=True).select("row.*")
    assert got.schema.names == df.schema.names
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_groups_hot_and_cold(spark):
    """Null-safe, each row once, whichever way a group is joined."""
    rows = spark.createDataFrame([(None if i % 7 == 0 else f"k{int(i ** 0.5)}", i) for i in range(200)], "k string, i int")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("s"))
    want = sorted((r.i, r.n, r.s) for r in rows.alias("a").join(groups.alias("b"), F.expr("a.k <=> b.k")).collect())
    for share in (1, 12, 10_000):
        got = join_groups(rows, groups, ["k"], "n", 200, share)
        assert sorted((r.i, r.n, r.s) for r in got.collect()) == want


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, 1), (2, "", "a", None, 1), (None, "x y", None, "en", 1), (3, "p q", "b", "de", 2), (3, "p q", "b", "de", 2), (4, "z " * 50_000, "a", "fr", 3)],
        "doc_id long, text string, source string, lang string, score int",
    )
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    assert q.classify(df, labels).count() == 6
    assert q.classify(df.limit(0), labels).count() == 0
    none = q.classify(df, labels.limit(0)).collect()
    assert len(none) == 6 and all(r.keep for r in none)
