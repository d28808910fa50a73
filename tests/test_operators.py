import io
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.graph import connected_components
from leafmill.operators import answers, evaluation, filters, index, retrieval
from leafmill.scratch import Scratch, shared_dir
from leafmill.sources import parsers


def test_filters(spark):
    rows = [("1", "pdf", "tr", ["a", "b"], "/x/a", None, "2024-01-02 00:00:00", 0.9), ("2", "txt", None, ["c"], "/x-y/a", "j", None, 0.2)]
    df = spark.createDataFrame(rows, "document_id string, doc_type string, language string, topics array<string>, path string, job_id string, modified_at string, parse_quality double")
    df = df.withColumn("modified_at", F.col("modified_at").cast("timestamp"))
    ids = lambda **kw: [r.document_id for r in df.where(filters.profile_predicate(filters.Filters(**kw))).orderBy("document_id").collect()]
    assert ids() == ["1", "2"] and ids(languages=["tr", "en"]) == ["1"] and ids(topics=["b", "z"]) == ["1"]
    assert ids(path_prefix="/x") == ["1", "2"] and ids(job_ids=["j"]) == ["2"] and ids(unscoped_excludes_other_jobs=True) == ["1"]
    assert ids(date_from="2024-01-02") == ["1"] and ids(date_to="2023-01-01") == [] and ids(min_parse_quality=0.5) == ["1"]
    assert [r.document_id for r in df.where(filters.under("/x")).collect()] == ["1"]
    assert filters.in_documents(df, []).count() == 0 and filters.in_documents(df, None).count() == 2 and filters.in_documents(df, ["2"]).count() == 1


def test_fusion_and_dispatch(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (1, "w", 3)], "query_id int, chunk_id string, rank int")
    got = retrieval.fuse([a, b], 4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["x", "y", "z", "w"] and got[0].score == got[1].score == round(1 / 61 + 1 / 62, 6)
    with pytest.raises(ValueError):
        retrieval.search("other", None, None, 3)
    top = retrieval.search("semantic", lambda n: a, None, 2, retrieval.rerank_reversed).orderBy("rank").collect()
    assert [(r.chunk_id, r.rerank_score) for r in top] == [("z", 1.0), ("y", 0.5)]


def test_neighbours_are_claimed_once(spark):
    chunks = spark.createDataFrame([("d", f"c{i}", i, f"t{i}") for i in range(5)], "document_id string, chunk_id string, start int, text string")
    hits = spark.createDataFrame([(1, "c1", 1), (1, "c3", 2)], "query_id int, chunk_id string, rank int")
    got = {r.chunk_id: r.text for r in retrieval.expand_neighbours(hits, chunks, 1).collect()}
    assert got == {"c1": "t0\nt1\nt2", "c3": "t3\nt4"}
    wide = retrieval.expand_context(hits.where("rank = 1"), chunks, before=1, after=3).first().text
    assert wide == "t0t1t2t3"


def test_bm25_edges(spark):
    chunks = spark.createDataFrame([("a", "kira bedeli", "tr"), ("b", "kira kira", "tr"), ("c", "", "en")], "chunk_id string, text string, language string").withColumn("job_id", F.lit(None).cast("string")).withColumn("document_id", F.col("chunk_id"))
    ask = lambda q: spark.createDataFrame([(1, q)], "query_id int, query string")
    assert {r.chunk_id for r in retrieval.bm25(ask("kira"), chunks, 5).collect()} == {"a", "b"}
    assert retrieval.bm25(ask("ve ile"), chunks, 5).count() == 0
    assert retrieval.bm25(ask("kira"), chunks, 5, doc_ids=[]).count() == 0
    assert retrieval.text_membership(ask("kira bedel"), chunks, 5).first().chunk_id == "a"


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    gold = spark.createDataFrame([(1, "a"), (1, "d"), (2, "a")], "query_id int, document_id string")
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "y", 2), (2, "a", 3)], "query_id int, document_id string, rank int")
    got = {r.query_id: r for r in evaluation.retrieval_metrics(q, gold, ranked, 3).collect()}
    assert got[1].recall == 0.5 and got[2].mrr == pytest.approx(1 / 3, abs=1e-6) and got[2].ndcg == 0.5 and got[3].recall == got[3].mrr == 0.0
    s = evaluation.citation_scores(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))
    assert tuple(spark.range(1).select(s.alias("s")).first().s) == (0.5, 1.0, pytest.approx(2 / 3))
    v = spark.createDataFrame([("EVET\nçünkü",), ("Hayır",), ("?",)], "a string").select(evaluation.judge_verdict(F.col("a")).alias("v"))
    assert [r.v for r in v.collect()] == [True, False, False]
    assert evaluation.markdown(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string"), ["a", "b", "c"]).endswith("| 1 | 0.500 | - |")


def test_state(spark):
    schema = "document_id string, path string, content_hash string, status string, error string, chunk_count int"
    state = spark.createDataFrame([("1", "/a/1", "h1", "profiled", None, 3), ("2", "/a/2", "h2", "failed", "x", 0), ("3", "/ab/3", "h3", "parsed", None, 1)], schema)
    found = spark.createDataFrame([("1", "/a/1", "h1"), ("2", "/a/2", "h2"), ("3", "/ab/3", "new"), ("4", "/a/4", "h4")], "document_id string, path string, content_hash string")
    assert sorted(r.document_id for r in index.to_do(found, state).collect()) == ["3", "4"]
    assert sorted(r.document_id for r in index.to_do(found, state, retry_failed=True).collect()) == ["2", "3", "4"]
    begun = {r.document_id: r for r in index.begin(state, index.to_do(found, state)).collect()}
    assert begun["3"].status == begun["4"].status == "pending" and begun["3"].chunk_count == 0 and begun["1"].status == "profiled"
    assert index.stranded(state, "/a").count() == 0 and index.stranded(state, "/ab").count() == 1
    up = spark.createDataFrame([("3", "embedded", None, None)], "document_id string, status string, error string, chunk_count int")
    after = {r.document_id: r for r in index.transition(state, up).collect()}
    assert after["3"].status == "embedded" and after["3"].chunk_count == 1 and after["2"].error == "x"
    with pytest.raises(Exception, match="unknown status"):
        index.transition(state, up.withColumn("status", F.lit("odd"))).collect()
    with pytest.raises(ValueError):
        index.check_fingerprint("a", "b")
    assert index.check_fingerprint(None, "b") == "b"
    assert tuple(index.progress(state).first()) == (2, 1, 1, 1, 3)


def test_discover_parse_and_rerun(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Top\n\nhello\n\n## Sub\nworld")
    (tmp_path / "sub/b.html").write_text("<title>t</title><h1>Head</h1><p>one<br>two<script>x</script>")
    (tmp_path / "c.txt").write_bytes("şu\n\n ı".encode("cp1254"))
    (tmp_path / "state.DB").write_text("x")
    (tmp_path / "d.pdf").write_text("x")
    (tmp_path / "e.zip").write_text("x")
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        p = lambda s, t: f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Title', 'T')}{p('Heading1', 'H')}{p('x', 'body')}<w:tbl><w:tr><w:tc>{p('x', 'a')}</w:tc><w:tc>{p('x', 'b')}</w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "f.docx").write_bytes(docx.getvalue())
    (tmp_path / "g.docx").write_text("broken")
    files = index.discover(spark, str(tmp_path))
    assert files.count() == 7
    got = {r.path.rsplit("/", 1)[1]: r for r in parsers.parse_files(files).collect()}
    assert [(b.text, b.kind) for b in got["a.md"].blocks] == [("Top", "heading"), ("hello", "text"), ("Sub", "heading"), ("world", "text")]
    assert [o.path for o in got["a.md"].outline] == ["Top", "Top > Sub"]
    assert [b.text for b in got["b.html"].blocks] == ["Head", "one", "two"]
    assert got["c.txt"].encoding == "cp1254" and [b.text for b in got["c.txt"].blocks] == ["şu", "ı"]
    assert [(b.text, b.level) for b in got["f.docx"].blocks] == [("T", 1), ("H", 2), ("body", None), ("a | b", None)]
    assert got["d.pdf"].status == got["e.zip"].status == got["g.docx"].status == "failed" and "not a PDF" in got["d.pdf"].error
    state = files.selectExpr("document_id", "path", "content_hash", "'profiled' as status")
    assert index.to_do(files, state).count() == 0


def test_answers(spark):
    pool = spark.createDataFrame([(1, 0, 0, "d1", "c1"), (1, 1, 0, "d2", "c2")], "conv_id int, turn int, ix int, doc_id string, chunk_id string")
    said = spark.createDataFrame([(1, "x ⟦c2⟧ ⟦c1⟧ ⟦c2⟧")], "conv_id int, answer string")
    assert [r.chunk_id for r in answers.answer_sources(said, pool).orderBy("seq").collect()] == ["c2", "c1"]
    none = spark.createDataFrame([(1, "no marks")], "conv_id int, answer string")
    assert [r.chunk_id for r in answers.answer_sources(none, pool).orderBy("seq").collect()] == ["c1", "c2"]
    assert answers.answer_sources(none.withColumn("answer", F.lit("BULAMADIM")), pool).count() == 0
    bad = spark.createDataFrame([(1, 0, "not json"), (1, 1, '[{"doc_id":"d","chunk_id":"c"},{"error":"e","chunk_id":"x"}]')], "conv_id int, turn int, payload string")
    assert [r.chunk_id for r in answers.evidence_pool(bad).collect()] == ["c"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (700, 700), (None, 3), (501, 502)]
    df = spark.createDataFrame(edges, "a int, b int")
    got = {r.node: r.root for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500, 502: 500}


def test_scratch_is_in_the_shared_folder(spark):
    s = Scratch(spark, "x")
    kept = s.keep(spark.range(3), "t")
    assert s.root.startswith(shared_dir(spark)) and kept.count() == 3
    s.drop()


def test_dense_search_in_blocks_against_brute_force(spark):
    import numpy as np

    from leafmill.operators import dense

    rng = np.random.default_rng(4)
    rows = [(f"c{i:03d}", rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(300)] + [("zero", [0.0] * 5), ("none", None)]
    asked = [(i, rows[i][1]) for i in range(0, 300, 20)] + [(900, [0.0] * 5), (901, None)]
    df = spark.createDataFrame(rows, "chunk_id string, dense array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id int, vector array<double>")

    def cosine(a, b):
        size = float(np.linalg.norm(a) * np.linalg.norm(b))
        return round(float(np.dot(a, b)) / size, 6) + 0.0 if size else 0.0

    want = set()
    for q, v in asked:
        if v is not None:
            ranked = sorted((-cosine(v, x), c) for c, x in rows if x is not None)[:7]
            want |= {(q, c, -s + 0.0, k + 1) for k, (s, c) in enumerate(ranked)}
    for most, products in ((10_000, 1 << 22), (4, 64)):
        dense._PRODUCTS = products
        found = dense.nearest(queries, df, 7, "chunk_id", "dense", most)
        top = retrieval.top(found, 7, F.desc("score"), F.asc("chunk_id"), by="query_id")
        assert {(r.query_id, r.chunk_id, r.score + 0.0, r["rank"]) for r in top.collect()} == want
    dense._PRODUCTS = 1 << 22
    assert len(dense.blocks(queries, 4)) == 9
    assert sum(b.count() for b in dense.blocks(queries, 4)) == len(asked)


def test_substring_search_takes_further_passes(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", f"alpha{i % 3} beta{i % 5} gamma") for i in range(30)], "chunk_id string, text string").selectExpr(
        "*", "'d' as document_id", "null as job_id", "null as language"
    )
    asked = spark.createDataFrame([(i, f"alpha{i % 3} beta{i % 5}") for i in range(12)], "query_id int, query string")
    want = sorted(map(tuple, retrieval.text_membership(asked, chunks, 4).collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    assert sorted(map(tuple, retrieval.text_membership(asked, chunks, 4).collect())) == want and len(want) == 48
