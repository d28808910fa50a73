import json
import uuid

from leafmill.sources import gold


def test_gold_sources(spark, tmp_path):
    y = tmp_path / "g.yaml"
    y.write_text("- question: q\n  relevant_doc_files: [a.pdf]\n- question: r\n  relevant_doc_ids: [x]\n  reference_answer: yes it is\n")
    rows = {r.question: r for r in gold.resolve_files(gold.manual(spark, str(y)), "/c").collect()}
    assert rows["q"].doc_ids == [str(uuid.uuid5(uuid.NAMESPACE_URL, "/c/a.pdf"))] and rows["r"].doc_ids == ["x"] and rows["r"].language == "tr"
    d = tmp_path / "articles"
    d.mkdir()
    (d / "1.json").write_text(json.dumps({"article": {"id": "A"}, "chunks": [{"id": "c1", "content": "t"}], "questions": {"items": [{"question": "q", "answer": "a", "category": "k", "related_chunk_ids": ["c1"]}]}}, indent=1))
    q, c = gold.articles(spark, str(d), "set")
    assert q.first().chunk_ids == ["A::c1"] and tuple(c.first()) == ("A", "A::c1", "t")
    p = tmp_path / "p.json"
    p.write_text("\n".join(json.dumps({"id": i, "context": "c", "question": "q", "answers": {"text": ["a"]}}) for i in ("1", "2", "2")))
    q, c = gold.parallel(spark, str(p), str(p), "pairs")
    assert q.count() == 3 and c.count() == 2 and q.first().reference_answer == "a"
