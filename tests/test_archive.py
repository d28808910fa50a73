import json

import pytest

from leafmill import agent, cli, registry
from leafmill.config import ConfigError, load
from leafmill.operators.filters import Filters
from leafmill.plans.archive import Archive


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("archive")
    folder = top / "files"
    folder.mkdir()
    (folder / "lease.md").write_text("# Lease\n\nThe tenant pays the rent of the flat every month.\n\n## Deposit\n\nThe deposit is two rents and it is kept by the owner.")
    (folder / "note.txt").write_text("A note about apples and the weather of the week, which was fine and warm.")
    (folder / "bad.pdf").write_text("x")
    a = Archive(spark, str(top / "index"))
    a.folder = folder
    a.first = a.index(str(folder))
    return a


def test_index_and_rerun(archive, spark):
    assert archive.first == {"parsed": 2, "embedded": 2, "profiled": 2, "failed": 1, "total": 3}
    versions = archive._versions("chunks")
    assert archive.index(str(archive.folder)) == archive.first and archive._versions("chunks") == versions
    before = {r.chunk_id for r in archive.read("chunks").collect()}
    (archive.folder / "note.txt").write_text("Now the note is about pears.")
    archive.index(str(archive.folder))
    texts = [r.text for r in archive.read("chunks").collect()]
    assert any("pears" in t for t in texts) and not any("apples" in t for t in texts) and len(texts) == len(before)
    with pytest.raises(ValueError):
        from leafmill.config import Config, Embedding

        Archive(spark, archive.root, Config(embedding=Embedding(dim=9)))


def test_search(archive):
    hit = archive.search("deposit owner", "keyword", 3).first()
    assert hit.filename == "lease.md" and hit.section_path == "Lease > Deposit"
    assert archive.search("anything", "semantic", 2).count() == 2 and archive.search("deposit", "hybrid", 5, rerank="fake").count() >= 1
    assert archive.search("deposit", "keyword", 3, Filters(job_ids=["other"])).count() == 0
    assert [r.filename for r in archive.list_documents().collect()] == ["lease.md", "note.txt"]
    doc = hit.document_id
    assert archive.outline(doc).first().sections == ["Lease", "Lease > Deposit"]
    assert "two rents" in archive.document(doc).first().text and "tenant" not in archive.document(doc, "Lease > Deposit").first().text


def test_agent(archive):
    chunk = archive.search("deposit owner", "keyword", 1).first()
    tools = agent.Tools(archive)
    model = agent.Scripted(
        [
            {"tool_calls": [{"name": "keyword_search", "arguments": {"query": "deposit"}}, {"name": "odd", "arguments": {}}]},
            {"tool_calls": [{"name": "expand_context", "arguments": {"chunk_id": chunk.chunk_id}}, {"name": "search_documents", "arguments": {"query": "x", "date_from": "soon"}}]},
            {"content": f"Two rents ⟦{chunk.chunk_id}⟧."},
        ]
    )
    events = list(agent.run(model, tools, "How much?", history=[{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}]))
    answer = events[-1][1]
    assert [e for e, _ in events].count("tool_call") == 4 and answer.tool_calls == 4 and not answer.truncated
    assert answer.sources[0]["chunk_id"] == chunk.chunk_id and answer.documents == [chunk.document_id]
    said = [json.loads(m["content"]) for m in model.asked[-1] if m["role"] == "tool"]
    assert "no tool" in said[1][0]["error"] and "two rents" in said[2][0]["text"] and "not a date" in said[3][0]["error"]
    assert [m["role"] for m in model.asked[0]] == ["user", "user"]
    cut = list(agent.run(agent.Scripted([{"tool_calls": [{"name": "list_documents"}]}, {"content": "done"}]), tools, "q", max_steps=1))[-1][1]
    assert cut.truncated and cut.text == "done"
    assert list(agent.run(model, tools, "q", cancelled=lambda: True))[-1][1].cancelled
    assert agent.Tools(archive, scope="job").list_documents() == []


def test_promote(archive):
    doc = archive.list_documents().first().document_id
    archive.promote(doc, "job-7")
    assert archive.list_documents(Filters(unscoped_excludes_other_jobs=True)).count() == 1
    archive.promote(doc)
    assert archive.list_documents(Filters(unscoped_excludes_other_jobs=True)).count() == 2


def test_config_registry_and_cli(tmp_path, capsys):
    p = tmp_path / "c.yaml"
    p.write_text("embedding: {model: '${M:-small}', api_key_env: KEY}\nretrieval: {strategy: hybrid}")
    c = load(p, {"KEY": "k"})
    assert c.embedding.model == "small" and c.embedding.api_key == "k" and c.retrieval.strategy == "hybrid"
    for text in ("odd: {}", "chunking: {odd: 1}", "retrieval: {strategy: x}", "embedding: {model: '${NONE}'}", "embedding: {api_key_env: NONE}", "[1]", "a: [", "chunking: 3"):
        p.write_text(text)
        with pytest.raises(ConfigError):
            load(p, {})
    assert registry.names("embedder") == ["fake", "http"]
    with pytest.raises(ValueError, match="fake"):
        registry.build("embedder", "other")
    f = tmp_path / "x.txt"
    f.write_text("hello")
    assert cli.main(["parse", str(f), "--json"]) == 0 and json.loads(capsys.readouterr().out)["blocks"] == 1
    assert cli.main(["parse", str(tmp_path / "c.yaml")]) == 1 and cli.main(["parse", str(f), "--config", str(p)]) == 2


def test_partitions_follow_the_size_of_the_input(spark, tmp_path):
    from leafmill.scratch import partitions_for

    path = str(tmp_path / "t")
    spark.range(50_000).selectExpr("id", "uuid() as u").write.parquet(path)
    df = spark.read.parquet(path)
    assert partitions_for(df) == 4 and partitions_for(df, 100_000) > 10
    assert partitions_for(spark.createDataFrame([(1,)], "a int")) == 4
