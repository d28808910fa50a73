import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from leafmill import agent, cli, services
from leafmill.config import Config, ConfigError, Server, load
from leafmill.jobs import JobConflictError, Jobs
from leafmill.plans.archive import Archive
from leafmill.server import serve

GOOD = "The contract of the parties names a delivery date and the price of the goods. " * 20


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    folder, root = tmp_path_factory.mktemp("in"), tmp_path_factory.mktemp("out")
    (folder / "a.txt").write_text(GOOD)
    (folder / "b.md").write_text("# Rules\n\nNobody is to park in the yard. " + "The yard is for the fire brigade and for nobody else. " * 8)
    archive = Archive(spark, str(root / "index"), Config(server=Server(api_key="k", uploads=str(root / "up"))))
    archive.index(str(folder))
    server = serve(archive, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None, key="k"):
        data = body if isinstance(body, bytes) else json.dumps(body).encode() if body is not None else None
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", data, {"X-API-Key": key} if key else {}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                raw, kind = r.read(), r.headers["Content-Type"]
                return r.status, json.loads(raw) if kind == "application/json" else raw
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    yield call
    server.shutdown()


def events(raw):
    return [(p.split("\n")[0][7:], json.loads(p.split("\n")[1][6:])) for p in raw.decode().strip().split("\n\n")]


def test_key_and_routes(api):
    assert api("GET", "/health", key=None)[1]["status"] == "ok"
    assert api("GET", "/documents", key=None)[0] == api("GET", "/documents", key="x")[0] == 401
    assert api("GET", "/nothing")[0] == 404 and api("POST", "/search", {})[0] == 422


def test_search_documents_and_files(api):
    docs = {d["file"]: d for d in api("GET", "/documents")[1]["documents"]}
    assert set(docs) == {"a.txt", "b.md"}
    hits = api("POST", "/search", {"query": "yard fire", "strategy": "keyword", "k": 2})[1]["hits"]
    assert hits[0]["file"] == "b.md" and hits[0]["rank"] == 1
    assert api("POST", "/search", {"query": "x", "strategy": "odd"})[0] == 422
    assert api("GET", f"/documents/{docs['a.txt']['document_id']}/file")[1].decode() == GOOD
    assert api("GET", "/documents/none/file")[0] == 404


def test_ask_and_its_stream(api):
    answer = api("POST", "/ask", {"question": "delivery date"})[1]
    assert answer["sources"][0]["file"] == "a.txt" and answer["tool_calls"] == 1
    kinds = events(api("POST", "/ask/stream", {"question": "delivery date"})[1])
    assert [k for k, _ in kinds] == ["tool_call", "tool_result", "sources_update", "chunk", "answer"]
    assert kinds[1][1]["summary"].startswith(f"{kinds[1][1]['rows']} results: a.txt") and kinds[-1][1]["text"] == kinds[-2][1]


def test_upload_index_and_promote(api):
    job = api("POST", "/index")[1]["job_id"]
    assert api("POST", f"/index/{job}/files/..%2Fc.txt", GOOD.replace("contract", "charter").encode())[1] == {"file": "c.txt"}
    assert api("POST", f"/index/{'0' * 32}/start")[0] == 404
    assert api("POST", f"/index/{job}/start")[0] == 200
    told = events(api("GET", f"/index/{job}/stream")[1])
    assert told[0][1]["status"] == "running" and told[-1][1]["status"] == "done"
    assert api("GET", f"/index/{job}")[1]["profiled"] == 3
    assert "c.txt" not in [d["file"] for d in api("GET", "/documents")[1]["documents"]]
    own = api("GET", f"/documents?scope={job}")[1]["documents"]
    assert [d["file"] for d in own] == ["c.txt"]
    assert api("POST", f"/documents/{own[0]['document_id']}/promote")[1]["job_id"] is None
    assert "c.txt" in [d["file"] for d in api("GET", "/documents")[1]["documents"]]


def test_one_writer_at_a_time(tmp_path):
    gate = threading.Event()
    jobs = Jobs(tmp_path, lambda folder, job: gate.wait(30) and {"profiled": 1} or {})
    a, b = jobs.create(), jobs.create()
    running = jobs.start(a)
    with pytest.raises(JobConflictError):
        jobs.start(b)
    gate.set()
    running.join(30)
    assert a.status == "done" and a.counts == {"profiled": 1} and b.status == "created"
    failing = Jobs(tmp_path, lambda folder, job: 1 / 0)
    c = failing.create()
    failing.start(c).join(30)
    assert c.status == "failed" and "ZeroDivisionError" in c.error and [e["status"] for e in failing.follow(c)] == ["running", "failed"]
    for name in ("", "..", "a/.."):
        with pytest.raises(ValueError):
            jobs.add(a, name, b"")


class Stub(BaseHTTPRequestHandler):
    busy = 0
    asked = []

    def log_message(self, *_):
        pass

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Stub.asked.append((self.path, body, self.headers.get("Authorization")))
        if Stub.busy:
            Stub.busy -= 1
            return self.send_error(503)
        if body.get("model") == "refused":
            return self.send_error(400)
        if self.path == "/embeddings":
            out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])][::-1]}
        elif self.path == "/rerank":
            out = {"results": [{"index": i, "relevance_score": len(d)} for i, d in enumerate(body["documents"])]}
        else:
            call = {"function": {"name": "keyword_search", "arguments": '{"query": "q"}'}}
            out = {"choices": [{"message": {"content": None, "tool_calls": [call]}}]}
        raw = json.dumps(out).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)


@pytest.fixture(scope="module")
def stub():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_services(spark, stub, monkeypatch):
    monkeypatch.setattr(services, "WAIT", 0.01)
    Stub.busy = 2
    assert services.post(f"{stub}/embeddings", {"model": "m", "input": ["abc"]}, "secret", wait=0.01)["data"][0]["embedding"] == [3.0, 1.0]
    assert Stub.asked[-1][2] == "Bearer secret" and len(Stub.asked) == 3
    with pytest.raises(RuntimeError, match="400"):
        services.post(f"{stub}/x", {"model": "refused"}, wait=0.01)
    Stub.busy = 9
    with pytest.raises(RuntimeError, match="503"):
        services.post(f"{stub}/x", {}, tries=2, wait=0.01)
    Stub.busy = 0
    with pytest.raises(RuntimeError, match="can't be reached"):
        services.post("http://127.0.0.1:9/x", {}, tries=2, wait=0.01)
    with pytest.raises(RuntimeError, match="vectors"):
        services.embed(["a"], stub, "m", None, 3)
    df = spark.createDataFrame([(i, "x" * i if i != 5 else None) for i in range(70)], "i int, t string").repartition(3)
    got = {r.i: r.v for r in df.select("i", services.embedder(stub, "m", None, 2)(F.col("t")).alias("v")).collect()}
    assert got == {i: [float(i), 1.0] if i != 5 else None for i in range(70)}
    hits = spark.createDataFrame([(1, "q", f"c{i}", "y" * (i % 4), 1.0, i + 1) for i in range(6)], "query_id int, query string, chunk_id string, text string, score double, rank int")
    best = services.reranker(stub, "m")(hits, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.rerank_score, r["rank"]) for r in best] == [("c3", 3.0, 1), ("c2", 2.0, 2), ("c1", 1.0, 3)]
    assert services.chat(stub, "m")([{"role": "user", "content": "x"}]) == {"content": "", "tool_calls": [{"name": "keyword_search", "arguments": {"query": "q"}}]}


def test_trimming_and_summaries():
    messages = [{"role": "user", "content": "q"}, *({"role": "tool", "content": f"{i}" * 400} for i in range(6))]
    assert agent.trimmed(messages, None) == agent.trimmed(messages, 10_000) == messages
    short = agent.trimmed(messages, 100)
    assert [m["content"] == agent.TRIMMED for m in short] == [False, True, True, True, False, False, False]
    assert agent.summary([]) == "0 results" and agent.summary([{"error": "x"}]) == "x"
    rows = [{"file": "a", "section": "S", "text": "w " * 200}, {"doc_id": "d", "page": 3}]
    assert agent.summary(rows) == f"2 results: a S — {('w ' * 200)[:160]}…; d p. 3"
    broken = list(agent.run(lambda m: 1 / 0, None, "q"))
    assert broken == [("error", "ZeroDivisionError: division by zero")]


def test_settings_of_agent_server_and_gate(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("agent: {max_steps: 3, trim_tokens: null}\nserver: {api_key_env: KEY}\nquality: {image_below_chars: 10, bad_chars: [0.1, 0.0, 0.28]}\n")
    made = load(path, {"KEY": "s"})
    assert made.agent.max_steps == 3 and made.server.api_key == "s" and made.quality.image_below_chars == 10
    for bad in ("agent: {max_steps: 0}", "server: {api_key_env: NONE}", "quality: {bad_chars: [0.1, 0.0, 0.5]}", "agent: {odd: 1}"):
        path.write_text(bad)
        with pytest.raises(ConfigError):
            load(path, {})


def test_ask_and_serve_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(GOOD)
    root = ["--root", str(tmp_path / "out")]
    assert cli.main(["index", str(tmp_path / "in"), *root]) == 0
    assert cli.main(["ask", "delivery date", "--verbose", *root]) == 0
    out = capsys.readouterr()
    assert "contract" in out.out and "⟦" not in out.out and "- a.txt" in out.out and "tool_result: keyword_search" in out.err
    assert cli.main(["ask", "delivery date", "--json", *root]) == 0
    assert json.loads(capsys.readouterr().out)["sources"][0]["file"] == "a.txt"
    assert cli.main(["serve", *root]) == 2 and "API key" in capsys.readouterr().err
