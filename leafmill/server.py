"""HTTP over an archive: search, ask, browse, upload and index."""

from __future__ import annotations

import hmac
import json
import mimetypes
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from leafmill import agent, registry
from leafmill.jobs import JobConflictError, Jobs
from leafmill.operators.filters import Filters
from leafmill.plans.archive import Archive

LISTED = 500


class NotFoundError(LookupError):
    pass


def scoped(scope: str | None, lang: str | None = None) -> Filters:
    return Filters(languages=[lang] if lang else [], job_ids=[scope] if scope else [], unscoped_excludes_other_jobs=scope is None)


class Api:
    """What the routes do, without HTTP."""

    def __init__(self, archive: Archive, model: Callable | None = None):
        a = archive.config.agent
        self.archive, self.settings = archive, archive.config.agent
        self.model = model or registry.build("model", a.provider, base_url=a.base_url, model=a.model, api_key=a.api_key)
        self.jobs = Jobs(archive.config.server.uploads, archive.index)
        job = r"(?P<job>[0-9a-f]{32})"
        self.routes: list[tuple[str, str, Callable]] = [
            ("GET", "/health", self.health),
            ("POST", "/search", self.search),
            ("POST", "/ask", self.ask),
            ("POST", "/ask/stream", self.ask_stream),
            ("GET", "/documents", self.documents),
            ("POST", r"/documents/(?P<document>[^/]+)/promote", self.promote),
            ("GET", r"/documents/(?P<document>[^/]+)/file", self.file),
            ("POST", "/index", self.create),
            ("POST", rf"/index/{job}/files/(?P<name>.+)", self.upload),
            ("POST", rf"/index/{job}/start", self.start),
            ("GET", rf"/index/{job}", self.job),
            ("GET", rf"/index/{job}/stream", self.job_stream),
        ]

    def health(self, **_) -> dict:
        return {"status": "ok", "agent_model": self.settings.model}

    def search(self, body: dict, **_) -> dict:
        hits = self.archive.search(body["query"], body.get("strategy"), body.get("k"), scoped(body.get("scope"), body.get("lang")))
        keys = {"rank": "rank", "score": "score", "chunk_id": "chunk_id", "document_id": "document_id", "filename": "file", "page_no": "page", "section_path": "section", "text": "text"}
        return {"hits": [{to: r[name] for name, to in keys.items()} for r in hits.collect()]}

    def _events(self, body: dict) -> Iterator[tuple[str, object]]:
        tools = agent.Tools(self.archive, body.get("lang"), body.get("scope"))
        yield from agent.run(self.model, tools, body["question"], body.get("history") or (), self.settings.max_steps, trim_tokens=self.settings.trim_tokens)

    def ask(self, body: dict, **_) -> dict:
        for kind, value in self._events(body):
            if kind == "error":
                raise RuntimeError(value)
            if kind == "answer":
                return asdict(value)
        raise RuntimeError("no answer")

    def ask_stream(self, body: dict, **_) -> Iterator[tuple[str, object]]:
        for kind, value in self._events(body):
            yield kind, asdict(value) if kind == "answer" else value

    def documents(self, query: dict, **_) -> dict:
        rows = self.archive.list_documents(scoped(query.get("scope")), LISTED).collect()
        return {"documents": [{"document_id": r.document_id, "file": r.filename, "doc_type": r.doc_type, "language": r.language, "pages": r.page_count, "topics": r.topics} for r in rows]}

    def promote(self, document: str, **_) -> dict:
        self.archive.promote(document)
        return {"document_id": document, "job_id": None}

    def file(self, document: str, **_) -> tuple[str, bytes]:
        """The original of an indexed document; the path is the archive's own."""
        found = self.archive.profile(document)
        if found is None or not Path(found.path).is_file():
            raise NotFoundError(f"no file of document {document}")
        return mimetypes.guess_type(found.path)[0] or "application/octet-stream", Path(found.path).read_bytes()

    def create(self, **_) -> dict:
        return {"job_id": self.jobs.create().id}

    def _job(self, job: str):
        if job not in self.jobs.by_id:
            raise NotFoundError(f"no job {job}")
        return self.jobs.by_id[job]

    def upload(self, job: str, name: str, raw: bytes, **_) -> dict:
        return {"file": self.jobs.add(self._job(job), unquote(name), raw)}

    def start(self, job: str, **_) -> dict:
        self.jobs.start(self._job(job))
        return {"job_id": job, "status": "running"}

    def job(self, job: str, **_) -> dict:
        found = self._job(job)
        return {"job_id": job, "status": found.status, "error": found.error, **found.counts}

    def job_stream(self, job: str, **_) -> Iterator[tuple[str, object]]:
        for event in self.jobs.follow(self._job(job)):
            yield "progress", event


def handler(api: Api, key: str | None) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_) -> None:
            pass

        def _json(self, code: int, value: object) -> None:
            body = json.dumps(value, ensure_ascii=False, default=str).encode()
            self._bytes(code, "application/json", body)

        def _bytes(self, code: int, kind: str, body: bytes) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _stream(self, events: Iterator[tuple[str, object]]) -> None:
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            try:
                for kind, value in events:
                    self.wfile.write(f"event: {kind}\ndata: {json.dumps(value, ensure_ascii=False, default=str)}\n\n".encode())
                    self.wfile.flush()
            except (BrokenPipeError, ConnectionResetError):
                events.close()  # nobody listens: the loop ends at its next step

        def _answer(self) -> None:
            url = urlsplit(self.path)
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if url.path != "/health" and not (key and hmac.compare_digest(self.headers.get("X-API-Key") or "", key)):
                return self._json(401, {"error": "the API key is missing or wrong"})
            for method, pattern, act in api.routes:
                found = re.fullmatch(pattern, url.path)
                if found and method == self.command:
                    break
            else:
                return self._json(404, {"error": f"no {self.command} {url.path}"})
            try:
                body = json.loads(raw) if raw and "/files/" not in url.path else {}
                query = {k: v[-1] for k, v in parse_qs(url.query).items()}
                out = act(**found.groupdict(), body=body, query=query, raw=raw)
            except NotFoundError as e:
                return self._json(404, {"error": str(e)})
            except JobConflictError as e:
                return self._json(409, {"error": str(e)})
            except (KeyError, ValueError) as e:
                return self._json(422, {"error": f"{type(e).__name__}: {e}"})
            except Exception as e:  # noqa: BLE001  a failure is an answer
                return self._json(500, {"error": f"{type(e).__name__}: {e}"})
            if isinstance(out, dict):
                return self._json(200, out)
            return self._bytes(200, *out) if isinstance(out, tuple) else self._stream(out)

        do_GET = do_POST = _answer  # noqa: N815

    return Handler


def serve(archive: Archive, host: str | None = None, port: int | None = None, model: Callable | None = None) -> ThreadingHTTPServer:
    """A server that is ready; without a key it refuses to be made."""
    s = archive.config.server
    if not s.api_key:
        raise ValueError("server.api_key_env must name a variable with the API key")
    return ThreadingHTTPServer((host or s.host, s.port if port is None else port), handler(Api(archive, model), s.api_key))
