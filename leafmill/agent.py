"""A question-answering loop over an archive's tools.

The model is any callable from messages to a turn, a dict with ``content`` and
``tool_calls`` (name, arguments); tests script one.  Tools are bounded queries
of ten rows or so, so their answers come to the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date

from leafmill.operators import answers
from leafmill.operators.filters import Filters
from leafmill.plans.archive import Archive

K = 10
MARK = re.compile(answers.MARK)


def _day(text: str | None, name: str) -> str | None:
    if text is None:
        return None
    try:
        return date.fromisoformat(text[:10]).isoformat() + text[10:].replace("T", " ")
    except ValueError:
        raise ValueError(f"{name}: {text!r} is not a date (YYYY-MM-DD)") from None


class Tools:
    """The seven tools, bound to an archive, a language and a job."""

    def __init__(self, archive: Archive, lang: str | None = None, scope: str | None = None):
        self.archive, self.scope = archive, scope
        self.filters = Filters(languages=[lang] if lang else [], job_ids=[scope] if scope else [], unscoped_excludes_other_jobs=scope is None)
        self.seen: set[str] = set()
        names = ("search_documents", "semantic_search", "keyword_search", "get_document", "get_document_outline", "list_documents", "expand_context")
        self.by_name: dict[str, Callable] = {n: getattr(self, n) for n in names}

    def call(self, name: str, arguments: dict) -> list[dict]:
        """Rows of a tool; what goes wrong is a row too."""
        if name not in self.by_name:
            return [{"error": f"no tool named {name!r}"}]
        try:
            return self.by_name[name](**arguments)
        except (TypeError, ValueError) as e:
            return [{"error": str(e)}]

    def _chunks(self, rows) -> list[dict]:
        out = [
            {"doc_id": r.document_id, "chunk_id": r.chunk_id, "file": r.filename, "page": r.page_no, "section": r.section_path, "text": r.text, "score": round(r.score, 4)}
            for r in rows.collect()
        ]
        self.seen.update(r["chunk_id"] for r in out)
        return out

    def search_documents(self, query: str, date_from: str | None = None, date_to: str | None = None) -> list[dict]:
        from dataclasses import replace

        f = replace(self.filters, date_from=_day(date_from, "date_from"), date_to=_day(date_to, "date_to"))
        rows = self.archive.search_documents(query, K, f).collect()
        return [{"doc_id": r.document_id, "file": r.filename, "language": r.language, "topics": r.topics, "score": round(r.score, 4)} for r in rows]

    def semantic_search(self, query: str, doc_ids: list[str] | None = None) -> list[dict]:
        return self._chunks(self.archive.search(query, "semantic", K, self.filters, doc_ids))

    def keyword_search(self, query: str, doc_ids: list[str] | None = None) -> list[dict]:
        return self._chunks(self.archive.search(query, "keyword", K, self.filters, doc_ids))

    def get_document(self, doc_id: str, section: str | None = None) -> list[dict]:
        row = self.archive.document(doc_id, section, self.scope).first()
        return [{"doc_id": doc_id, "text": row.text}] if row else [{"error": f"no document {doc_id}"}]

    def get_document_outline(self, doc_id: str) -> list[dict]:
        row = self.archive.outline(doc_id, self.scope).first()
        return [{"doc_id": doc_id, "sections": row.sections if row else []}]

    def list_documents(self) -> list[dict]:
        from dataclasses import replace

        rows = self.archive.list_documents(replace(self.filters, languages=[])).collect()
        return [{"doc_id": r.document_id, "file": r.filename, "language": r.language, "pages": r.page_count} for r in rows]

    def expand_context(self, chunk_id: str, before: int = 500, after: int = 500) -> list[dict]:
        if chunk_id not in self.seen:
            return [{"error": f"chunk {chunk_id} was not found by a search before"}]
        row = self.archive.context(chunk_id, before, after).first()
        return [{"doc_id": row.document_id, "chunk_id": chunk_id, "text": row.text}]


@dataclass
class Answer:
    text: str
    sources: list[dict]
    documents: list[str]
    tool_calls: int
    truncated: bool = False
    cancelled: bool = False


@dataclass
class Scripted:
    """A model that plays back turns."""

    turns: list[dict]
    asked: list[list[dict]] = field(default_factory=list)

    def __call__(self, messages: list[dict]) -> dict:
        self.asked.append(list(messages))
        return self.turns[len(self.asked) - 1]


def _pool(messages: list[dict]) -> tuple[dict[str, dict], list[str]]:
    """Evidence by chunk, the first row wins, and documents in order seen."""
    pool: dict[str, dict] = {}
    documents: dict[str, None] = {}
    for m in messages:
        rows = json.loads(m["content"]) if m["role"] == "tool" else []
        for r in rows:
            if "error" in r:
                continue
            if r.get("chunk_id"):
                pool.setdefault(r["chunk_id"], r)
            if r.get("doc_id"):
                documents.setdefault(r["doc_id"])
    return pool, list(documents)


TRIMMED = "[an earlier result of this tool was taken out to save room; call it again if it is needed]"
KEPT_RESULTS = 3
SNIPPET = 160


def trimmed(messages: list[dict], budget: int | None) -> list[dict]:
    """What the model is shown: beyond ``budget`` tokens, at some four letters
    each, all tool results but the last few are taken out."""
    if budget is None or sum(len(m["content"]) for m in messages) <= 4 * budget:
        return messages
    results = [i for i, m in enumerate(messages) if m["role"] == "tool"]
    old = set(results[:-KEPT_RESULTS])
    return [{**m, "content": TRIMMED} if i in old else m for i, m in enumerate(messages)]


def summary(rows: list[dict]) -> str:
    """One line about a tool's rows: where each is from, and how it begins."""
    if not rows:
        return "0 results"
    if "error" in rows[0]:
        return str(rows[0]["error"])[:200]

    def label(r: dict) -> str:
        bits = [str(r.get("file") or r.get("doc_id") or "?")]
        if r.get("section"):
            bits.append(str(r["section"]))
        elif r.get("page") is not None:
            bits.append(f"p. {r['page']}")
        if r.get("text"):
            flat = " ".join(str(r["text"]).split())
            bits.append(f"— {flat[:SNIPPET]}{'…' if len(flat) > SNIPPET else ''}")
        return " ".join(bits)

    return f"{len(rows)} results: " + "; ".join(map(label, rows))


def run(
    model: Callable,
    tools: Tools,
    question: str,
    history: list[dict] = (),
    max_steps: int = 12,
    cancelled: Callable[[], bool] = lambda: False,
    trim_tokens: int | None = None,
) -> Iterator[tuple[str, object]]:
    """Events of one question: tool_call, tool_result, sources_update after a
    tool found something new, chunk with the answer's text, and last the answer;
    an error ends them.

    When the steps run out the model gets one more turn, without tools.
    """
    messages: list[dict] = [m for m in history if m.get("role") in ("user", "assistant") and m.get("content")]
    messages.append({"role": "user", "content": question})
    calls, text, truncated, stopped, known = 0, "", False, False, 0
    for step in range(max_steps + 1):
        if cancelled():
            stopped = True
            break
        if step == max_steps:
            truncated = True
            messages.append({"role": "user", "content": "Answer now from what you have found."})
        try:
            turn = model(trimmed(messages, trim_tokens))
        except Exception as e:  # noqa: BLE001  a model that fails is an event, not a lost connection
            yield "error", f"{type(e).__name__}: {e}"
            return
        text = (turn.get("content") or "").strip()
        messages.append({"role": "assistant", "content": text})
        wanted = turn.get("tool_calls") or []
        if truncated or not wanted:
            break
        for call in wanted:
            calls += 1
            yield "tool_call", call
            rows = tools.call(call["name"], call.get("arguments") or {})
            messages.append({"role": "tool", "content": json.dumps(rows, ensure_ascii=False)})
            yield "tool_result", {"name": call["name"], "rows": len(rows), "summary": summary(rows)}
        pool = _pool(messages)[0]
        if len(pool) > known:
            known = len(pool)
            yield "sources_update", list(pool)
    pool, documents = _pool(messages)
    cited = [c for c in dict.fromkeys(MARK.findall(text)) if c in pool]
    if not cited and answers.ABSTAIN not in text:
        cited = list(pool)[:3]
    sources = [{k: pool[c].get(k) for k in ("file", "page", "section", "text", "chunk_id", "doc_id")} for c in cited]
    if text:
        yield "chunk", text
    yield "answer", Answer(text, sources, documents, calls, truncated and not stopped, stopped)


def ask(model: Callable, tools: Tools, question: str, **settings) -> Answer:
    """The answer alone; raises if the model failed."""
    for kind, value in run(model, tools, question, **settings):
        if kind == "error":
            raise RuntimeError(value)
        if kind == "answer":
            return value
    raise RuntimeError("no answer")


def first_passages(messages: list[dict]) -> dict:
    """A stand-in for a language model: it searches for the question once, and
    answers with the beginnings of what was found."""
    question = [m["content"] for m in messages if m["role"] == "user"][-1]
    found = [m for m in messages if m["role"] == "tool"]
    if not found:
        return {"content": "", "tool_calls": [{"name": "keyword_search", "arguments": {"query": question}}]}
    rows = [r for r in json.loads(found[-1]["content"]) if r.get("chunk_id")]
    said = [f"{' '.join(r['text'].split())[:SNIPPET]} ⟦{r['chunk_id']}⟧" for r in rows[:3]]
    return {"content": "\n".join(said) or answers.ABSTAIN}
