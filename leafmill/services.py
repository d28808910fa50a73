"""Clients of embedding, reranking and chat services, with retries.

Services speak the common JSON of OpenAI-like servers.  Texts and passages go in
batches from where they lie: the embedder is an Arrow UDF, so each executor asks
for its own rows.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.retrieval import top

TRIES = 4
WAIT = 0.5
BATCH = 32
#: Answers after which a request is sent again.
BUSY = (408, 409, 429, 500, 502, 503, 504)


def post(url: str, body: dict, api_key: str | None = None, tries: int = TRIES, wait: float = WAIT, timeout: float = 120) -> dict:
    """The JSON answer.  Busy services and lost connections are tried again,
    each time after twice the wait; other refusals are errors at once."""
    headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {api_key}"} if api_key else {})}
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code not in BUSY or attempt == tries - 1:
                raise RuntimeError(f"{url} answered {e.code}: {e.read()[:200].decode(errors='replace')}") from e
        except (urllib.error.URLError, TimeoutError) as e:
            if attempt == tries - 1:
                raise RuntimeError(f"{url} can't be reached: {e}") from e
        time.sleep(wait * 2**attempt)
    raise AssertionError("a try ends by an answer or an error")


def embed(texts: list[str], url: str, model: str, api_key: str | None, dim: int) -> list[list[float]]:
    """Vectors in the order of the texts, whatever the order of the answer."""
    out: list[list[float]] = []
    for at in range(0, len(texts), BATCH):
        part = texts[at : at + BATCH]
        rows = post(f"{url.rstrip('/')}/embeddings", {"model": model, "input": part}, api_key)["data"]
        vectors = [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]
        if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
            raise RuntimeError(f"the embedding service gave {len(vectors)} vectors for {len(part)} texts, or not of {dim} numbers")
        out += vectors
    return out


def embedder(url: str, model: str, api_key: str | None = None, dim: int = 8) -> Callable[[Column], Column]:
    """Column of text to column of vector; null texts have none."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = [t for t in texts if t is not None]
            vectors = iter(embed(known, url, model, api_key, dim))
            yield pd.Series([None if t is None else next(vectors) for t in texts], dtype=object)

    return run


def reranker(url: str, model: str, api_key: str | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """Hits (query_id, query, chunk_id, text, score, rank) by the scores that a
    service gives each query's candidates, which are bounded by the search."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        body = {"model": model, "query": pdf["query"].iloc[0], "documents": pdf["text"].tolist()}
        rows = post(f"{url.rstrip('/')}/rerank", body, api_key)["results"]
        scores = {r["index"]: float(r["relevance_score"]) for r in rows}
        return pdf.assign(rerank_score=[scores.get(i, float("-inf")) for i in range(len(pdf))])

    def run(hits: DataFrame, k: int) -> DataFrame:
        names = [f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields if f.name != "rerank_score"]
        scored = hits.drop("rerank_score").groupBy("query_id").applyInPandas(score, ", ".join([*names, "rerank_score double"]))
        return top(scored.withColumnRenamed("rank", "before"), k, F.desc("rerank_score"), F.asc("before"), by="query_id").drop("before")

    return run


def chat(url: str, model: str, api_key: str | None = None) -> Callable[[list[dict]], dict]:
    """A model for the answer loop: messages to (content, tool_calls)."""

    def run(messages: list[dict]) -> dict:
        sent = [{"role": "user" if m["role"] == "tool" else m["role"], "content": m["content"]} for m in messages]
        said = post(f"{url.rstrip('/')}/chat/completions", {"model": model, "messages": sent}, api_key)["choices"][0]["message"]
        calls = [{"name": c["function"]["name"], "arguments": json.loads(c["function"].get("arguments") or "{}")} for c in said.get("tool_calls") or []]
        return {"content": said.get("content") or "", "tool_calls": calls}

    return run
