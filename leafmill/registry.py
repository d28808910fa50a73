"""Named providers of each kind: embedders, rerankers, models."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_providers: dict[tuple[str, str], Callable[..., Any]] = {}


def register(kind: str, name: str) -> Callable:
    def keep(made: Callable) -> Callable:
        _providers[kind, name] = made
        return made

    return keep


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _providers if k == kind)


def build(kind: str, name: str, **settings: Any) -> Any:
    if (kind, name) not in _providers:
        raise ValueError(f"no {kind} named {name!r}; there are: {', '.join(names(kind)) or 'none'}")
    return _providers[kind, name](**settings)


@register("embedder", "fake")
def _fake(dim: int = 8, normalize: bool = True, **_: Any) -> Callable:
    """Column of text to column of vector."""
    from leafmill.functions.vectors import hash_embedding

    return lambda text: hash_embedding(text, dim, normalize)


@register("reranker", "fake")
def _reversed(**_: Any) -> Callable:
    from leafmill.operators.retrieval import rerank_reversed

    return rerank_reversed


@register("embedder", "http")
def _embedding_service(base_url: str = "", model: str = "", api_key: str | None = None, dim: int = 8, **_: Any) -> Callable:
    from leafmill.services import embedder

    return embedder(base_url, model, api_key, dim)


@register("model", "fake")
def _passages(**_: Any) -> Callable:
    from leafmill.agent import first_passages

    return first_passages


@register("model", "http")
def _chat_service(base_url: str = "", model: str = "", api_key: str | None = None, **_: Any) -> Callable:
    from leafmill.services import chat

    return chat(base_url, model, api_key)
