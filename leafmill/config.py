"""Settings from YAML: environment variables, secrets, strict keys."""

from __future__ import annotations

import dataclasses
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from leafmill.functions.quality import QualityConfig


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Chunking:
    target_chars: int = 1200
    overlap_ratio: float = 0.15


@dataclass(frozen=True)
class Retrieval:
    strategy: str = "semantic"
    keyword_backend: str = "text"
    chunk_k: int = 10
    rerank_candidates: int = 50
    neighbour_width: int = 0

    def __post_init__(self) -> None:
        if self.strategy not in ("semantic", "keyword", "hybrid"):
            raise ConfigError(f"unknown strategy {self.strategy!r}")
        if self.keyword_backend not in ("text", "bm25", "sparse"):
            raise ConfigError(f"unknown keyword backend {self.keyword_backend!r}")


@dataclass(frozen=True)
class Embedding:
    provider: str = "fake"
    model: str = "fake"
    base_url: str | None = None
    dim: int = 8
    normalize: bool = True
    api_key_env: str | None = None
    api_key: str | None = None


@dataclass(frozen=True)
class Agent:
    provider: str = "fake"
    model: str = "fake"
    base_url: str | None = None
    max_steps: int = 12
    trim_tokens: int | None = 12_000
    api_key_env: str | None = None
    api_key: str | None = None

    def __post_init__(self) -> None:
        if self.max_steps < 1:
            raise ConfigError("agent.max_steps must be 1 or more")


@dataclass(frozen=True)
class Server:
    host: str = "127.0.0.1"
    port: int = 8000
    uploads: str = "leafmill-uploads"
    api_key_env: str | None = None
    api_key: str | None = None


@dataclass(frozen=True)
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    embedding: Embedding = field(default_factory=Embedding)
    agent: Agent = field(default_factory=Agent)
    server: Server = field(default_factory=Server)
    quality: QualityConfig = field(default_factory=QualityConfig)


def _filled(value: Any, env: Mapping[str, str]) -> Any:
    """``${NAME}`` and ``${NAME:-default}`` replaced, at any depth."""
    if isinstance(value, dict):
        out = {k: _filled(v, env) for k, v in value.items()}
        if out.get("api_key_env") is not None:
            if out["api_key_env"] not in env:
                raise ConfigError(f"{out['api_key_env']} is named as a key's variable, but is not set")
            out["api_key"] = env[out["api_key_env"]]
        return out
    if isinstance(value, list):
        return [_filled(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def look(m: re.Match) -> str:
        found = env.get(m["name"]) or m["default"]
        if found is None:
            raise ConfigError(f"environment variable {m['name']} is not set")
        return found

    return re.sub(r"\$\{(?P<name>\w+)(?::-(?P<default>[^}]*))?\}", look, value)


def _build(kind: type, raw: Any, where: str) -> Any:
    if not isinstance(raw, dict):
        raise ConfigError(f"{where}: a mapping is needed")
    known = {f.name: f for f in dataclasses.fields(kind)}
    if odd := sorted(set(raw) - set(known)):
        raise ConfigError(f"{where}: unknown settings {', '.join(odd)}")
    made = {}
    for name, value in raw.items():
        made[name] = _build(known[name].default_factory, value, f"{where}.{name}") if kind is Config else tuple(value) if isinstance(value, list) else value
    try:
        return kind(**made)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{where}: {e}") from e


def load(path: str | Path, env: Mapping[str, str] | None = None) -> Config:
    try:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    except (UnicodeDecodeError, yaml.YAMLError) as e:
        raise ConfigError(f"{path}: {e}") from e
    return _build(Config, _filled(raw, os.environ if env is None else env), str(path))
