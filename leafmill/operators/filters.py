"""Filters over profiles and chunks as one Column; Catalyst pushes it down."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Empty lists restrict nothing; a null value never matches a list."""

    doc_types: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    job_ids: list[str] = field(default_factory=list)
    path_prefix: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    min_parse_quality: float | None = None
    #: Without job_ids: leave out what belongs to a job.
    unscoped_excludes_other_jobs: bool = False


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _scope(f: Filters) -> list[Column]:
    if f.job_ids:
        return [F.col("job_id").isin(f.job_ids)]
    return [F.col("job_id").isNull()] if f.unscoped_excludes_other_jobs else []


def profile_predicate(f: Filters) -> Column:
    parts = _scope(f)
    if f.doc_types:
        parts.append(F.col("doc_type").isin(f.doc_types))
    if f.languages:
        parts.append(F.col("language").isin(f.languages))
    if f.topics:
        parts.append(F.arrays_overlap("topics", F.array(*map(F.lit, f.topics))))
    if f.path_prefix:
        parts.append(F.col("path").startswith(f.path_prefix))
    if f.min_parse_quality is not None:
        parts.append(F.col("parse_quality") >= f.min_parse_quality)
    if f.date_from is not None:
        parts.append(F.col("modified_at") >= F.lit(f.date_from).cast("timestamp"))
    if f.date_to is not None:
        parts.append(F.col("modified_at") <= F.lit(f.date_to).cast("timestamp"))
    return _all(parts)


def chunk_predicate(f: Filters) -> Column:
    """Chunks know languages and jobs only."""
    parts = _scope(f)
    if f.languages:
        parts.append(F.col("language").isin(f.languages))
    return _all(parts)


def in_documents(chunks: DataFrame, doc_ids: DataFrame | list[str] | None) -> DataFrame:
    """Chunks of these documents: None is all, an empty list is none."""
    if doc_ids is None:
        return chunks
    if isinstance(doc_ids, list):
        return chunks.where(F.col("document_id").isin(doc_ids)) if doc_ids else chunks.where("false")
    return chunks.join(doc_ids.select("document_id").distinct(), "document_id", "left_semi")


def under(root: str, column: str = "path") -> Column:
    """Paths at or below a directory; a sibling with a longer name is not."""
    root = root.rstrip("/")
    return (F.col(column) == root) | F.col(column).startswith(root + "/")
