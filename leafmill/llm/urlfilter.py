"""URL filters by a cascade of Bloom filters.

Rules list hosts with path prefixes.  The corpus has a complete universe of
keys: every pair of a host suffix and a path prefix that a rule could name in
some url.  The first filter of a cascade encodes the listed keys of the
universe; the second the universe's other keys that the first lets through; the
third the listed keys that the second lets through; and so on until a level
lets nothing through.  A key of the universe is listed if and only if the
number of levels that it passes, before one stops it, is odd.  So urls are
judged by filters of a few bits a key, exactly, and nothing is joined.

The first filter lets through about listed / (sqrt 2 * universe) of the keys,
so that however large the corpus is, only some 0.7 false positives for each
listed key come to the driver; the further filters let half through.  A list
whose filters would be larger than ``MOST_BYTES`` is dealt by hash to several
cascades, and urls pass by one after the other.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.scratch import Scratch

#: Bytes of the keys of a cascade on the driver, and of what is sent to executors.
MOST_BYTES = 256 << 20
#: Hashes that are looked up at a time; few keys that are not listed pass four.
_AT_ONCE = 4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ``://``."""
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")), F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def suffixes(host: str) -> list[str]:
    """The host and the domains above it, longest first."""
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


class Bloom:
    """A Bloom filter over 64-bit hashes, salted by its level, that lets some
    ``rate`` of other keys through."""

    def __init__(self, keys: np.ndarray, level: int, rate: float):
        self.level = level
        self.hashes = max(1, round(-math.log2(rate)))
        self.words = np.zeros(max(8, math.ceil(len(keys) * self.hashes / math.log(2) / 64)), np.uint64)
        for at in range(0, self.hashes, _AT_ONCE):
            np.bitwise_or.at(self.words, *self._bits(self._mixed(keys), at))

    def _mixed(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys ^ np.uint64((self.level * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29)), (h * np.uint64(0x94D049BB133111EB)) | np.uint64(1)

    def _bits(self, mixed: tuple[np.ndarray, np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = mixed
        steps = np.arange(first, min(first + _AT_ONCE, self.hashes), dtype=np.uint64)
        at = (a[:, None] + steps * b[:, None]) % np.uint64(len(self.words) * 64)
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def has(self, keys: np.ndarray) -> np.ndarray:
        a, b = self._mixed(keys)
        alive = np.arange(len(keys))
        for first in range(0, self.hashes, _AT_ONCE):
            at, bit = self._bits((a[alive], b[alive]), first)
            alive = alive[((self.words[at] & bit) != 0).all(axis=1)]
        out = np.zeros(len(keys), bool)
        out[alive] = True
        return out


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        """How many levels each key passes before one stops it."""
        out = np.zeros(len(hashes), np.int64)
        alive = np.arange(len(hashes))
        for bloom in self.levels:
            alive = alive[bloom.has(hashes[alive])]
            out[alive] += 1
        return out

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        return self.passed(hashes) % 2 == 1


def key_hash(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\x00{path}".encode("utf-8", "surrogatepass"))


def _candidates(host: str, path: str, lengths: Sequence[int]) -> Iterator[tuple[str, str]]:
    """Keys of a url, the longest host first and of each the longest path."""
    fit = [n for n in lengths if n <= len(path)]
    for h in suffixes(host):
        for n in fit:
            yield h, path[:n]


def _key_batches(lengths: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {
                key_hash(h, p)
                for host, path in set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                for h, p in _candidates(host, path, lengths)
            }
            yield pa.RecordBatch.from_arrays([pa.array(np.array(sorted(found), np.uint64).view(np.int64))], ["key"])

    return run


def _among(keys: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``listed``."""
    if not len(listed):
        return np.zeros(len(keys), bool)
    return listed[np.minimum(np.searchsorted(listed, keys), len(listed) - 1)] == keys


def _key_filter(keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep(keys)].view(np.int64))], ["key"])

    return run


def _to_driver(keys: DataFrame) -> np.ndarray:
    return np.sort(keys.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def build_cascade(universe: DataFrame, listed: Iterable[int], scratch: Scratch, size: int | None = None) -> Cascade:
    """A cascade that decides exactly which keys of ``universe`` (key: 64-bit
    hashes, distinct, ``size`` in all) are among ``listed``.

    Of the universe the listed keys come to the driver, and those that pass the
    first filter by mistake.  If these are more than the keys of the list by
    far, which is a rare chance, a finer filter is tried; so what the driver
    holds is bounded by the list.
    """
    context = universe.sparkSession.sparkContext
    size = universe.count() if size is None else size
    wanted = context.broadcast(np.unique(np.array(list(listed), np.uint64)))
    keep = _to_driver(universe.mapInArrow(_key_filter(lambda keys: _among(keys, wanted.value)), "key long"))
    cascade = Cascade()
    if not len(keep):
        return cascade
    rate = min(0.5, len(keep) / (math.sqrt(2) * max(1, size - len(keep))))
    while True:
        first = Bloom(keep, 0, rate)
        sent = context.broadcast(first)
        wrong = universe.mapInArrow(_key_filter(lambda keys: sent.value.has(keys) & ~_among(keys, wanted.value)), "key long")  # noqa: B023
        wrong = scratch.keep(wrong, f"wrong-{uuid.uuid4().hex}")
        if wrong.count() <= 8 * len(keep) + 4096:
            break
        rate /= 4
    cascade.levels.append(first)
    sides = [_to_driver(wrong), keep]  # what odd and even levels encode
    while len(sides[0]):
        bloom = Bloom(sides[0], len(cascade.levels), 0.5)
        cascade.levels.append(bloom)
        sides = [sides[1][bloom.has(sides[1])], sides[0]]
    return cascade


def _judge_batches(cascades, lengths: Sequence[int], part: int, parts: int):
    """Adds to ``at`` (how many keys are longer than the url's best so far),
    ``rule`` and ``verdict`` what the cascades of one part know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_verdict = cascades.value
        for batch in batches:
            urls = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            best = [list(batch.column(k).to_pylist()) for k in (3, 4, 5)]
            keys = [list(islice(_candidates(h, p, lengths), at)) for (h, p), at in zip(urls, best[0], strict=True)]
            hashes = np.array([key_hash(*k) for row in keys for k in row], np.uint64)
            mine = hashes % np.uint64(parts) == part
            hit = {v: np.zeros(len(hashes), bool) for v in by_verdict}
            for v, c in by_verdict.items():
                hit[v][mine] = c.listed(hashes[mine])
            at = 0
            for i, row in enumerate(keys):
                for j, (h, p) in enumerate(row):
                    found = next((v for v in hit if hit[v][at + j]), None)
                    if found:
                        best[0][i], best[1][i], best[2][i] = j, h + p, found
                        break
                at += len(row)
            kinds = (pa.int32(), pa.string(), pa.string())
            columns = [pa.array(x, k) for x, k in zip(best, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], batch.schema.names)

    return run


def judge(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """(id, host, path, rule, verdict) of each row.

    The rule with the longest host, then path, that fits decides; a url that
    none fits is on no list, and allowed.  Of two verdicts for one key block
    wins.  Null urls have an empty host and path.  Repeated rows come back as
    often; other columns are not looked at.  An empty table gives an empty
    result, and without rules all urls are allowed.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "urlfilter")
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    keys = rows.select("host", "path").mapInArrow(_key_batches(lengths), "key long").distinct()
    universe = scratch.keep(keys, "universe")
    size = universe.count()
    blocked = {key_hash(r.host, r.path) for r in rules if r.verdict == "block"}
    allowed = {key_hash(r.host, r.path) for r in rules if r.verdict == "allow"} - blocked
    # A key takes 8 bytes where cascades are built, and fewer in their filters.
    n = max(1, math.ceil(16 * len(blocked | allowed) / most_bytes))
    longest = F.lit((1 << 31) - 1).alias("at")
    judged = rows.select("id", "host", "path", longest, F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    for k in range(n):
        own = [{x for x in side if x % n == k} for side in (blocked, allowed)]
        cascades = {v: build_cascade(universe, x, scratch, size) for v, x in zip(("block", "allow"), own, strict=True)}
        judged = judged.mapInArrow(_judge_batches(spark.sparkContext.broadcast(cascades), lengths, k, n), judged.schema)
        if k + 1 < n:  # so that a worker holds the cascades of one part
            judged = scratch.keep(judged, f"judged-{k}")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
