"""SimHash fingerprints and near-duplicate groups by covering LSH.

A fingerprint has 64 bits; two texts link when theirs differ in at most three.
Covering LSH gives every bit position a non-zero vector of {0,1}^4.  For each
of the 15 non-zero masks v, a table keeps the positions whose vector has an odd
product with v and forgets the others.  Three differing positions span at most
three of the four dimensions, so some v is orthogonal to all three and that
table forgets exactly where the two differ: every linked pair meets in a bucket
of some table, with certainty.

A bucket of more than ``BUCKET`` different fingerprints is not compared; its
members are dealt again by a covering of the positions that its mask forgets.
Each such step halves the forgotten positions (32, 16, 8 at most), so the third
holds 2^8 fingerprints at most: no group is unbounded and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.graph import connected_components
from leafmill.llm.joins import join_groups
from leafmill.scratch import Scratch

SEED = 42
WORDS_PER_SHINGLE = 3
RADIUS = 3
BUCKET = 256
LAST_LEVEL = 2  # its masks forget 8 positions at most
_BLOCK = 1 << 16


def simhash(text: bytes, width: int = WORDS_PER_SHINGLE) -> int:
    """Fingerprint of a UTF-8 text, as an unsigned integer; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        h = np.array(
            [digest(flat[s:e], SEED) for s, e in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK], strict=True)],
            dtype="<u8",
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    over = (2 * set_bits > len(starts)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the fingerprint of the first column, the text, in its place."""
    for batch in batches:
        prints = [_signed(simhash(t.as_py() or b"")) for t in batch.column(0).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), *batch.columns[1:]], ["fp", *batch.schema.names[1:]])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """(fp, id, _0, _1, ...) for each row; fp is the fingerprint as a signed
    64-bit integer, the rest are the ``extra`` columns.

    A null or blank text gives 0.  Repeated rows give repeated results.
    """
    rows = df.select(
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{id_col}`").alias("id"),
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(extra)],
    )
    schema = T.StructType([T.StructField("fp", T.LongType()), *rows.schema.fields[1:]])
    return rows.mapInArrow(_fingerprint_batches, schema)


def _cover(positions: list[int], dims: int) -> list[int]:
    """Masks of kept positions, one for each non-zero v."""
    n = (1 << dims) - 1
    vector = {p: 1 + i % n for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, n + 1)]


@cache
def masks(level: int, radius: int = RADIUS) -> tuple[int, ...]:
    """The kept positions of each table of a level; table t of a level leads to
    tables t * n ... t * n + n - 1 of the next."""
    dims = radius + 1
    if level == 0:
        return tuple(_cover(list(range(64)), dims))
    return tuple(
        m | sub
        for m in masks(level - 1, radius)
        for sub in _cover([p for p in range(64) if not m >> p & 1], dims)
    )


def _links_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for prints in batch.column(0):
                x = np.unique(np.array(prints.as_py(), np.int64))
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
                root = np.arange(len(x))
                while True:  # each takes the least label of its neighbours
                    then = np.where(near, root[None, :], len(x)).min(axis=1)
                    if (then == root).all():
                        break
                    root = then
                hung = np.flatnonzero(root != np.arange(len(x)))
                a += x[hung].tolist()
                b += x[root[hung]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def link_forest(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly what links within ``radius`` connect.

    ``prints`` has distinct values in ``fp``.  Of each bucket a spanning forest
    is returned, at most one edge for each member.
    """
    per = (1 << (radius + 1)) - 1
    wanted = prints.selectExpr("fp", "0 as t").select("fp", "t")
    out: DataFrame | None = None
    level = 0
    while True:
        table = masks(level, radius)
        kept = F.array(*[F.lit(_signed(m)) for m in table]) if level == 0 else None
        if level == 0:
            keys = wanted.select("fp", F.posexplode(kept).alias("t", "mask"))
        else:
            lookup = F.lit([_signed(m) for m in table])
            keys = wanted.select("fp", F.explode(F.sequence(F.col("t") * per, F.col("t") * per + per - 1)).alias("t"))
            keys = keys.withColumn("mask", F.element_at(lookup, F.col("t") + 1))
        keys = keys.select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        last = level == LAST_LEVEL
        sizes = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = scratch.keep(sizes, f"sizes-{level}")
        shared = scratch.keep(join_groups(keys, sizes, ["t", "key"], "n", wanted.count() * per), f"shared-{level}")
        small = shared if last else shared.where(F.col("n") <= bucket)
        lists = small.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        edges = lists.mapInArrow(_links_batches(radius), "a long, b long")
        out = edges if out is None else out.unionByName(edges)
        large = shared.where(F.col("n") > bucket)
        if last or large.isEmpty():
            return out
        wanted = large.select("fp", "t")
        level += 1


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    bucket: int = BUCKET,
    extra: Sequence[str] = (),
    scratch: Scratch | None = None,
) -> DataFrame:
    """(id, fingerprint, component_id, group) for each row of ``df``, and its
    ``extra`` columns.

    Rows without words share fingerprint zero and link like any other.
    component_id is the least non-null id that links reach; null if there is
    none.  ``group`` is the least fingerprint that they reach, as a signed
    integer, and tells components apart whatever the ids.  Repeated rows come
    back as often.  An empty table gives an empty result.  The result reads
    tables in ``scratch``, which the caller may name to drop them.
    """
    scratch = scratch or Scratch(df.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(df, id_col, text_col, extra), "prints")
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    forest = link_forest(nodes.select("fp"), scratch, radius, bucket)
    roots = connected_components(forest, scratch)
    owned = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    owned = scratch.keep(owned, "owned")
    best = owned.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    labels = join_groups(owned, scratch.keep(best, "best"), ["root"], "members", owned.count())
    labels = scratch.keep(labels.select("fp", "n", "component_id", F.col("root").alias("group")), "labels")
    return join_groups(rows, labels, ["fp"], "n", rows.count()).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "group",
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(extra)],
    )
