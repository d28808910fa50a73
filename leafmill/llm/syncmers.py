"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least of its s-mers, by hash,
is its first or its last.  Whether it is depends on its own characters alone,
so an edit moves no anchor that does not overlap it.  ``anchors`` returns the
syncmers with their places.  ``align`` matches those of two texts by hash and
place: runs of neighbours that keep their distance are shared passages, wherever
they lie.  ``sketch`` keeps for each of ``SLOTS`` classes of syncmers the least
hash (one-permutation minwise hashing); the share of slots in which two sketches
agree, among those that either fills, estimates the Jaccard likeness of the
texts' syncmer sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.scratch import Scratch, partitions_for

K = 16
S = 6
SLOTS = 128
#: Code points that are hashed at a time; texts of any length are.
_BLOCK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` code points."""
    out = np.zeros(len(codes) - width + 1, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for i in range(width):
        out = out * step + codes[i : i + len(out)]
    return _mix(out)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the closed syncmers.  A text of fewer than k code
    points, but not none, is one anchor at 0; an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(codes) < k:
        return np.zeros(1, np.int64), _rolling(codes, len(codes))
    places, hashes = [], []
    inner = k - s + 1
    for at in range(0, len(codes) - k + 1, _BLOCK):
        part = codes[at : at + _BLOCK + k - 1]
        small = _rolling(part, s)
        least = _window_min(small, inner)
        n = len(least)
        chosen = np.flatnonzero((small[:n] == least) | (small[inner - 1 : inner - 1 + n] == least))
        places.append(chosen + at)
        hashes.append(_rolling(part, k)[chosen])
    return np.concatenate(places), np.concatenate(hashes)


Anchors = tuple[np.ndarray, np.ndarray]


def _turns(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, the hashes in it, and how many equal ones came before."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    return order, sorted_, np.arange(len(sorted_)) - np.searchsorted(sorted_, sorted_)


def align(a: Anchors, b: Anchors, size: int, k: int = K) -> list[tuple[int, int, int]]:
    """Passages that two texts share: (start in a, start in b, length), in order
    of the first.  ``size`` is the length of the first text.

    The n-th anchor of a hash meets the n-th of the other text; neighbours in
    both that lie equally far apart belong to one passage.  No pair of repeated
    anchors is tried twice, so the work is that of sorting them.
    """
    (order_a, hash_a, turn_a), (order_b, hash_b, turn_b) = _turns(a[1]), _turns(b[1])
    at = np.searchsorted(hash_b, hash_a) + turn_a
    met = at < len(hash_b)
    met[met] = hash_b[at[met]] == hash_a[met]
    i, j = order_a[met], order_b[at[met]]
    by = np.argsort(i)
    i, j = i[by], j[by]
    if not len(i):
        return []
    shift = b[0][j] - a[0][i]
    apart = (np.diff(i) != 1) | (np.diff(j) != 1) | (np.diff(shift) != 0)
    first = np.concatenate([[0], np.flatnonzero(apart) + 1])
    last = np.concatenate([first[1:] - 1, [len(i) - 1]])
    starts, ends = a[0][i[first]], np.minimum(a[0][i[last]] + k, size)
    return list(zip(starts.tolist(), (starts + shift[first]).tolist(), (ends - starts).tolist(), strict=True))


def covered(passages: list[tuple[int, int, int]]) -> int:
    """Code points of the first text that lie in any passage."""
    out = end = 0
    for start, _, length in passages:
        out += max(0, start + length - max(start, end))
        end = max(end, start + length)
    return out


def sketch(found: Anchors, slots: int = SLOTS) -> np.ndarray:
    """``slots`` 16-bit values of a text's anchors; 0 marks a slot without one.

    A slot's value is drawn from its least hash by mixing, so two different
    least hashes agree by chance once in 65,535.
    """
    least = np.full(slots, ~np.uint64(0))
    hashes = found[1]
    np.minimum.at(least, (hashes % np.uint64(slots)).astype(np.int64), hashes)
    values = (_mix(least) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)
    return np.where(least == ~np.uint64(0), np.uint16(0), values)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the slots that either fills in which both agree; 1 if both are empty."""
    filled = (a != 0) | (b != 0)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def fingerprint(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


def parse(x: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(x), ">u2").astype(np.uint16)


def _edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_PAIR = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "aligned_edited", "aligned_next"]


def _compare(text: str, own: tuple[Anchors, np.ndarray], following: str, next_: tuple[Anchors, np.ndarray]) -> tuple:
    new = _edited(text, following)
    found = anchors(new)
    changed = sketch(found)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return (
        len(text), sha, fingerprint(own[1]), fingerprint(changed), likeness(own[1], changed), likeness(own[1], next_[1]),
        covered(align(own[0], found, len(text))), covered(align(own[0], next_[0], len(text))),
    )


def _taken(text: str) -> tuple[Anchors, np.ndarray]:
    found = anchors(text)
    return found, sketch(found)


def _record(ids: list, rows: list[tuple], id_type: pa.DataType, part: int, edge: list, texts: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_PAIR)
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, id_type),
            *(pa.array(c, t) for c, t in zip(columns, types, strict=True)),
            pa.array([part] * len(ids), pa.int32()),
            pa.array(edge, pa.string()),
            pa.array(texts, pa.string()),
        ],
        ["id", *_PAIR, "part", "edge", "text"],
    )


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each compared with its successor.  The first
    text, and the last one's, which has its successor elsewhere, go out as
    ``first`` and ``last`` rows."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None
    nothing = (None,) * len(_PAIR)
    id_type = None
    for batch in batches:
        id_type = batch.schema.field(0).type
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            ids, rows = [], []
            for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                text = t or ""
                now = (i, text, _taken(text))
                if held is None:
                    yield _record([i], [nothing], id_type, part, ["first"], [text])
                else:
                    ids.append(held[0])
                    rows.append(_compare(held[1], held[2], text, now[2]))
                held = now
            yield _record(ids, rows, id_type, part, [None] * len(ids), [None] * len(ids))
    if held is not None:
        yield _record([held[0]], [nothing], id_type, part, ["last"], [held[1]])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        rows = []
        for text, following in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text, following = text or "", following or ""
            rows.append(_compare(text, _taken(text), following, _taken(following)))
        full = _record(ids.to_pylist(), rows, ids.type, 0, [None] * len(ids), [None] * len(ids))
        yield full.select(["id", *_PAIR])


def _schema(id_field: T.StructField, whole: bool) -> T.StructType:
    kinds = [T.LongType(), *[T.StringType()] * 3, *[T.DoubleType()] * 2, *[T.LongType()] * 2]
    fields = [id_field, *(T.StructField(n, k) for n, k in zip(_PAIR, kinds, strict=True))]
    rest = [("part", T.IntegerType()), ("edge", T.StringType()), ("text", T.StringType())]
    return T.StructType(fields + [T.StructField(n, k) for n, k in rest if whole])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, n_anchors) of each row; null texts read as empty."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([fingerprint(sketch(x)) for x in found], pa.string()),
                    pa.array([len(x[0]) for x in found], pa.int64()),
                ],
                ["id", "fingerprint", "n_anchors"],
            )

    schema = T.StructType([rows.schema["id"], T.StructField("fingerprint", T.StringType()), T.StructField("n_anchors", T.LongType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its edited text and its successor's:
    how alike they are, and how many code points of the text lie in passages that
    it shares with the other, by their anchors' places.

    Successors follow in descending id, null ids last, rows of one id by a hash
    of the text; the first row follows the last.  The edited text has its last
    floor(n/2) code points replaced by the first as many of the successor, or
    all of it.  A single row is its own successor.  Null texts are empty.

    Texts are shuffled once, by ranges of the id.  Only the two texts at the
    ends of each partition meet others', in a second pass over those alone.
    """
    scratch = Scratch(df.sparkSession, "syncmers")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order)
    done = scratch.keep(dealt.mapInArrow(_within, _schema(rows.schema["id"], True)), "partitions", "zstd")
    ends = done.where("edge is not null")
    # One number for each partition that has rows; the text itself stays put.
    parts = ends.where("edge = 'first'").select("part")
    ring = parts.withColumn("follows", F.lead("part").over(Window.orderBy("part")))
    ring = ring.withColumn("follows", F.coalesce("follows", F.min("part").over(Window.partitionBy())))
    last = ends.where("edge = 'last'").join(ring, "part").select("id", "text", "follows")
    first = ends.where("edge = 'first'").select(F.col("part").alias("follows"), F.col("text").alias("following"))
    met = last.join(first, "follows").select("id", "text", "following")
    out = _schema(rows.schema["id"], False)
    across = met.mapInArrow(_across, out)
    return done.where("edge is null").select(*out.names).unionByName(across).withColumnRenamed("id", id_col)
