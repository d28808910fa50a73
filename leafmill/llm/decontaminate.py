"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns the corpus into segments, one row each: a term
dictionary, the number of postings of each term, and all their positions.
Positions number the words of a segment, with a gap between documents that no
phrase can bridge.  Documents never span segments, so nothing is shuffled and a
lost executor costs a re-read of the segments it held.

A search orders the terms of each phrase by their frequency in the whole index,
takes up the phrase only in segments that hold its rarest term, and intersects
the other terms' positions, less their offsets, rarest first.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.scratch import Scratch

WINDOW = 13
SEGMENT_BYTES = 2 << 20
#: Phrases searched in one pass over the index; more take further passes.
PHRASES_PER_PASS = 200_000
GAP = 64
_SPLIT = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of digits, a-z and everything beyond ASCII."""
    return text.translate(_SPLIT).split() if text else []


def _packed(data: bytes) -> bytes:
    """Compressed here, as Parquet would take all rows of a file for one page,
    and buffers of its size outside the heap."""
    return struct.pack("<I", len(data)) + pa.compress(data, codec="lz4", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    size = struct.unpack_from("<I", data)[0]
    return pa.decompress(data[4:], decompressed_size=size, codec="lz4", asbytes=True) if size else b""


def index_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("n_words", T.ArrayType(T.IntegerType())),
            T.StructField("terms", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
            T.StructField("postings", T.BinaryType()),
        ]
    )


def _segment(number: int, ids: list, docs: list[np.ndarray], numbers: dict[bytes, int], id_type: pa.DataType) -> pa.RecordBatch:
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    terms = np.concatenate(docs)
    total = len(terms)
    bases = np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]])
    places = np.arange(total) + np.repeat(bases - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    order = np.argsort(terms, kind="stable")
    counts = np.bincount(terms, minlength=len(numbers)).astype("<u4")
    places = places[order]
    steps = np.diff(places, prepend=0)
    firsts = np.cumsum(counts) - counts
    steps[firsts] = places[firsts]
    planes = steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
    row = {
        "segment": pa.array([number], pa.int64()),
        "ids": pa.array([ids], pa.list_(id_type)),
        "n_words": pa.array([lengths.tolist()], pa.list_(pa.int32())),
        "terms": pa.array([_packed(b" ".join(numbers))], pa.binary()),
        "counts": pa.array([counts.tobytes()], pa.binary()),
        "postings": pa.array([_packed(planes.tobytes())], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(row)


def _segments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        docs: list[np.ndarray] = []
        numbers: dict[bytes, int] = {}
        held, id_type = 0, None
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                text = t.as_py()
                ids.append(i.as_py())
                take = numbers.setdefault
                docs.append(np.array([take(w, len(numbers)) for w in words_of(text)], np.int32))
                held += len(text or b"")
                if held >= size:
                    yield _segment(number, ids, docs, numbers, id_type)
                    ids, docs, numbers, held, number = [], [], {}, 0, number + 1
        if ids:
            yield _segment(number, ids, docs, numbers, id_type)

    return run


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of the index over all rows.  Null texts are documents without
    words, null and repeated ids are kept as they are."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_segments(size), index_schema(rows.schema["id"].dataType))


class Segment:
    """One row of the index, with postings decoded on demand."""

    def __init__(self, row: dict):
        self.ids, self.n_words = row["ids"], row["n_words"]
        self.counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self.ends = np.cumsum(self.counts)
        planes = np.frombuffer(_unpacked(row["postings"]), np.uint8).reshape(4, -1)
        self.steps = np.ascontiguousarray(planes.T).view("<u4").ravel()
        terms = _unpacked(row["terms"])
        self.numbers = {w: i for i, w in enumerate(terms.split(b" "))} if terms else {}
        self.bases = np.concatenate([[0], np.cumsum(np.array(self.n_words, np.int64) + GAP)[:-1]])
        self._lists: dict[bytes, np.ndarray] = {}

    def postings(self, term: bytes) -> np.ndarray:
        if term not in self._lists:
            i = self.numbers[term]
            self._lists[term] = np.cumsum(self.steps[self.ends[i] - self.counts[i] : self.ends[i]], dtype=np.int64)
        return self._lists[term]

    def phrase(self, terms: tuple[bytes, ...], order: tuple[int, ...]) -> np.ndarray:
        """Positions at which the phrase begins."""
        if any(terms[k] not in self.numbers for k in order):
            return np.zeros(0, np.int64)
        found = self.postings(terms[order[0]]) - order[0]
        for k in order[1:]:
            there = self.postings(terms[k])
            at = np.searchsorted(there, found + k)
            found = found[there[np.minimum(at, len(there) - 1)] == found + k]
            if not len(found):
                break
        return found

    def near(self, terms: tuple[bytes, ...], order: tuple[int, ...], slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term within ``slop`` words."""
        if any(terms[k] not in self.numbers for k in order):
            return np.zeros(0, np.int64)
        found = self.postings(terms[order[0]])
        for k in order[1:]:
            there = self.postings(terms[k])
            first = self.bases[self.document(found)]  # no document is left, however wide the slop
            last = first + np.array(self.n_words, np.int64)[self.document(found)] - 1
            low, high = np.maximum(found - slop, first), np.minimum(found + slop, last)
            found = found[np.searchsorted(there, high, "right") > np.searchsorted(there, low)]
        return found

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, places, "right") - 1


def _frequencies(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = wanted.value
        sums: Counter = Counter()
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1), strict=True):
                counts = np.frombuffer(c.as_py(), "<u4").tolist()
                for w, n in zip(_unpacked(t.as_py()).split(b" ") if counts else (), counts, strict=True):
                    if w in terms:
                        sums[w] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["term", "n"]
        )

    return run


def frequencies(index: DataFrame, terms: Iterable[bytes]) -> dict[bytes, int]:
    """How often each of these terms occurs in the whole index."""
    wanted = index.sparkSession.sparkContext.broadcast(frozenset(terms))
    counted = index.select("terms", "counts").mapInArrow(_frequencies(wanted), "term binary, n long")
    return {bytes(r.term): r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


_HITS = ("segment", "row", "id", "starts", "stops", "items")


def _searcher(plan, slop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rarest = plan.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                seg = Segment(row)
                found: dict[int, tuple[list[int], list[int], set[str]]] = {}
                for term in by_rarest.keys() & seg.numbers.keys():
                    for terms, order, names in by_rarest[term]:
                        if slop is None:
                            places, width = seg.phrase(terms, order), len(terms)
                        else:
                            places, width = seg.near(terms, order, slop), 1
                        for d, at in zip(seg.document(places).tolist(), places.tolist(), strict=True):
                            starts, stops, items = found.setdefault(d, ([], [], set()))
                            starts.append(int(at - seg.bases[d]))
                            stops.append(int(at - seg.bases[d] + width))
                            items.update(names)
                docs = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * len(docs), pa.int64()),
                        pa.array(docs, pa.int32()),
                        pa.array([row["ids"][d] for d in docs], batch.column("ids").type.value_type),
                        pa.array([found[d][0] for d in docs], pa.list_(pa.int32())),
                        pa.array([found[d][1] for d in docs], pa.list_(pa.int32())),
                        pa.array([sorted(found[d][2]) for d in docs], pa.list_(pa.string())),
                    ],
                    list(_HITS),
                )

    return run


def search(
    index: DataFrame,
    phrases: dict[tuple[bytes, ...], set[str]],
    slop: int | None = None,
    per_pass: int = PHRASES_PER_PASS,
) -> Iterator[DataFrame]:
    """Matches of phrases, a DataFrame for each pass of ``per_pass`` of them.

    A pass has one row for each document with a match: (segment, row, id, starts,
    stops, items), the word ranges that match and the names of their phrases.
    ``slop`` None asks for exact phrases, else for the places of each phrase's
    rarest term that have all its other terms within ``slop`` words.
    """
    context = index.sparkSession.sparkContext
    names = list(phrases)
    id_type = index.schema["ids"].dataType.elementType
    out = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("row", T.IntegerType()),
            T.StructField("id", id_type),
            T.StructField("starts", T.ArrayType(T.IntegerType())),
            T.StructField("stops", T.ArrayType(T.IntegerType())),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    for at in range(0, max(1, len(names)), per_pass):
        part = names[at : at + per_pass]
        often = frequencies(index, {w for p in part for w in p}) if part else {}
        plan: dict[bytes, list] = {}
        for p in part:
            order = tuple(sorted(range(len(p)), key=lambda k: (often.get(p[k], 0), k)))  # noqa: B023
            if often.get(p[order[0]], 0):
                plan.setdefault(p[order[0]], []).append((p, order, tuple(sorted(phrases[p]))))
        yield index.mapInArrow(_searcher(context.broadcast(plan), slop), out)


def windows(items: Iterable[tuple[object, bytes | None]], width: int = WINDOW) -> dict[tuple[bytes, ...], set[str]]:
    """The windows of test items with the items that hold them.  An item of
    fewer words, but not none, is one window; a null id is named ``null``."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            out.setdefault(tuple(words[i : i + width]), set()).add("null" if item is None else str(item))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments with the matches in them, a row for each document."""
    for batch in batches:
        for k in range(batch.num_rows):
            n_words = batch.column("n_words")[k].values
            n_hit, n_items = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
            digests = [hashlib.sha256(b"").hexdigest()] * len(n_words)
            ranges: dict[int, list] = {}
            items: dict[int, set] = {}
            for m in batch.column("matches")[k].as_py() or ():
                ranges.setdefault(m["row"], []).extend(zip(m["starts"], m["stops"], strict=True))
                items.setdefault(m["row"], set()).update(m["items"])
            for d, found in ranges.items():
                end = 0
                for s, e in sorted(found):
                    n_hit[d] += max(0, e - max(s, end))
                    end = max(end, e)
                n_items[d] = len(items[d])
                digests[d] = hashlib.sha256(",".join(sorted(items[d])).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ids")[k].values,
                    n_words.cast(pa.int64()),
                    pa.array(n_hit),
                    pa.array(n_items),
                    pa.array(digests, pa.string()),
                ],
                ["id", "n_words", "n_hit", "n_items", "items_sha256"],
            )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    per_pass: int = PHRASES_PER_PASS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row.

    A word is hit if it lies in an occurrence of any window of any item; a
    document is contaminated if a twentieth of its words or more, and at least
    one, are hit.  Items are streamed to the driver and searched in passes of
    ``per_pass`` distinct windows, so no broadcast grows beyond that.  Null
    texts have no words; null ids and repeated rows are judged like others.
    Extra columns are not looked at.  Empty tables on either side are fine.
    The result reads tables in ``scratch``, which the caller may name to drop
    them.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    index = scratch.keep(build_index(docs, id_col, text_col), "index", "none")
    id_type = docs.schema[id_col].dataType
    judged = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("n_items", T.LongType()),
            T.StructField("items_sha256", T.StringType()),
        ]
    )
    passes: list[DataFrame] = []

    def take(phrases: dict[tuple[bytes, ...], set[str]]) -> None:
        for found in search(index, phrases, None, per_pass * 2):
            passes.append(scratch.keep(found, f"pass-{len(passes)}"))

    held: dict[tuple[bytes, ...], set[str]] = {}
    for row in benchmark.select(F.col(f"`{item_col}`"), F.col(f"`{item_text_col}`")).toLocalIterator():
        text = None if row[1] is None else str(row[1]).encode()
        for window, names in windows([(row[0], text)], width).items():
            held.setdefault(window, set()).update(names)
        if len(held) >= per_pass:
            take(held)
            held = {}
    if held or not passes:
        take(held)
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    # What matches in a segment is bounded by the segment.
    matches = every.groupBy("segment").agg(F.collect_list(F.struct("row", "starts", "stops", "items")).alias("matches"))
    rows = index.select("segment", "ids", "n_words").join(matches, "segment", "left").select("ids", "n_words", "matches")
    return rows.mapInArrow(_digest, judged).select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        "n_items",
        "items_sha256",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
