"""Token-id output: documents as one sequence of ids in coded segments.

Documents are dealt to shards by ranges of doc_id and encoded in that order,
each ended by ``END``.  A shard is a run of segments (see ``rans``), written
through Spark as Parquet rows that hold a segment's bytes and its directory of
documents, so they lie in any store that Spark writes, and every segment can be
read back, checked and decoded by itself.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm import rans
from leafmill.scratch import Scratch, partitions_for

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 0
SEGMENT_IDS = 1 << 20
#: Text that is cut and encoded at a time; a longer one goes alone.
PIECE_BYTES = 2 << 20
#: Different parts that go to the library in one string, and strings in a call.
TOGETHER = 256
STRINGS = 16
#: Parts whose ids a worker remembers, some 30 bytes each.
REMEMBERED = 200_000
_SPACE, _BREAK, _LETTER, _DIGIT, _QUOTE, _MARK, _OTHER, _ODD = range(8)
#: Parts that may stand in a list of lines: a space at most, then neither white
#: space nor a character that might be taken for some.
_LINE = r"^ ?[^\x00-\x20\x7f-\x{bf}\x{1000}-\x{3fff}]+$"


def _byte_kinds() -> np.ndarray:
    """Kind of a character by its first byte.  Only what is plain is told apart:
    ``_OTHER`` is no white space, ``_ODD`` might be anything."""
    out = np.full(256, _ODD, np.uint8)
    out[0x21:0x7F] = _MARK
    out[0xC4:0xE1] = out[0xE4:0xF5] = _OTHER
    for kind, chars in ((_SPACE, b" "), (_BREAK, b"\t\n\r"), (_QUOTE, b"'"), (_DIGIT, b"0123456789")):
        out[list(chars)] = kind
    out[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
    out[[0xC3, 0xC4, 0xC5]] = _LETTER  # but for two signs, see ``_kinds``
    return out


def _cut_table() -> np.ndarray:
    """By the kinds of two neighbours: 1 where a piece always ends between them,
    2 where it does if the first is a break that stands alone."""
    out = np.zeros((8, 8), np.uint8)
    out[[_LETTER, _DIGIT, _QUOTE, _MARK, _OTHER], _SPACE] = 1
    out[[_LETTER, _DIGIT, _QUOTE, _MARK, _OTHER], _BREAK] = 1
    out[_LETTER, [_DIGIT, _QUOTE, _MARK]] = 1
    out[_DIGIT, [_LETTER, _QUOTE, _MARK]] = 1
    out[_MARK, [_LETTER, _DIGIT]] = 1
    out[_QUOTE, _DIGIT] = 1
    out[_BREAK, [_LETTER, _DIGIT, _QUOTE, _MARK, _OTHER]] = 2
    return out.ravel()


_BYTE_KINDS, _CUT_TABLE = _byte_kinds(), _cut_table()


def _kinds(raw: np.ndarray) -> np.ndarray:
    """Kind of each byte's character."""
    kinds = _BYTE_KINDS[raw]
    tails = np.flatnonzero((raw & 0xC0) == 0x80)
    if len(tails):
        last, before = raw[tails], raw[tails - 1]
        signs = tails[((last == 0x97) | (last == 0xB7)) & (before == 0xC3)]
        kinds[signs - 1] = _OTHER
        for _ in range(3):  # a character has three more bytes at most
            kinds[tails] = kinds[tails - 1]
    return kinds


def _cuts(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Mask of the bytes before which pre-tokenization always starts anew."""
    out = np.zeros(len(raw), bool)
    found = _CUT_TABLE[kinds[:-1] * np.uint8(8) + kinds[1:]]
    out[1:] = found == 1
    lone = np.flatnonzero(found == 2)
    before = kinds[np.maximum(lone - 1, 0)]
    lone = lone[(lone == 0) | (before != _SPACE) & (before != _BREAK) & (before != _ODD)]
    out[lone + 1] = True
    return out


class Encoder:
    """Whole texts to ids, by the tokenizers library.

    Byte-level pre-tokenization cuts a text into pieces of letters, of digits,
    of other signs and of white space, each but the last with the one space
    before it.  Where such a piece must end whatever stands around it, texts
    are cut here, by tables of byte kinds; where that is in doubt they are not.
    The parts of many texts are told apart by Arrow, and only the different
    ones go to the library: most of them as lines of one string, whose ids the
    id of a line's end keeps apart.  The ids of texts are put together from
    those of their parts.  Parts that come first are remembered in Arrow arrays.

    A text that spells an added token is one part.  With a tokenizer of another
    kind every text is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core, and each thread holds memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        self.cuts = (
            made.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
        )
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        line = self._ids(["\n"])[0]
        self.line = int(line[0]) if len(line) == 1 else None
        self.known = pa.array([], pa.large_string())
        self.known_ids, self.known_sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), STRINGS):
            out += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[at : at + STRINGS], add_special_tokens=False)]
        return out

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; their numbers)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = self._spells(texts)
        _, places, data = texts.buffers()
        bounds = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(raw):
            return np.full(len(texts), end, "<u4"), np.ones(len(texts), np.int64)
        if self.cuts:
            mask = _cuts(raw, _kinds(raw))
            for i in np.flatnonzero(whole):
                mask[bounds[i] : bounds[i + 1]] = False
        else:
            mask = np.zeros(len(raw), bool)
        mask[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(mask)
        buffers = [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)]
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        flat, sizes = self._encode(parts.dictionary.cast(pa.large_string()))

        # Each text's parts, then ``end``, which is the last entry of the dictionary.
        flat, sizes = np.append(flat, np.uint32(end)), np.append(sizes, 1)
        stops = np.searchsorted(starts, bounds[1:])
        codes = np.insert(parts.indices.to_numpy(), stops, len(sizes) - 1)
        counts = sizes[codes]
        ends = np.cumsum(counts)
        ids = flat[_ranges((np.cumsum(sizes) - sizes)[codes], counts)]
        return ids, np.diff(ends[stops + np.arange(len(stops))], prepend=0)

    def _spells(self, texts: pa.Array) -> np.ndarray:
        """Which texts have an added token in them."""
        out = np.zeros(len(texts), bool)
        for token in self.added:
            out |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return out

    def _encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, one after the other; their numbers)."""
        at = pc.index_in(parts, value_set=self.known)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        fresh = parts.filter(pa.array(new))
        ids, sizes = self._ask(fresh)
        # Old and new ids in one store, from which every part takes its own.
        codes = np.empty(len(parts), np.int64)
        codes[new] = len(self.known) + np.arange(len(fresh))
        codes[~new] = at.drop_null().to_numpy()
        store, all_sizes = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_sizes, sizes])
        room = min(REMEMBERED - len(self.known), len(fresh))
        if room > 0:
            self.known = pa.concat_arrays([self.known, fresh.slice(0, room)])
            self.known_sizes = all_sizes[: len(self.known)]
            self.known_ids = store[: int(self.known_sizes.sum())]
        counts = all_sizes[codes]
        return store[_ranges((np.cumsum(all_sizes) - all_sizes)[codes], counts)], counts

    def _ask(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their numbers) of parts, from the library."""
        lines = pc.match_substring_regex(parts, _LINE).to_numpy(zero_copy_only=False) & ~self._spells(parts)
        if self.line is None or not self.cuts:
            lines[:] = False
        sizes = np.zeros(len(parts), np.int64)
        found = [np.zeros(0, "<u4")]
        index = np.flatnonzero(lines)
        words = parts.take(pa.array(index)).to_pylist()
        if words:
            found += self._ids(["\n".join(words[i : i + TOGETHER]) + "\n" for i in range(0, len(words), TOGETHER)])
            ids = np.concatenate(found)
            stops = np.flatnonzero(ids == self.line)
            sizes[index] = np.diff(stops, prepend=-1) - 1
            found = [ids[ids != self.line]]
        rest = np.flatnonzero(~lines)
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            rows = self._ids(parts.take(pa.array(some)).to_pylist())
            sizes[some] = [len(x) for x in rows]
            found += rows
        # So far lines come before the rest.
        order = np.concatenate([index, rest])
        n = sizes[order]
        firsts = np.empty(len(parts), np.int64)
        firsts[order] = np.cumsum(n) - n
        return np.concatenate(found)[_ranges(firsts, sizes)], sizes


def _ranges(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[0], firsts[0] + 1, ... for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(firsts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some ``size`` bytes of text, but a row at least."""
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(held):
        stop = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + size, "right")))
        yield at, stop
        at = stop


def _file_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("segment", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("docs", T.ArrayType(id_type)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("data", T.BinaryType()),
        ]
    )


def _writer(path: str, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        shard = TaskContext.get().partitionId()
        segment, first, held, id_type = 0, 0, 0, None
        docs: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            values = [shard, segment, first, len(flat), docs, lengths, rans.encode(flat)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "segment", "first", "n_ids", "docs", "lengths", "data"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at, stop in _pieces(batch.column(1), PIECE_BYTES):
                flat, counts = encode(batch.column(1).slice(at, stop - at), end)
                left = 0
                for i, n in zip(batch.column(0).slice(at, stop - at).to_pylist(), counts.tolist(), strict=True):
                    docs.append(i)
                    lengths.append(n)
                    parts.append(flat[left : left + n])
                    held, left = held + n, left + n
                    if held >= size:
                        yield row()
                        docs, lengths, parts, segment, first, held = [], [], [], segment + 1, first + held, 0
                parts = [np.concatenate(parts)] if parts else []  # frees the piece's other ids
        if docs:
            yield row()

    return run


def write(
    df: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    end: int = END,
    size: int = SEGMENT_IDS,
    name: str = "tokens",
) -> DataFrame:
    """Writes the files and returns a scan of them.

    Order: ascending id, then null ids; rows of one id by a hash of the text.
    Null texts are empty; each row is a document.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order)
    return scratch.keep(dealt.mapInArrow(_writer(tokenizer, end, size), _file_schema(rows.schema["id"].dataType)), name, "none")


def _reader(bases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                ids = rans.decode(row["data"].as_py())
                lengths = np.array(row["lengths"].as_py(), np.int64)
                stops = np.cumsum(lengths)
                starts = stops - lengths
                sums = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, stops, strict=True)]
                base = bases.value[row["shard"].as_py()] + row["first"].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        row["docs"].values,
                        pa.array(starts + base, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                        pa.array(np.full(len(lengths), row["shard"].as_py()), pa.int32()),
                        pa.array(np.full(len(lengths), row["segment"].as_py()), pa.int32()),
                    ],
                    ["id", "start", "n_tokens", "ids_crc32", "shard", "segment"],
                )

    return run


def read(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32, shard, segment) for each document,
    decoded from the files.  The driver holds one number for each shard."""
    spark = files.sparkSession
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    ends = np.cumsum([r.n for r in sizes]).tolist()
    bases = {r.shard: e - r.n for r, e in zip(sizes, ends, strict=True)}
    schema = T.StructType(
        [
            T.StructField("id", files.schema["docs"].dataType.elementType),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("segment", T.IntegerType()),
        ]
    )
    columns = ["shard", "segment", "first", "docs", "lengths", "data"]
    return files.select(columns).mapInArrow(_reader(spark.sparkContext.broadcast(bases)), schema).withColumnRenamed("id", id_col)


def token_output(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Encodes, writes and reads back all rows; see ``write`` and ``read``.  An
    empty table gives empty files and an empty result."""
    return read(write(df, Scratch(df.sparkSession, "tokens"), id_col, text_col, tokenizer), id_col)
