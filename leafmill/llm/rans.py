"""Static range asymmetric numeral coding of token ids, vectorised over blocks.

A segment has one frequency table for all its blocks.  A block codes up to
``BLOCK`` ids in ``LANES`` interleaved lanes of 64-bit state, which give off
32-bit words.  The directory has a checkpoint for each block: where its words
begin, the states of its lanes, and a checksum of its ids.  So any block can be
decoded alone, and all of a segment are decoded in lockstep.

Layout, all little-endian: magic, u32 table bits, symbols, ids, blocks, steps;
u32 symbols, ascending; u32 frequencies; u32 words, then u32 CRC-32, of each
block; u64 lane states, block after block; u32 words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LMRANS01"
BLOCK = 1 << 14
LANES = 32
#: Ids below this are counted and looked up by tables, others by sorting.
DENSE = 1 << 22
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<5I")


def table(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, symbols, frequencies): counts scaled to sum to 2**bits, none to 0."""
    if ids.max() < DENSE:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    bits = max(12, int(len(symbols) - 1).bit_length() + 2)
    if bits > 24:
        raise ValueError("a segment has too many different ids")
    total = 1 << bits
    freqs = np.maximum(1, counts * total // counts.sum())
    over = int(freqs.sum()) - total
    for i in np.argsort(-freqs, kind="stable"):
        if over == 0:
            break
        cut = min(over, int(freqs[i]) // 2) if over > 0 else over
        freqs[i] -= cut
        over -= cut
    return bits, symbols.astype(np.uint32), freqs.astype(np.uint32)


def encode(ids: np.ndarray) -> bytes:
    """A segment of any number of ids below 2**32."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if not n:
        return MAGIC + _HEAD.pack(0, 0, 0, 0, 0)
    bits, symbols, freqs = table(ids)
    blocks = -(-n // BLOCK)
    steps = -(-min(n, BLOCK) // LANES)
    padded = np.full(blocks * steps * LANES, np.argmax(freqs), np.int64)
    if symbols[-1] < DENSE:
        places = np.zeros(int(symbols[-1]) + 1, np.int32)
        places[symbols] = np.arange(len(symbols))
        padded[:n] = places[ids]  # of several blocks, steps * LANES is BLOCK
    else:
        padded[:n] = np.searchsorted(symbols, ids)
    grid = padded.reshape(blocks, steps, LANES)
    wide = freqs.astype(np.uint64)
    base = np.cumsum(wide) - wide
    shift, limit = np.uint64(bits), np.uint64(63 - bits)
    x = np.full((blocks, LANES), _LOW, np.uint64)
    words = np.zeros((steps, blocks, LANES), np.uint32)
    given = np.zeros((steps, blocks, LANES), bool)
    for t in range(steps - 1, -1, -1):
        f = wide[grid[:, t]]
        full = x >= f << limit
        words[t] = x.astype(np.uint32)
        given[t] = full
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << shift) + (x - q * f) + base[grid[:, t]]
    stream = words.transpose(1, 0, 2)[given.transpose(1, 0, 2)]
    sizes = given.sum(axis=(0, 2), dtype=np.uint32)
    sums = np.array([zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(blocks)], "<u4")
    return b"".join(
        [
            MAGIC,
            _HEAD.pack(bits, len(symbols), n, blocks, steps),
            *(a.astype(k).tobytes() for a, k in ((symbols, "<u4"), (freqs, "<u4"), (sizes, "<u4"), (sums, "<u4"), (x, "<u8"), (stream, "<u4"))),
        ]
    )


def decode(data: bytes, only: slice = slice(None)) -> np.ndarray:
    """The ids of a segment, or those of some of its blocks.  Raises ValueError
    if a block's checksum or the layout is wrong."""
    head = len(MAGIC)
    if data[:head] != MAGIC:
        raise ValueError("not a segment of token ids")
    bits, n_symbols, n, blocks, steps = _HEAD.unpack_from(data, head)
    at = head + _HEAD.size
    parts = []
    for kind, count in (("<u4", n_symbols), ("<u4", n_symbols), ("<u4", blocks), ("<u4", blocks), ("<u8", blocks * LANES)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    symbols, freqs, sizes, sums, states = parts
    stream = np.concatenate([np.frombuffer(data, "<u4", int(sizes.sum()), at), np.zeros(1, "<u4")]).astype(np.uint64)
    chosen = np.arange(blocks)[only]
    if not len(chosen):
        return np.zeros(0, "<u4")
    wide = freqs.astype(np.uint64)
    base = np.cumsum(wide) - wide
    slots = np.repeat(np.arange(n_symbols, dtype=np.uint32), freqs)
    x = states.reshape(blocks, LANES)[chosen]
    next_word = (np.cumsum(sizes, dtype=np.int64) - sizes)[chosen]
    out = np.empty((len(chosen), steps, LANES), np.uint32)
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    for t in range(steps):
        slot = x & mask
        s = slots[slot]
        out[:, t] = s
        x = wide[s] * (x >> shift) + slot - base[s]
        short = x < _LOW
        rank = np.cumsum(short, axis=1)
        where = np.where(short, np.minimum(next_word[:, None] + rank - 1, len(stream) - 1), 0)
        x = np.where(short, x << np.uint64(32) | stream[where], x)
        next_word = next_word + rank[:, -1]
    lengths = np.minimum(BLOCK, n - chosen * BLOCK)
    rows = symbols[out.reshape(len(chosen), -1)]
    pieces = [rows[i, : lengths[i]].astype("<u4") for i in range(len(chosen))]
    for b, ids in zip(chosen, pieces, strict=True):
        if zlib.crc32(ids.tobytes()) != sums[b]:
            raise ValueError(f"block {b} does not match its checksum")
    return np.concatenate(pieces)
