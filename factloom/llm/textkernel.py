"""Vectorised word splitting and hashing over Arrow string buffers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Spans over this many bytes are hashed and compared one at a time.
LONG = 4096


def fmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def byte_table(word_bytes) -> np.ndarray:
    """Boolean table of the bytes that belong to words."""
    out = np.zeros(256, dtype=bool)
    out[list(word_bytes)] = True
    return out


#: Bytes outside 0x20 and 0x09-0x0D.
NON_SPACE = byte_table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) over runs of rows of at most ``limit`` bytes, one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, never across rows."""
    inside = table[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cut = offsets[1:-1]
        before[cut[cut < len(inside)]] = False
        after[cut[cut > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each span's bytes: a chain of mixed blocks of eight bytes.

    Equal spans have equal fingerprints.  Spans of one length up to eight bytes never
    share one (every step is a bijection of the block); spans over ``LONG`` bytes are
    hashed by blake2b, one at a time.
    """
    length = ends - starts
    out = fmix(length.astype(np.uint64) + U64(0x9E3779B97F4A7C15))
    blocks = _blocks(data)
    live, at = np.flatnonzero((length > 0) & (length <= LONG)), 0
    while len(live):
        block = blocks[starts[live] + at] & _MASKS[np.minimum(length[live] - at, 8)]
        out[live] = fmix((out[live] ^ block) * U64(0x9E3779B97F4A7C15) + U64(0xD6E8FEB86659FD93))
        at += 8
        live = live[length[live] > at]
    for i in np.flatnonzero(length > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each span holds the same bytes as the span number ``others`` of the same arrays."""
    length = ends - starts
    same = length == length[others]
    blocks = _blocks(data)
    live, at = np.flatnonzero(same & (others != np.arange(len(starts))) & (length <= LONG)), 0
    while len(live):
        mask = _MASKS[np.minimum(length[live] - at, 8)]
        equal = (blocks[starts[live] + at] ^ blocks[starts[others[live]] + at]) & mask == 0
        same[live[~equal]] = False
        at += 8
        live = live[equal & (length[live] > at)]
    for i in np.flatnonzero(same & (length > LONG)):
        j = others[i]
        same[i] = np.array_equal(data[starts[i] : ends[i]], data[starts[j] : ends[j]])
    return same


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each start."""
    return np.searchsorted(offsets, starts, "right") - 1
