"""Whole texts as flat arrays: bytes, words and hashes of a batch at once, with no loop over characters or words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold about `limit` bytes, a longer text alone; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's)."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _FOLD[data]


_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, SLICE_BYTES + 65536), _BASE if kind == "up" else _INVERSE, U)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]: a polynomial over mixed bytes, by prefix sums."""
    codes = mix(np.arange(1, 257, dtype=U))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(codes[data] * _power("up", len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts]
    return mix(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of maximal runs without white space in each text; words first[i]:first[i+1] are text i's."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words end where a text does
    starts = np.flatnonzero(inside & (edge[:-1] | np.r_[True, ~inside[:-1]])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (edge[1:] | np.r_[~inside[1:], True])) + 1 if len(data) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct hashes of each text's runs of `width` words, ascending; fewer words make one run."""
    starts, ends, first = words(data, offsets)
    hashes = range_hashes(data, starts, ends)
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    of = np.repeat(np.arange(len(count)), n)
    at = first[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros(len(of), U)
    last = first[1:][of]
    for k in range(width):
        there = at + k < last
        out = np.where(there, mix(out * U(0x9FB21C651E98DF25) + hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] + U(k + 1)), out) if len(hashes) else out
    order = np.lexsort((out, of))
    out, of = out[order], of[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (of[1:] != of[:-1])] if len(out) else np.zeros(0, bool)
    out, of = out[new], of[new]
    return out, np.searchsorted(of, np.arange(len(count) + 1))
