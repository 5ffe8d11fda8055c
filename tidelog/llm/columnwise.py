"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many strings.

All strings are read from their ends, one symbol of each a round (Bauer, Cox, Rosone; Cox, Garofalo, Rosone, Sciortino).
Before round j the transform B holds the symbol before each suffix of fewer than j symbols, and L the length each shares
with the suffix above it. The new suffix of a string stands where B's last-to-first mapping sends the place of its
predecessor; it shares one symbol more with its neighbours than their tails share, the minimum of L between two
successive places of that symbol.

B and L are files, in a folder that the caller names, and are only ever read and written from front to back, BLOCK symbols
at a time: a round reads both once to find the new places and shared lengths (of what lies before a block it keeps, for each
symbol, how often it occurred and the least L since), and once more to write them anew with the new symbols put in. In memory
are a few numbers for each string and symbol, one block, and the answer. Without a folder the files are held in memory.
"""

from __future__ import annotations

import contextlib
import io
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs

BLOCK = 1 << 20
END = 255  # stands where a string has no symbol left; 256 where strings hold byte 255
LONGEST = 254


class _Memory:
    """Files in memory: without a folder, or for one in a store that pyarrow doesn't open. They are as large as the strings."""

    def __init__(self) -> None:
        self.files: dict[str, bytes] = {}

    def create_dir(self, path: str) -> None: ...

    def delete_dir(self, path: str) -> None:
        self.files.clear()

    def open_input_stream(self, path: str, compression: None = None) -> io.BytesIO:
        return io.BytesIO(self.files[path])

    @contextlib.contextmanager
    def open_output_stream(self, path: str, compression: None = None) -> Iterator[io.BytesIO]:
        yield (out := io.BytesIO())
        self.files[path] = out.getvalue()


def opened(folder: str | None) -> tuple[fs.FileSystem | _Memory, str]:
    """(store, path) of a folder's path or URI."""
    if folder is None:
        return _Memory(), ""
    if "://" not in folder:
        return fs.LocalFileSystem(), folder
    try:
        return fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):  # no such scheme
        return _Memory(), folder


class _Column:
    """An array in two files by turns: one is read front to back, the other written front to back."""

    def __init__(self, store: fs.FileSystem, path: str, kind: type):
        self.store, self.paths, self.turn, self.kind = store, [f"{path}.{k}" for k in (0, 1)], 0, np.dtype(kind)

    def read(self, block: int) -> Iterator[np.ndarray]:
        with self.store.open_input_stream(self.paths[self.turn], compression=None) as file:
            while len(part := file.read(block * self.kind.itemsize)):
                yield np.frombuffer(part, self.kind)

    def write(self, parts: Iterable[np.ndarray]) -> None:
        with self.store.open_output_stream(self.paths[self.turn ^ 1], compression=None) as file:
            for part in parts:
                file.write(part.astype(self.kind, copy=False).tobytes())
        self.turn ^= 1


def _minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low[i] : high[i] + 1]), by minima over powers of two."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    by = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by], np.arange(int(level.max()) + 2)) if len(low) else [0]
    table = values
    for k in range(len(cuts) - 1):
        if k:
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        own = by[cuts[k] : cuts[k + 1]]
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k) + 1])
    return out


def _scan(b_column: _Column, l_column: _Column, block: int, places: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank of each place, ranks whose shared lengths change, those lengths).

    places: where the round's symbols stand in B, ascending; below: how many of B's symbols are less than each symbol.
    A rank counts the suffixes that begin with a symbol; the suffix of rank r stands at m + r.
    """
    sigma = len(below)
    seen, least = np.zeros(sigma, np.int64), np.full(sigma, 255, np.uint8)  # of each symbol: occurrences, and the least L since the last
    pending = np.zeros(sigma, bool)  # whether its last occurrence is one of the places
    ranks, changed, lengths, start = [], [], [], 0
    for b, shared in zip(b_column.read(block), l_column.read(block), strict=True):
        n = len(b)
        q = places[np.searchsorted(places, start) : np.searchsorted(places, start + n)] - start
        order = np.argsort(b, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        count = np.bincount(b, minlength=sigma)
        begin = np.cumsum(count) - count
        shift = below + seen - begin  # from a place in this block's order to a rank
        k = rank[q]
        ranks.append(k + shift[b[q]])
        # the new suffixes and those right below them get their shared lengths anew
        touched = np.zeros(n + 1, bool)
        touched[k] = True
        following = k + 1
        following = following[following < n]
        touched[following[b[order[following]] == b[order[following - 1]]]] = True
        here = np.flatnonzero(count > 0)
        touched[begin[here[pending[here]]]] = True
        t = np.flatnonzero(touched[:n])
        at = order[t]
        symbol = b[at]
        first = t == begin[symbol]
        value = np.zeros(len(t), np.uint8)
        inner = ~first
        value[inner] = _minima(shared, order[t[inner] - 1] + 1, at[inner]) + 1
        outer = first & (seen[symbol] > 0)
        value[outer] = np.minimum(least[symbol[outer]], np.minimum.accumulate(shared)[at[outer]]) + 1
        changed.append(t + shift[symbol])
        lengths.append(value)
        last = order[begin[here] + count[here] - 1]
        after = np.r_[np.minimum.accumulate(shared[::-1])[::-1], np.uint8(255)]
        least = np.minimum(least, after[0])
        least[here] = after[last + 1]
        new = np.zeros(n, bool)
        new[q] = True
        pending[here] = new[last]
        seen += count
        start += n
    return np.concatenate(ranks), np.concatenate(changed), np.concatenate(lengths)


def _put_in(parts: Iterable[np.ndarray], at: np.ndarray, values: np.ndarray) -> Iterator[np.ndarray]:
    """The parts with values[k] before what was at place at[k]; at ascends."""
    start = k = 0
    for part in parts:
        stop = int(np.searchsorted(at, start + len(part)))
        yield np.insert(part, at[k:stop] - start, values[k:stop])
        start, k = start + len(part), stop
    yield values[k:]


def _changed(parts: Iterable[np.ndarray], at: np.ndarray, values: np.ndarray) -> Iterator[np.ndarray]:
    """The parts with values[k] at place at[k]; at ascends. Parts are changed in place."""
    start = k = 0
    for part in parts:
        stop = int(np.searchsorted(at, start + len(part)))
        part[at[k:stop] - start] = values[k:stop]
        yield part
        start, k = start + len(part), stop


def construct(data: np.ndarray, first: np.ndarray, folder: str | None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(B, L, string, length): the transform, shared lengths, and which string's suffix of what length stands where.

    String i is data[first[i]:first[i+1]], of 1 to LONGEST bytes; equal suffixes stand in the order of their strings. The
    files are written to a folder of their own inside `folder`, which goes at the end; None: they are held in memory.
    """
    m, size = len(first) - 1, np.diff(first)
    if m == 0 or int(size.max()) > LONGEST or int(size.min()) < 1:
        raise ValueError(f"strings of 1 to {LONGEST} bytes are needed")
    end = END + int(data.max() == 255)
    kind = np.uint8 if end == END else np.uint16
    data = data.astype(kind, copy=False)
    store, root = opened(folder)
    root = f"{root}/columnwise-{uuid.uuid4().hex}"
    store.create_dir(root)
    try:
        b_column, l_column = _Column(store, f"{root}/transform", kind), _Column(store, f"{root}/shared", np.uint8)
        now = data[first[1:] - 1]
        b_column.write([now])
        l_column.write([np.zeros(m, np.uint8)])
        totals = np.bincount(now, minlength=end + 1)
        at = np.arange(m)
        for j in range(1, int(size.max()) + 1):
            active = np.flatnonzero(size >= j)
            active = active[np.argsort(at[active])]
            ranks, changed, lengths = _scan(b_column, l_column, block, at[active], np.cumsum(totals) - totals)
            symbols = np.where(size[active] > j, data[np.maximum(first[1:][active] - j - 1, 0)], kind(end))
            totals += np.bincount(symbols, minlength=end + 1)
            at[active] = m + ranks
            by = np.argsort(ranks)
            old = m + ranks[by] - np.arange(len(by))  # how many of the old symbols stand before each new one
            b_column.write(_put_in(b_column.read(block), old, symbols[by]))
            by = np.argsort(changed)
            l_column.write(_changed(_put_in(l_column.read(block), old, np.zeros(len(old), np.uint8)), m + changed[by], lengths[by]))
        b, shared = np.concatenate(list(b_column.read(block))), np.concatenate(list(l_column.read(block)))
    finally:
        store.delete_dir(root)
    # the strings are read once more, in the order that is now known
    order = np.argsort(b, kind="stable")
    rank = np.empty(len(b), np.int64)
    rank[order] = np.arange(len(b)) + m
    string, length = np.empty(len(b), np.int32), np.zeros(len(b), np.uint8)
    at = np.arange(m)
    string[at] = at
    for j in range(1, int(size.max()) + 1):
        active = np.flatnonzero(size >= j)
        at[active] = rank[at[active]]
        string[at[active]], length[at[active]] = active, j
    return b, shared, string, length
