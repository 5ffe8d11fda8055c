"""SentencePiece encoding and decoding by suffix-array matching.

A model's normal pieces never hold a space mark after another character, so a text falls into units (a run of space
marks and what follows it up to the next run) that are encoded on their own. Of a batch of texts the distinct units are
concatenated, and

1. their suffix array is built (by doubling, up to the longest piece);
2. every piece is searched in it at once, by binary search for the lower and upper end of its range of occurrences;
3. the occurrences are edges (position, length, piece); they are sorted by position;
4. the edges are relaxed. A unigram model keeps the best score at each place of a unit, and a place's edges are relaxed
   for all units at once. A BPE model joins, in each round and in every unit, the two neighbours whose edge has the best
   score (the leftmost of equals), until no edge spans two neighbours. Characters without a piece become byte pieces.

The library encodes BPE models by joins and unigram models by best paths, so relaxation follows the model's own kind; the
matching is the same for both. (Paths of a unigram model with exactly equal scores are tied; the library's choice among
them hangs on the rounding of its sum over the text so far, so it may differ from the one here.) Units longer than LONG_UNIT characters (text without spaces) are joined one by one with a
heap, in n log n steps, from the same edges. Texts are taken whole, a batch holds BATCH_BYTES, or one longer text.

Only models that neither change characters nor remove spaces are accepted (identity normalisation, with or without a
leading space mark), and no pieces that a user defined or that hold a NUL; others raise ValueError.

Decoding gathers the pieces' bytes, a leading space mark's space left out; unknown ids give " \\u2047 ", control ids
nothing. An encoder remembers the units of the last batches: they are looked up by a 64-bit hash, and their bytes are then
compared, so that a unit whose hash another one has is encoded on its own.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd

from tidelog.llm.text_arrays import range_hashes

MARK = "▁".encode()
LONG_UNIT = 96
BATCH_BYTES = 1 << 20
MEMO_UNITS = 1 << 19
U = np.uint64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of a protobuf message's fields; groups don't occur."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SYMBOLS = 7  # bytes, each raised by one so that 0 is the end, that a 64-bit key holds at 9 bits


@dataclass
class Model:
    pieces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray
    bpe: bool
    prefix: bool
    unknown: int
    byte_ids: np.ndarray  # 256 ids, -1 without byte fallback

    @classmethod
    def load(cls, data: bytes) -> Model:
        """data: the bytes of a .model file."""
        pieces, scores, kinds, bpe, prefix, squeeze, charsmap, fallback = [], [], [], False, True, True, b"", False
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1])
                scores.append(np.frombuffer(own.get(2, bytes(4)), "<f4")[0])
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                bpe, fallback = own.get(3, UNIGRAM) == BPE, bool(own.get(35, 0))
                if own.get(3, UNIGRAM) not in (UNIGRAM, BPE):
                    raise ValueError("neither a unigram nor a BPE model")
            elif number == 3:
                own = dict(_fields(value))
                charsmap, prefix, squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        kinds_ = np.array(kinds)
        if any(b"\0" in p for p in pieces):
            raise ValueError("a piece that holds NUL")
        if charsmap or squeeze or np.isin(kinds_, (USER, UNUSED)).any() or any(MARK in p.removeprefix(MARK * (len(p) // 3 if p == MARK * (len(p) // 3) else 1)) for p, k in zip(pieces, kinds, strict=True) if k == NORMAL):
            raise ValueError("a model that this encoder doesn't express")
        byte_ids = np.full(256, -1)
        if fallback:
            for i in np.flatnonzero(kinds_ == BYTE):
                byte_ids[int(pieces[i][3:5], 16)] = i
        return cls(pieces, np.array(scores, np.float64), kinds_, bpe, prefix, int(np.flatnonzero(kinds_ == UNKNOWN)[0]), byte_ids)

    def __post_init__(self) -> None:
        self.normal = np.flatnonzero(self.kinds == NORMAL)
        self.longest = max(len(self.pieces[i]) for i in self.normal)
        self.base = self.longest + 1  # an edge's place and size as one number: place * base + size
        self.piece_bits = max(1, len(self.normal).bit_length())
        body = [self.pieces[i] for i in self.normal]
        self.flat = np.frombuffer(b"".join(body), np.uint8)
        self.first = np.r_[0, np.cumsum([len(p) for p in body])]
        table = [b"" if k in (UNKNOWN, CONTROL) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, b" ") for p, k in zip(self.pieces, self.kinds.tolist(), strict=True)]
        table[self.unknown] = " ⁇ ".encode()
        self.out_flat = np.frombuffer(b"".join(table), np.uint8)
        self.out_first = np.r_[0, np.cumsum([len(p) for p in table])]


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes first[i] .. first[i] + size[i] - 1 of all i, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the `depth` bytes that begin there; the end sorts before every byte."""
    n = len(data)
    padded = np.zeros(n + SYMBOLS, np.uint16)
    padded[:n] = data
    padded[:n] += 1
    key = np.zeros(n, U)
    for k in range(SYMBOLS):
        key = (key << U(9)) | padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    begins = np.flatnonzero(new)
    size = np.diff(np.r_[begins, n])
    rank = np.empty(n, U)
    rank[order] = np.repeat(begins, size).astype(U)
    slots = np.flatnonzero(np.repeat(size > 1, size))  # places whose strings aren't told apart yet
    width = SYMBOLS
    while width < depth and len(slots):
        at = order[slots]
        beyond = at + width
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + U(1), U(0))
        key = (rank[at] << U(32)) | second
        by = np.argsort(key)
        ordered, at = key[by], at[by]
        order[slots] = at
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        begins = np.flatnonzero(new)
        size = np.diff(np.r_[begins, len(slots)])
        rank[at] = np.repeat(slots[begins], size).astype(U)
        slots = slots[np.repeat(size > 1, size)]
        width *= 2
    return order


def occurrences(data: np.ndarray, order: np.ndarray, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): the ranges of `order` whose suffixes begin with each pattern, by two binary searches of all at once."""
    n, size = len(data), np.diff(first)
    longest = int(size.max())
    padded = np.r_[data.astype(np.uint16) + 1, np.zeros(longest, np.uint16)]
    raised = flat.astype(np.uint16) + 1
    words = -(-longest // SYMBOLS)

    def packed(source: np.ndarray, at: np.ndarray, k: int, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), U)
        for j in range(SYMBOLS * k, SYMBOLS * (k + 1)):
            inside = j < left
            out = (out << U(9)) | np.where(inside, source[np.minimum(at + j, len(source) - 1)], 0).astype(U)
        return out

    wanted = [packed(raised, first[:-1], k, size) for k in range(words)]

    def search(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(size), np.int64), np.full(len(size), n, np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            at = order[middle]
            below, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for k in range(words):
                live = np.flatnonzero(equal & (size[open_] > SYMBOLS * k))
                if not len(live):
                    break
                got, want = packed(padded, at[live], k, size[open_][live]), wanted[k][open_][live]
                below[live] = got < want
                equal[live] = got == want
            right = below | equal if upper else below
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]

    return search(False), search(True)


class Edges:
    """The occurrences of a model's pieces in a text, sorted by position, then length; found again by (position, length)."""

    def __init__(self, model: Model, data: np.ndarray):
        order = suffix_array(data, model.longest)
        low, high = occurrences(data, order, model.flat, model.first)
        count = high - low
        piece = np.repeat(np.arange(len(count)), count)
        at = order[ragged(low, count)]
        size = np.diff(model.first)[piece]
        self.base, bits = model.base, model.piece_bits
        if (len(data) * self.base) >> (63 - bits):
            raise ValueError(f"a batch of {len(data)} bytes for pieces of up to {model.longest}")
        code = np.sort(((at.astype(np.int64) * self.base + size) << bits) | piece)
        self.code, self.piece = code >> bits, model.normal[code & ((1 << bits) - 1)]

    def find(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The piece that spans these bytes, or -1."""
        wanted = np.where(size < self.base, at * self.base + size, -1)
        if not len(self.code):
            return np.full(len(wanted), -1)
        k = np.minimum(np.searchsorted(self.code, wanted), len(self.code) - 1)
        return np.where(self.code[k] == wanted, self.piece[k], -1)


def _join_long(start: list[int], end: int, find, scores: np.ndarray) -> list[int]:
    """Starts of the tokens of one long unit, with a heap of neighbours."""
    n = len(start)
    ends = start[1:] + [end]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int, int]] = []

    def propose(i: int, j: int) -> None:
        if i >= 0 and j >= 0:
            piece = find(start[i], ends[j] - start[i])
            if piece >= 0:
                heapq.heappush(heap, (-scores[piece], i, j, ends[j]))

    for i in range(n - 1):
        propose(i, i + 1)
    gone = [False] * n
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if gone[i] or gone[j] or right[i] != j or ends[j] != e:
            continue
        gone[j] = True
        ends[i] = ends[j]
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        propose(left[i], i)
        propose(i, right[i])
    return [start[i] for i in range(n) if not gone[i]]


def _joined(model: Model, data: np.ndarray, first: np.ndarray, edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """(start of each token, unit it is in) of all units under a BPE model."""
    is_char = (data & 0xC0) != 0x80
    start = np.flatnonzero(is_char)
    unit = np.searchsorted(first, start, "right") - 1
    per_unit = np.bincount(unit, minlength=len(first) - 1)
    long = np.flatnonzero(per_unit > LONG_UNIT)
    done_start, done_unit = [], []
    for u in long.tolist():
        own = start[unit == u].tolist() if len(long) < 4 else start[np.searchsorted(unit, u) : np.searchsorted(unit, u, "right")].tolist()
        low, high = np.searchsorted(edges.code, (first[u] * edges.base, first[u + 1] * edges.base))
        known = dict(zip(edges.code[low:high].tolist(), edges.piece[low:high].tolist(), strict=True))
        tokens = _join_long(own, int(first[u + 1]), lambda at, n, known=known: known.get(at * edges.base + n, -1) if n < edges.base else -1, model.scores)
        done_start.append(np.array(tokens))
        done_unit.append(np.full(len(tokens), u))
    keep = per_unit[unit] <= LONG_UNIT
    start, unit = start[keep], unit[keep]
    # the best pair of each unit, round after round; a pair is kept as the score of the edge from a token over the next
    end = np.r_[start[1:], 0]
    last = np.r_[unit[1:] != unit[:-1], True] if len(unit) else np.zeros(0, bool)
    end[last] = first[unit[last] + 1]
    score = np.full(len(start), -np.inf)

    def rescore(i: np.ndarray) -> None:
        i = i[~last[i]]
        piece = edges.find(start[i], end[i + 1] - start[i])
        score[i] = np.where(piece >= 0, model.scores[piece], -np.inf)

    rescore(np.arange(len(start)))
    while len(start):
        begins = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        best = np.maximum.reduceat(score, begins)
        live = best > -np.inf
        size = np.diff(np.r_[begins, len(start)])
        if not live.all():  # units that are done leave
            leave = np.repeat(~live, size)
            done_start.append(start[leave])
            done_unit.append(unit[leave])
            stay = ~leave
            start, end, unit, last, score = start[stay], end[stay], unit[stay], last[stay], score[stay]
            best, size = best[live], size[live]
            if not len(start):
                break
        hit = np.flatnonzero(score == np.repeat(best, size))
        hit = hit[np.r_[True, unit[hit][1:] != unit[hit][:-1]]]  # the leftmost
        end[hit], last[hit] = end[hit + 1], last[hit + 1]
        stay = np.ones(len(start), bool)
        stay[hit + 1] = False
        place = np.cumsum(stay) - 1
        hit = place[hit]
        start, end, unit, last, score = start[stay], end[stay], unit[stay], last[stay], score[stay]
        score[hit] = -np.inf
        before = hit[(hit > 0)] - 1
        before = before[unit[before] == unit[before + 1]]
        score[before] = -np.inf
        rescore(np.r_[hit, before])
    if not done_start:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, unit = np.concatenate(done_start), np.concatenate(done_unit)
    by = np.argsort(start, kind="stable")
    return start[by], unit[by]


def _shortest(model: Model, data: np.ndarray, first: np.ndarray, edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """The same under a unigram model: the best path of each unit. A character without a piece costs the least score less 10."""
    is_char = (data & 0xC0) != 0x80
    chars = np.flatnonzero(is_char)
    char_end = np.r_[chars[1:], len(data)]
    alone = edges.find(chars, char_end - chars) < 0
    unknown = model.scores[model.normal].min() - 10
    at, size = np.divmod(edges.code, edges.base)
    at, end = np.r_[at, chars[alone]], np.r_[at + size, char_end[alone]]
    gain = np.r_[model.scores[edges.piece], np.full(int(alone.sum()), unknown)]
    bare = np.arange(len(at)) >= len(edges.code)
    unit = np.searchsorted(first, at, "right") - 1
    inside = end <= first[unit + 1]
    at, end, gain, unit, bare = at[inside], end[inside], gain[inside], unit[inside], bare[inside]
    # places of a unit in turn: the edges that end at its k-th byte are relaxed together, for all units. Sums are kept in
    # single precision and compared in double, the earliest start first, as the library does: ties fall alike
    step = end - first[unit]
    by = np.lexsort((at, end, step))
    at, end, gain, step, bare = at[by], end[by], gain[by], step[by], bare[by]
    best, back = np.full(len(data) + len(first), -np.inf, np.float32), np.full(len(data) + len(first), -1)
    shift = lambda p, u: p + u  # a unit's end is not the next one's beginning
    unit = np.searchsorted(first, at, "right") - 1
    best[shift(first[:-1], np.arange(len(first) - 1))] = 0
    cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else np.zeros(0, np.int64)
    for low, high in zip(cuts, np.r_[cuts[1:], len(step)], strict=True):
        a, e, u = at[low:high], end[low:high], unit[low:high]
        total = best[shift(a, u)].astype(np.float64) + gain[low:high]
        total = np.where(bare[low:high], total.astype(np.float32), total)
        begins = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
        size = np.diff(np.r_[begins, len(e)])
        for k in range(int(size.max())):  # the k-th edge into each place; as few as pieces that end there
            i = begins[size > k] + k
            goal = shift(e[i], u[i])
            better = i[total[i] > best[goal]]
            goal = shift(e[better], u[better])
            best[goal], back[goal] = total[better], a[better]
    place, unit = first[1:].copy(), np.arange(len(first) - 1)
    starts, units = [], []
    while len(place):
        place = back[shift(place, unit)]
        starts.append(place)
        units.append(unit)
        live = place > first[unit]
        place, unit = place[live], unit[live]
    start, unit = np.concatenate(starts), np.concatenate(units)
    by = np.argsort(start, kind="stable")
    return start[by], unit[by]


def encode_units(model: Model, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, where each unit's begin) of units data[first[i]:first[i+1]]."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
    edges = Edges(model, data)
    start, unit = (_joined if model.bpe else _shortest)(model, data, first, edges)
    end = np.r_[start[1:], len(data)]
    ids = edges.find(start, end - start)
    # characters without a piece: their bytes, or the unknown id (once for a run of them under a unigram model)
    bare = ids < 0
    if bare.any():
        if (model.byte_ids >= 0).all():
            size = np.where(bare, end - start, 1)
            spread = ragged(start, size)
            bare, unit, ids = np.repeat(bare, size), np.repeat(unit, size), np.repeat(ids, size)
            ids = np.where(bare, model.byte_ids[data[spread]], ids)
        else:
            ids = np.where(bare, model.unknown, ids)
            again = bare & np.r_[False, bare[:-1]] & np.r_[False, unit[1:] == unit[:-1]] & (not model.bpe)
            ids, unit = ids[~again], unit[~again]
    return ids.astype(np.int32), np.searchsorted(unit, np.arange(len(first)))


def marked(data: np.ndarray, first: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units with spaces as space marks, and one more before those that lead."""
    space = data == 32
    size = np.where(space, 3, 1).astype(np.int64)
    begin = first[:-1][lead]
    size[begin] += 3
    place = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(3):
        out[place[begin] + k] = MARK[k]
    place[begin] += 3
    out[place] = np.where(space, MARK[0], data)
    for k in (1, 2):
        out[place[space] + k] = MARK[k]
    return out, np.r_[0, np.cumsum(size)][first]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at a space or space mark that follows another character, and where a text begins."""
    n = len(data)
    gap = data == 32
    after = np.r_[False, gap[:-1]]
    if (data == MARK[0]).any():
        sign = np.zeros(n, bool)
        if n >= 3:
            sign[:-2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
        gap = gap | sign
        after[3:] |= sign[:-3]
    begins = gap & ~after
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Encodes batches of texts; units of earlier batches are remembered, up to MEMO_UNITS of them, then forgotten all at once."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.hashes = pd.Index(np.zeros(0, U))
        self.bytes, self.starts, self.leads = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _fresh(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes as they are, ids, where each unit's begin) of units data[start[i]:start[i]+size[i]]."""
        own = data[ragged(start, size)]
        return own, *encode_units(self.model, *marked(own, np.r_[0, np.cumsum(size)], lead))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's begin) of valid UTF-8 texts data[offsets[i]:offsets[i+1]]."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        start = unit_starts(data, offsets)
        size = np.diff(np.r_[start, len(data)])
        lead = np.zeros(len(start), bool)
        lead[np.searchsorted(start, offsets[:-1][np.diff(offsets) > 0])] = self.model.prefix
        # units with one hash are taken for equal, each kind is encoded once, and then their bytes are compared
        hashes = range_hashes(data, start, start + size)
        hashes[lead] = hashes[lead] * U(0xC2B2AE3D27D4EB4F) + U(1)
        of, own_hashes = pd.factorize(hashes)
        own = np.empty(len(own_hashes), np.int64)
        own[of[::-1]] = np.arange(len(of) - 1, -1, -1)
        if len(self.hashes) > MEMO_UNITS:
            self.forget()
        known = self.hashes.get_indexer(own_hashes)
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            f = own[fresh]
            raw, ids, at = self._fresh(data, start[f], size[f], lead[f])
            known[fresh] = len(self.hashes) + np.arange(len(fresh))
            self.first = np.r_[self.first, len(self.ids) + at[1:]]
            self.ids = np.r_[self.ids, ids]
            self.starts = np.r_[self.starts, len(self.bytes) + np.cumsum(size[f])]
            self.bytes = np.r_[self.bytes, raw]
            self.leads = np.r_[self.leads, lead[f]]
            self.hashes = pd.Index(np.r_[self.hashes.to_numpy(), own_hashes[fresh]])
        unit = known[of]
        first, count, ids = self.first[:-1][unit], np.diff(self.first)[unit], self.ids
        other = (np.diff(self.starts)[unit] != size) | (self.leads[unit] != lead)
        same = np.flatnonzero(~other)
        differ = np.r_[False, self.bytes[ragged(self.starts[:-1][unit[same]], size[same])] != data[ragged(start[same], size[same])]]
        if differ.any():
            ends = np.cumsum(size[same])
            sums = np.cumsum(differ)
            other[same] = sums[ends] != sums[ends - size[same]]
        if other.any():
            o = np.flatnonzero(other)
            _, extra, at = self._fresh(data, start[o], size[o], lead[o])
            first[o], count[o] = len(ids) + at[:-1], np.diff(at)
            ids = np.r_[ids, extra]
        sums = np.r_[0, np.cumsum(count)]
        return ids[ragged(first, count)], sums[np.searchsorted(start, offsets)]


def decode(model: Model, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text's begin); the leading space of a text is dropped if the model adds one."""
    size = np.diff(model.out_first)[ids]
    data = model.out_flat[ragged(model.out_first[:-1][ids], size)]
    at = np.r_[0, np.cumsum(size)][first]
    if model.prefix and len(ids):
        full = np.flatnonzero(np.diff(at) > 0)
        lead = full[(data[at[full]] == 32) & (model.kinds[ids[first[full]]] == NORMAL)]
        keep = np.ones(len(data), bool)
        keep[at[lead]] = False
        data, at = data[keep], np.r_[0, np.cumsum(keep)][at]
    return data, at
