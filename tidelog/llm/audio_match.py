"""Alignment of recordings by their chroma fingerprints.

1. A recording is read and fingerprinted where its row is; only its codes travel. Equal fingerprints collapse to the
   smallest id, by a partial aggregate.
2. Each place gives keys: 18 bits of its code with 18 bits of the code LAG places later (half of its length later where it
   has no more than LAG codes), upper, middle or lower ones of each. Places whose code repeats the one before (silence, held
   tones) give none. Fingerprints that share a key are chained to the first of the key. Each of these links is tested by
   aligning its two ends, so that keys shared by chance join nothing. Fingerprints for which every test failed are chained
   again among themselves, without those that led them, in an order of each round's own, up to ROUNDS rounds. Connected
   components of the links that hold are candidate groups. Then all pairs of two groups that share a 24-bit part, without
   which step 3 finds no offset, are aligned too, block by block, so no link is left out; their links join the groups.
3. In each group a breadth-first search aligns a fingerprint with all that aren't linked yet: an offset histogram counts,
   over equal 24-bit parts, by how many places the other one is shifted; at its peak the bits of all overlapping codes are
   compared. Two recordings are linked where at most MAX_ERROR of these bits differ and the overlap is at least half of the
   shorter one. Near copies cost a few sweeps, not all pairs. Large groups are dealt into blocks, searched by pairs of
   blocks.
4. Components of the links are classes; each recording keeps the link with the fewest errors.

Random recordings differ in about half of the bits at a given offset, and in no less than 0.2 in 2 million pairs. Keys
alone would find lone pairs of 6-second recordings (48 codes) in 0.99 of all cases at an error of 0.08, in 0.96 at 0.1 and in
0.85 at MAX_ERROR; the pairs of blocks find the rest, at a cost that grows with the square of the recordings.

Defined results: null media, media that can't be read, and recordings too short for two codes have no keys, link with
nothing but equal ones and are their own class; those without a code link with nothing. A null id keeps its row: class null, kept. Rows that repeat an id share one class. Equal
fingerprints align at offset 0 with error 0. An empty table gives an empty result. Other columns pass through; clashing
names are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.chroma import fingerprint, read_wav
from tidelog.llm.cluster import cut, table
from tidelog.llm.graph import components
from tidelog.llm.keyed_links import SCHEMA, links, slice_rows
from tidelog.llm.text_arrays import U, mix

LAG = 8
MAX_ERROR = 0.12
GROUP_BYTES = 4 << 20
MATCHES = 1 << 21
ROUNDS = 2
DEALT, DEALT_BYTES, LEAST_BLOCKS = 32_768, 8 << 20, 4
_TURN = 0x9E3779B97F4A7C15  # odd: its powers shuffle the nodes, and their inverses bring them back
NEW = ("codes", "n_codes", "fingerprint_sha256", "class_id", "kept", "aligned_id", "offset", "bit_error")


def _fingerprints(batches: Iterator[pa.RecordBatch], read: Callable, others: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = [np.zeros(0, np.uint32) if x is None else fingerprint(read(x)) for x in part.column("media").to_pylist()]
            data = [x.astype("<u4").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(data, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in data])], [*others, "data", "h"])


def codes_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def _fresh(codes: np.ndarray) -> np.ndarray:
    """Which codes differ from the one before."""
    return np.r_[np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]


def _parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper and the lower 24 bits, told apart by a bit."""
    return (codes >> np.uint32(8)).astype(np.int64), (codes & np.uint32(0xFFFFFF)).astype(np.int64) | (1 << 24)


def keys(codes: np.ndarray) -> np.ndarray:
    lag = min(LAG, max(1, len(codes) // 2))
    at = np.flatnonzero(_fresh(codes)[: max(0, len(codes) - lag)])
    part = lambda c: [(c >> np.uint32(shift) & np.uint32(0x3FFFF)).astype(U) | U(k << 18) for k, shift in enumerate((0, 7, 14))]
    return np.unique(np.concatenate([mix((x << U(22) | y) + U(3)) for x in part(codes[at]) for y in part(codes[at + lag])]).view(np.int64))


def turned(nodes: np.ndarray, turn: int) -> np.ndarray:
    """Other numbers for the nodes, whose order is the turn's own; turned back by the negative turn."""
    return (nodes.astype(np.int64).view(U) * U(pow(_TURN, turn, 1 << 64))).view(np.int64)


def _emit(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, data = turned(batch.column("node").to_numpy(zero_copy_only=False), turn), batch.column("data").to_pylist()
        held: list[np.ndarray] = []
        first = size = 0
        for k in range(len(data) + 1):
            if held and (k == len(data) or size > (1 << 18)):
                yield from slice_rows(np.concatenate(held), np.repeat(nodes[first:k], [len(x) for x in held]).astype(np.int64))
                held, first, size = [], k, 0
            if k < len(data):
                held.append(keys(codes_of(data[k])))
                size += len(held[-1])


def align_one(p: np.ndarray, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset, share of differing bits) of each fingerprint flat[first[i]:first[i+1]] with p; the share is 2 where they don't meet.

    A place k of the other one lies at place k + offset of p.
    """
    n = len(first) - 1
    offset, error = np.zeros(n, np.int64), np.full(n, 2.0)
    size = np.diff(first)
    at_p = np.flatnonzero(_fresh(p))
    own = np.concatenate(_parts(p[at_p]))
    order = np.argsort(own, kind="stable")
    own, place_p = own[order], np.concatenate([at_p, at_p])[order]
    fresh = np.r_[np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1]]
    fresh[first[:-1][size > 0]] = True
    at = np.flatnonzero(fresh)
    which = np.repeat(np.arange(n), size)[at]
    votes: list[np.ndarray] = []
    span = int(size.max(initial=0)) + len(p) + 1
    for part in _parts(flat[at]):
        low, high = np.searchsorted(own, part), np.searchsorted(own, part, "right")
        count = high - low
        total = np.r_[0, np.cumsum(count)]
        start = 0
        while start < len(count):  # in pieces of about MATCHES matches
            end = max(start + 1, int(np.searchsorted(total, total[start] + MATCHES, "right")) - 1)
            c = count[start:end]
            hits = np.repeat(low[start:end] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            w = np.repeat(which[start:end], c)
            shift = place_p[hits] - np.repeat(at[start:end] - first[which[start:end]], c)
            found, times = np.unique(w * (2 * span) + shift + span, return_counts=True)
            votes.append(np.stack([found, times], 1))
            start = end
    if not votes:
        return offset, error
    both = np.concatenate(votes)
    found, back = np.unique(both[:, 0], return_inverse=True)
    times = np.bincount(back, both[:, 1], minlength=len(found)).astype(np.int64)
    w, shift = found // (2 * span), found % (2 * span) - span
    best = np.lexsort((shift, np.abs(shift), -times, w))
    best = best[np.r_[True, w[best][1:] != w[best][:-1]]] if len(best) else best
    w, shift = w[best], shift[best]
    low = np.maximum(0, -shift)  # in the other one
    overlap = np.minimum(size[w], len(p) - shift) - low
    fine = overlap * 2 >= np.minimum(size[w], len(p))
    w, shift, low, overlap = w[fine], shift[fine], low[fine], overlap[fine]
    if len(w):
        ramp = np.arange(overlap.sum()) - np.repeat(np.cumsum(overlap) - overlap, overlap)
        differing = np.bitwise_count(flat[np.repeat(first[w] + low, overlap) + ramp] ^ p[np.repeat(low + shift, overlap) + ramp])
        offset[w], error[w] = shift, np.add.reduceat(differing.astype(np.int64), np.cumsum(overlap) - overlap) / (32.0 * overlap)
    return offset, error


def search(nodes: np.ndarray, data: list[bytes], max_error: float) -> list[tuple[int, int, int, float]]:
    """(a, b, offset of b in a, error): links that connect all that are linked, some of each component's."""
    flat, size = np.frombuffer(b"".join(data), "<u4"), np.array([len(x) // 4 for x in data])
    first = np.r_[0, np.cumsum(size)]
    left, out = np.argsort(nodes, kind="stable"), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            n = size[left]
            ends = np.cumsum(n)
            others = flat[np.repeat(first[left] - (ends - n), n) + np.arange(ends[-1])]
            offset, error = align_one(flat[first[p] : first[p + 1]], others, np.r_[0, ends])
            hit = np.flatnonzero(error <= max_error)
            out += [(int(nodes[p]), int(nodes[left[k]]), int(offset[k]), float(error[k])) for k in hit.tolist()]
            queue += left[hit].tolist()
            left = np.delete(left, hit)
    return out


def _search_groups(batches: Iterator[pa.RecordBatch], max_error: float) -> Iterator[pa.RecordBatch]:
    def group(nodes: list, data: list) -> pa.RecordBatch:
        found = search(np.array(nodes, np.int64), data, max_error)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "offset", "error"])

    now, nodes, data = None, [], []
    for batch in batches:
        for key, node, x in zip(zip(*(batch.column(c).to_pylist() for c in ("component", "x", "y")), strict=True), batch.column("node").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if key != now:
                if len(nodes) > 1:
                    yield group(nodes, data)
                now, nodes, data = key, [], []
            nodes.append(node)
            data.append(x)
    if len(nodes) > 1:
        yield group(nodes, data)


def _back(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(turned(batch.column(c).to_numpy(zero_copy_only=False), -turn)) for c in ("a", "b")], ["a", "b"])


def _test(batches: Iterator[pa.RecordBatch], max_error: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b, data_a, data_b), and whether their two ends align."""
    for batch in batches:
        ends = [[codes_of(x) for x in batch.column(c).to_pylist()] for c in ("data_a", "data_b")]
        holds = [align_one(x, y, np.array([0, len(y)]))[1][0] <= max_error for x, y in zip(*ends, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(holds, pa.bool_())], ["a", "b", "holds"])


def tested_links(reps: DataFrame, max_error: float, rounds: int = ROUNDS) -> DataFrame:
    """(a, b) that share a key and align; reps: (node, data)."""
    end = lambda c: reps.select(F.col("node").alias(c), F.col("data").alias(f"data_{c}"))
    own, links_ = reps.select("node", "data"), None
    for turn in range(rounds):
        found = links(own.mapInArrow(partial(_emit, turn=turn), SCHEMA)).mapInArrow(partial(_back, turn=turn), "a long, b long")
        tested = cut(found.join(end("a"), "a").join(end("b"), "b").select("a", "b", "data_a", "data_b").mapInArrow(partial(_test, max_error=max_error), "a long, b long, holds boolean"))
        hold = tested.where("holds").select("a", "b")
        links_ = hold if links_ is None else links_.unionByName(hold)
        if turn + 1 == rounds:
            break
        alone = tested.groupBy(F.col("b").alias("node")).agg(F.max("holds").alias("any")).where("not any").select("node")
        alone = cut(alone.join(hold.select(F.col("a").alias("node")), "node", "left_anti"))
        if alone.isEmpty():
            break
        own = own.join(alone, "node")
    return links_


def _between(batches: Iterator[pa.RecordBatch], max_error: float) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (x, y, side): links (a, b, offset, error) of a block, or of two blocks, between different groups."""

    def pair(nodes: list, labels: list, sides: list, data: list) -> pa.RecordBatch:
        label, second, codes, n = np.array(labels, np.int64), np.array(sides) == 1, [codes_of(x) for x in data], len(nodes)
        parts = [np.unique(np.concatenate(_parts(c[_fresh(c)]))) if len(c) > 1 else np.zeros(0, np.int64) for c in codes]
        within, key, row = not second.any(), np.concatenate(parts), np.repeat(np.arange(n), [len(x) for x in parts])
        own, other = (slice(None), slice(None)) if within else (~second[row], second[row])
        order = np.argsort(key[other], kind="stable")
        key_b, row_b, row_a = key[other][order], row[other][order], row[own]
        low = np.searchsorted(key_b, key[own])
        count = np.searchsorted(key_b, key[own], "right") - low
        total, ends = np.r_[0, np.cumsum(count)], np.flatnonzero(np.r_[row_a[1:] != row_a[:-1], True]) + 1 if len(row_a) else []
        out, start, k = [], 0, 0
        while k < len(ends):  # whole recordings, about MATCHES shared parts
            k = max(k + 1, int(np.searchsorted(total[ends], total[start] + MATCHES, "right")))
            c = count[start : ends[k - 1]]
            p, q = np.repeat(row_a[start : ends[k - 1]], c), row_b[np.repeat(low[start : ends[k - 1]] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            start = ends[k - 1]
            apart = label[p] != label[q]
            if within:
                apart &= p < q
            p, q = np.divmod(np.unique(p[apart] * n + q[apart]), n)
            if not len(p):
                continue
            cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]).tolist()
            for first, last in zip(cuts, [*cuts[1:], len(p)], strict=True):
                found = [codes[x] for x in q[first:last]]
                offset, error = align_one(codes[p[first]], np.concatenate(found), np.r_[0, np.cumsum([len(x) for x in found])])
                out += [(nodes[p[first]], nodes[q[first + h]], int(offset[h]), float(error[h])) for h in np.flatnonzero(error <= max_error).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "offset", "error"])

    now, held = None, ([], [], [], [])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("node", "label", "side", "data")]
        for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("x", "y")), strict=True)):
            if key != now:
                if len(held[0]) > 1:
                    yield pair(*held)
                now, held = key, ([], [], [], [])
            for store, column in zip(held, columns, strict=True):
                store.append(column[k])
    if len(held[0]) > 1:
        yield pair(*held)


def links_between(reps: DataFrame, groups: DataFrame, max_error: float) -> DataFrame:
    """(a, b, offset, error) of all links between different groups, or ungrouped ones; reps: (node, data), groups: (node, component)."""
    n, size = reps.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()
    blocks = max(LEAST_BLOCKS, -(-n // DEALT), -(-size // DEALT_BYTES))
    labelled = reps.select("node", "data").join(groups, "node", "left").select("node", "data", F.coalesce("component", "node").alias("label"), F.pmod(F.xxhash64("node", F.lit("pairs")), F.lit(blocks)).cast("int").alias("block"))
    dealt = labelled.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "label", "data")
    ordered = dealt.repartition("x", "y").sortWithinPartitions("x", "y", "side")
    return table(ordered.mapInArrow(partial(_between, max_error=max_error), "a long, b long, offset long, error double"))


def align(recordings: DataFrame, key: str = "id", media: str = "media", read: Callable[[object], np.ndarray] = read_wav, max_error: float = MAX_ERROR) -> DataFrame:
    """recordings without their media, with codes and the columns of NEW. read: a value of the media column to mono samples."""
    others = [c for c in recordings.columns if c not in (key, media, *NEW)]
    base = recordings.select(F.col(f"`{key}`").cast("long").alias("id"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.col(f"`{media}`").alias("media"))
    names = [c for c in base.columns if c != "media"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "media")
    rows = table(base.mapInArrow(partial(_fingerprints, read=read, others=names), f"{kinds}, data binary, h string"))
    live = rows.where("id is not null and octet_length(data) > 0")
    reps = table(live.groupBy("h").agg(F.min("id").alias("rep"), F.first("data").alias("data")).withColumn("node", F.monotonically_increasing_id()))
    groups = cut(components(tested_links(reps, max_error)).withColumnRenamed("id", "node"))
    rest = links_between(reps, groups, max_error)
    groups = cut(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest.select("a", "b"))).withColumnRenamed("id", "node"))
    # a group above the limit is dealt into blocks, and each pair of blocks is searched on its own
    members = reps.select("node", "data").join(groups, "node")
    weights = members.groupBy("component").agg(F.ceil(F.sum(F.octet_length("data")) * 2 / GROUP_BYTES).cast("int").alias("blocks"))
    dealt = members.join(weights, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    whole = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    dealt = dealt.withColumn("pair", F.explode(F.when(F.col("blocks") <= 2, whole).otherwise(pairs)))
    dealt = dealt.select("component", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), "node", "data")
    aligned = dealt.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y").mapInArrow(partial(_search_groups, max_error=max_error), "a long, b long, offset long, error double")
    aligned = table(aligned.unionByName(rest))
    several = live.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("id")
    versions = live.select("id", "h").join(several, "id").distinct().join(reps.select("h", "node"), "h").select("id", "node")
    ties = versions.join(versions.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b"))
    classes = cut(components(aligned.select("a", "b").unionByName(ties)).withColumnRenamed("id", "node"))
    sides = aligned.unionByName(aligned.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("offset")).alias("offset"), "error"))
    best = sides.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("error", "a", "offset")).alias("best"))
    named = reps.select("node", "rep")
    best = best.join(named.select(F.col("node").alias("a"), F.col("rep").alias("aligned")), F.col("best.a") == F.col("a")).select("node", "aligned", "best.offset", "best.error")
    least = named.join(classes, "node").groupBy("component").agg(F.min("rep").alias("least"))
    known = reps.drop("data").join(classes, "node", "left").join(least, "component", "left").join(best, "node", "left").select("h", "rep", F.coalesce("least", "rep").alias("class"), "aligned", "offset", "error")
    out = rows.join(known, "h", "left")
    has = F.col("id").isNotNull() & (F.octet_length("data") > 0)
    copy = has & (F.col("id") != F.col("rep"))
    class_id = F.when(has, F.col("class")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(key), *(F.col(f"c{i}").alias(c) for i, c in enumerate(others)), F.col("data").alias("codes"), (F.octet_length("data") / 4).cast("long").alias("n_codes"),
        F.col("h").alias("fingerprint_sha256"), class_id.alias("class_id"), F.coalesce(F.col("id") == class_id, F.lit(True)).alias("kept"),
        F.when(copy, F.col("rep")).when(has, F.col("aligned")).alias("aligned_id"), F.when(copy, F.lit(0).cast("long")).when(has, F.col("offset")).alias("offset"),
        F.when(copy, F.lit(0.0)).when(has, F.round("error", 6)).alias("bit_error"),
    )
