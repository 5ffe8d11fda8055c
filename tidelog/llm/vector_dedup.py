"""Embedding near-dedup: all pairs in blocks, or sorted projection passes where the caller asks for an approximate result.

1. Vectors with equal bytes collapse to the smallest id, with their number, by a partial aggregate.
2. All pairs are compared in double precision at any size of the table, dealt into blocks, so no link is missed; the arithmetic
   grows with the square of the vectors. With approximate=True passes take its place, also at any size; nothing switches by
   itself. Each pass gives a vector 64 random hashes, the signs of random projections, concatenated. Vectors are sorted by them
   lexicographically over the whole table (range partitions), and each is compared with the WINDOW that follow it, in
   double precision. A range's first and last WINDOW vectors go on, with their places in the whole order, to be compared
   across the borders of ranges, in blocks of BLOCK places; so the result doesn't depend on the number of ranges. Of what
   is found in a block only a star for each group of linked vectors is kept, so a dense group gives no more rows than it has
   members.
3. The stars of all blocks or passes are united, by connected components that never leave the executors.
4. Inside each component all members are compared, block by block, so a vector's number of links counts every member at
   or above the threshold, also those that no window held together. A component of m vectors is dealt into about
   sqrt(m / 64) blocks, and each pair of blocks is a task's work of its own; only counts are sent on.

Two vectors at the threshold agree in a hash with probability q = 1 - acos(threshold) / pi, and lie within a window where
they share so many leading hashes that at most WINDOW others share them too: about log2(n / WINDOW) among spread-out
vectors, more where many lie near each other. How many is measured on a sample (the SAMPLE smallest digests), and the number
of passes is set so that such a pair is missed in all passes with a probability of at most MISS, also in the most crowded
place of the sample. Among spread-out vectors it grows as n^0.15; where a third of them lie in a cone the passes are
many.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, links with nothing (its
component is its own id). Vectors of different lengths link with nothing of another length. A null id keeps its row:
no links, component null, kept. Rows that repeat an id share one component; n_links counts rows. An empty table gives an
empty result. Other columns pass through; clashing names are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidelog.llm.cluster import cut, table
from tidelog.llm.graph import components

WINDOW = 128
MISS = 0.005
BLOCK = 1024
AT_ONCE = 200_000
DEALT, DEALT_BYTES, LEAST_BLOCKS = 32_768, 16 << 20, 8
SAMPLE, CENTRES = 2048, 512
SEED = 20240229
NEW = ("n_links", "component_id", "kept")


def _prepare(batches: Iterator[pa.RecordBatch], kind: str, others: list[str]) -> Iterator[pa.RecordBatch]:
    """Each row's vector as bytes and their digest; null where it links with nothing."""
    for batch in batches:
        column = batch.column("vector")
        first = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        flat = column.flatten()
        valid = np.asarray(flat.is_valid())
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
        fine = np.r_[0, np.cumsum(valid & np.isfinite(values))]
        some = np.r_[0, np.cumsum(values != 0)]
        size = np.diff(first)
        good = (size > 0) & (np.diff(fine[first]) == size) & (np.diff(some[first]) > 0)
        data = [values[first[i] : first[i + 1]].tobytes() if good[i] else None for i in range(len(size))]
        digests = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in data]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(digests, pa.binary()), pa.array(data, pa.binary())], [*others, "h", "x"])


def units(column: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in double precision."""
    x = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(batches: Iterator[pa.RecordBatch], turns: range, kind: str) -> Iterator[pa.RecordBatch]:
    """For each pass 64 signs of random projections of each vector as a long; size tells vectors of another length or pass apart."""
    planes: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        data = batch.column("x").to_pylist()
        size = np.array([len(x) for x in data])
        own = {n: np.flatnonzero(size == n) for n in np.unique(size).tolist()}
        scaled = {n: units([data[i] for i in at.tolist()], kind) for n, at in own.items()}
        for turn in turns:
            key = np.zeros(len(data), np.int64)
            for n, at in own.items():
                dims = scaled[n].shape[1]
                if (turn, dims) not in planes:
                    planes[turn, dims] = np.random.default_rng([SEED, turn, dims]).standard_normal((dims, 64))
                key[at] = np.packbits(scaled[n] @ planes[turn, dims] > 0, axis=1).view(">i8").ravel()
            yield pa.RecordBatch.from_arrays([pa.array(size * turns.stop + turn), pa.array(key), batch.column("node"), batch.column("x")], ["size", "key", "node", "x"])


def stars(near: np.ndarray) -> np.ndarray:
    """The least index that each index reaches; near[i, j]: i and j are linked (rows are the first indexes of the columns)."""
    return joined(near.shape[1], *np.nonzero(near))


def joined(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of m indexes that each reaches by the links (i, j)."""
    label = np.arange(m)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


FOUND_SCHEMA = "a long, b long, part int, place long, size long, x binary"


def _found(a=None, b=None, part=None, place=None, size=None, x=None) -> pa.RecordBatch:
    n = next(len(v) for v in (a, part) if v is not None)
    kinds = {"a": pa.int64(), "b": pa.int64(), "part": pa.int32(), "place": pa.int64(), "size": pa.int64(), "x": pa.binary()}
    given = {"a": a, "b": b, "part": part, "place": place, "size": size, "x": x}
    return pa.RecordBatch.from_arrays([pa.nulls(n, kind) if given[c] is None else pa.array(given[c], kind) for c, kind in kinds.items()], list(kinds))


def _windows(batches: Iterator[pa.RecordBatch], kind: str, threshold: float, window: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b): stars of the vectors that lie within a window; the last `window` vectors of a block are carried into the next.

    Also this range's number of vectors, as (part, place), and its first and last `window` ones, as (a, part, place, size, x).
    """
    held_x, held_id, held_size = np.zeros((0, 0)), np.zeros(0, np.int64), -1
    part, place = TaskContext.get().partitionId(), 0
    apart = np.arange(BLOCK + window)[None, :] - np.arange(BLOCK + window)[:, None]
    band = (apart > 0) & (apart <= window)
    last: list[tuple] = []
    for batch in batches:
        size = batch.column("size").to_numpy(zero_copy_only=False)
        ids, data = batch.column("node").to_numpy(zero_copy_only=False), batch.column("x").to_pylist()
        early = max(0, min(len(size), window - place))
        if early:
            yield _found(a=ids[:early], part=[part] * early, place=np.arange(place, place + early), size=size[:early], x=data[:early])
        tail = range(max(early, len(size) - window), len(size))
        last = [*last, *((int(ids[k]), place + k, int(size[k]), data[k]) for k in tail)][-window:]
        place += len(size)
        cuts = np.flatnonzero(np.r_[True, size[1:] != size[:-1]]).tolist() if len(size) else []
        for low, high in zip(cuts, [*cuts[1:], len(size)], strict=True):
            if size[low] != held_size:
                held_x, held_id, held_size = None, np.zeros(0, np.int64), size[low]
            for at in range(low, high, BLOCK):
                end = min(high, at + BLOCK)
                x = units(data[at:end], kind)
                x = x if held_x is None else np.r_[held_x, x]
                own = np.r_[held_id, ids[at:end]]
                label = stars(((x @ x.T) >= threshold) & band[: len(x), : len(x)])
                far = np.flatnonzero(label != np.arange(len(label)))
                if len(far):
                    yield _found(a=own[label[far]], b=own[far])
                held_x, held_id = x[-window:], own[-window:]
    if last:
        yield _found(a=[x[0] for x in last], part=[part] * len(last), place=[x[1] for x in last], size=[x[2] for x in last], x=[x[3] for x in last])
    if place:
        yield _found(part=[part], place=[place])


def _borders(batches: Iterator[pa.RecordBatch], kind: str, threshold: float, window: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (block, place): stars of the vectors of a block that lie within a window."""

    def linked(places: list, sizes: list, ids: list, data: list) -> Iterator[pa.RecordBatch]:
        for n in set(sizes):  # vectors of one length stand together
            at = [k for k, size in enumerate(sizes) if size == n]
            x, place, own = units([data[k] for k in at], kind), np.array([places[k] for k in at]), np.array([ids[k] for k in at], np.int64)
            apart = place[None, :] - place[:, None]
            label = stars((x @ x.T >= threshold) & (apart > 0) & (apart <= window))
            far = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(own[label[far]]), pa.array(own[far])], ["a", "b"])

    now, held = None, ([], [], [], [])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("place", "size", "a", "x")]
        for k, block in enumerate(batch.column("block").to_pylist()):
            if block != now:
                if len(held[0]) > 1:
                    yield from linked(*held)
                now, held = block, ([], [], [], [])
            for store, column in zip(held, columns, strict=True):
                store.append(column[k])
    if len(held[0]) > 1:
        yield from linked(*held)


def _all_pairs(batches: Iterator[pa.RecordBatch], kind: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (size, i, j, side): stars of the vectors of a block, or of two blocks."""

    def pair(ids: list, side: list, data: list) -> pa.RecordBatch:
        own, second, x = np.array(ids, np.int64), np.array(side) == 1, units(data, kind)
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        within, ends = not len(b), []
        b = a if within else b
        for low in range(0, len(a), BLOCK):
            part = a[low : low + BLOCK]
            for start in range(low if within else 0, len(b), 8 * BLOCK):
                other = b[start : start + 8 * BLOCK]
                i, j = np.divmod(np.flatnonzero(x[part] @ x[other].T >= threshold), len(other))
                i, j = part[i], other[j]
                if len(i):
                    both, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                    label = joined(len(both), at[: len(i)], at[len(i) :])
                    far = np.flatnonzero(label != np.arange(len(label)))
                    ends.append(np.stack([both[label[far]], both[far]]))
        label = joined(len(own), *np.concatenate(ends, 1)) if ends else np.arange(len(own))
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(own[label[far]]), pa.array(own[far])], ["a", "b"])

    now, held = None, ([], [], [])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("node", "side", "x")]
        for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("size", "i", "j")), strict=True)):
            if key != now:
                if len(held[0]) > 1:
                    yield pair(*held)
                now, held = key, ([], [], [])
            for store, column in zip(held, columns, strict=True):
                store.append(column[k])
    if len(held[0]) > 1:
        yield pair(*held)


def _count_links(batches: Iterator[pa.RecordBatch], kind: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (component, x, y, side): each vector's links in its pair of blocks, weighed by copies."""

    def pair(ids: list, weight: list, side: list, data: list) -> pa.RecordBatch | None:
        sizes = {len(d) for d in data}
        out_id, out_n = [], []
        for n in sizes:  # a component has one length of vectors, unless a repeated id joins two
            at = [k for k, d in enumerate(data) if len(d) == n]
            x, w, s, own = units([data[k] for k in at], kind), np.array([weight[k] for k in at], np.int64), np.array([side[k] for k in at]), np.array([ids[k] for k in at], np.int64)
            total = np.zeros(len(at), np.int64)
            a, b = (np.flatnonzero(s == 0), np.flatnonzero(s == 1)) if s.any() else (np.arange(len(s)), None)
            for low in range(0, len(a), BLOCK):
                part = a[low : low + BLOCK]
                for start in range(0, len(a if b is None else b), 8 * BLOCK):
                    other = (a if b is None else b)[start : start + 8 * BLOCK]
                    near = x[part] @ x[other].T >= threshold
                    if b is None:
                        near[part[:, None] == other[None, :]] = False
                    total[part] += near @ w[other]
                    if b is not None:
                        total[other] += w[part] @ near
            out_id.append(own)
            out_n.append(total)
        ids_, n_ = np.concatenate(out_id), np.concatenate(out_n)
        return pa.RecordBatch.from_arrays([pa.array(ids_[n_ > 0]), pa.array(n_[n_ > 0])], ["node", "n"])

    now, held = None, ([], [], [], [])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("node", "weight", "side", "x")]
        for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j")), strict=True)):
            if key != now:
                if len(held[0]) > 1:
                    yield pair(*held)
                now, held = key, ([], [], [], [])
            for store, column in zip(held, columns, strict=True):
                store.append(column[k])
    if len(held[0]) > 1:
        yield pair(*held)


def passes_for(n: int, threshold: float, window: int, miss: float = MISS) -> int:
    """How many passes miss a pair at the threshold in all of them with probability `miss`."""
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** max(1.0, math.log2(max(2, n) / window))
    return max(2, math.ceil(math.log(miss) / math.log1p(-min(agree, 1 - 1e-9))))


def passes_in(x: np.ndarray, n: int, threshold: float, window: int, miss: float = MISS) -> int:
    """passes_for where n vectors crowd as those of the sample x do, in the most crowded place around its first CENTRES.

    Vectors linked with a centre don't crowd it: a window full of them holds its links.
    """
    least = passes_for(n, threshold, window, miss)
    if len(x) < 2 or n <= window:
        return least
    near = np.clip(x[:CENTRES] @ x.T, -1.0, 1.0)
    agree = np.where(near >= threshold, 0.0, 1 - np.arccos(near) / math.pi)
    np.fill_diagonal(agree, 0.0)
    share, before = np.ones_like(agree) * (agree > 0), math.log(n)
    bits, crowd = 0.0, n
    for b in range(1, 65):
        share *= agree
        crowd = max(float(share.sum(1).max()) * (n - 1) / (len(x) - 1), 1e-9)
        if crowd <= window:
            bits = b - 1 + max(0.0, (before - math.log(window)) / max(before - math.log(crowd), 1e-9))
            break
        bits, before = float(b), math.log(crowd)
    if crowd > window:
        return max(least, n)
    agree_pair = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** max(1.0, bits)
    return max(least, math.ceil(math.log(miss) / math.log1p(-min(agree_pair, 1 - 1e-9))))


def measured_passes(reps: DataFrame, n: int, kind: str, threshold: float, window: int) -> int:
    sample = [r.x for r in reps.select("h", "x").orderBy("h").limit(SAMPLE).collect()]
    most = passes_for(n, threshold, window)
    for size in {len(d) for d in sample}:
        own = [d for d in sample if len(d) == size]
        most = max(most, passes_in(units(own, kind), math.ceil(n * len(own) / len(sample)), threshold, window))
    return most


def _by_windows(reps: DataFrame, n: int, passes: int, kind: str, threshold: float, window: int) -> DataFrame:
    """Links found in the windows of all passes over n vectors.

    About AT_ONCE rows are sorted at once: a few passes together over few vectors, each in its own order, and one after another
    over many, so that the disk holds one copy of them.
    """
    links, several = None, max(1, AT_ONCE // max(1, n))
    for turn in range(0, passes, several):
        turns = range(turn, min(passes, turn + several))
        keyed = reps.select("node", "x").mapInArrow(partial(_keys, turns=turns, kind=kind), "size long, key long, node long, x binary")
        ordered = keyed.repartitionByRange("size", "key", "node").sortWithinPartitions("size", "key", "node")
        found = cut(ordered.mapInArrow(partial(_windows, kind=kind, threshold=threshold, window=window), FOUND_SCHEMA))
        own = found.where("b is not null").select("a", "b")
        counts = sorted((r.part, r.place) for r in found.where("part is not null and x is null").select("part", "place").collect())  # a number for each range
        if len(counts) > 1:
            before = np.cumsum([0, *(n for _, n in counts[:-1])]).tolist()
            starts = reps.sparkSession.createDataFrame([(part, low) for (part, _), low in zip(counts, before, strict=True)], "part int, before long")
            edges = found.where("x is not null").join(F.broadcast(starts), "part").withColumn("place", F.col("place") + F.col("before"))
            # each place in its block, the last ones also in the next
            block = F.floor(F.col("place") / BLOCK).cast("long")
            edges = edges.withColumn("block", F.explode(F.when(F.col("place") % BLOCK >= BLOCK - window, F.array(block, block + 1)).otherwise(F.array(block))))
            dealt = edges.select("block", "place", "size", "a", "x").repartition("block").sortWithinPartitions("block", "place")
            own = own.unionByName(dealt.mapInArrow(partial(_borders, kind=kind, threshold=threshold, window=window), "a long, b long"))
        links = own if links is None else links.unionByName(own)
    return links


def _by_all_pairs(reps: DataFrame, n: int, kind: str, threshold: float) -> DataFrame:
    """Stars of all links: every pair of blocks of at most about DEALT vectors, or DEALT_BYTES as doubles, is a task's work of its own."""
    longest = (reps.agg(F.max(F.octet_length("x"))).first()[0] or 0) * 8 // np.dtype(kind).itemsize
    blocks = max(LEAST_BLOCKS, math.ceil(n / DEALT), math.ceil(n * longest / DEALT_BYTES))
    dealt = reps.select("node", "x", F.octet_length("x").alias("size"), F.pmod(F.xxhash64("h", F.lit("pairs")), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = dealt.select("size", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "x")
    ordered = dealt.repartition("size", "i", "j").sortWithinPartitions("size", "i", "j", "side")
    return cut(ordered.mapInArrow(partial(_all_pairs, kind=kind, threshold=threshold), "a long, b long").distinct())


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, window: int = WINDOW, approximate: bool = False) -> DataFrame:
    """vectors without the vector itself, with n_links, component_id and kept. approximate: links are found by passes of windows."""
    kind = "<f4" if isinstance(vectors.schema[vector].dataType, ArrayType) and isinstance(vectors.schema[vector].dataType.elementType, FloatType) else "<f8"
    others = [c for c in vectors.columns if c not in (key, vector, *NEW)]
    base = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)),
        F.col(f"`{vector}`").cast("array<float>" if kind == "<f4" else "array<double>").alias("vector"),
    )
    names = [c for c in base.columns if c != "vector"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "vector")
    rows = table(base.mapInArrow(partial(_prepare, kind=kind, others=names), f"{kinds}, h binary, x binary"))
    live = rows.where("x is not null and id is not null")
    reps = table(live.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("x").alias("x")).withColumn("node", F.monotonically_increasing_id()))
    n = reps.count()
    links = _by_windows(reps, n, measured_passes(reps, n, kind, threshold, window), kind, threshold, window) if approximate else _by_all_pairs(reps, n, kind, threshold)
    # the vectors that a repeated id stands for belong together
    several = live.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("id")
    versions = live.select("id", "h").join(several, "id").distinct().join(reps.select("h", "node"), "h").select("id", "node")
    ties = versions.join(versions.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b"))
    groups = cut(components(links.unionByName(ties)).withColumnRenamed("id", "node"))
    members = reps.join(groups, "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("m"), F.min("rep").alias("least")).withColumn("blocks", F.ceil(F.sqrt(F.col("m") / 64)).cast("int"))
    dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("h", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.select("component", "node", "weight", "x", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "weight", "x")
    counted = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side").mapInArrow(partial(_count_links, kind=kind, threshold=threshold), "node long, n long")
    degrees = counted.groupBy("node").agg(F.sum("n").alias("n"))
    known = reps.drop("x").join(degrees, "node", "left").join(groups, "node", "left").join(sizes.select("component", "least"), "component", "left")
    known = known.select("h", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component"))
    out = rows.join(known, "h", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    live_row = F.col("x").isNotNull() & F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(key), *(F.col(f"c{i}").alias(c) for i, c in enumerate(others)), F.when(live_row, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
