"""MinHash near-dedup by a multi-index Hamming join.

1. A text's set is its distinct word shingles (64-bit hashes). Texts with equal sets collapse to the smallest id by a
   partial aggregate, however many copies there are.
2. Each remaining set gets HASHES minima of BITS bits. Two sets of similarity s agree in a position with probability
   about s, so their signatures differ in about (1 - s) * HASHES positions. The signature is split into CHUNKS chunks.
   By the pigeonhole principle two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 positions have a chunk
   with at most ERRORS = 1 differences; enumerating the position that may differ (the chunk with that position masked)
   gives keys of which such a pair shares at least one. At 0.8 the chance that no chunk is within one error is 4e-8; a
   threshold at which it is above MISS (below 0.65) is refused, as these signatures aren't made for it.
3. Rows that share a key are chained to the smallest id of the key: first among the rows of one slice of the input, so
   that a key held by a third of all rows leaves one row a slice, then over all slices. Connected components of these
   candidate links make candidate groups: each true pair under the signature distance lies inside one group.
   Where a group is above GROUP_BYTES of text, the signatures of its members are compared first, and only those that differ in
   at most LOOSE positions stay grouped (a pair at 0.8 differs in more with a chance below 1e-10): keys shared by unlike texts
   may chain many of them, and no text is read for those.
4. In each group the full sets are compared. A breadth-first search takes a document and tests all that aren't linked
   yet against it (sizes first, then intersection counts), so links are decided on full sets, and none that connects two
   components is lost; near copies cost a few sweeps, not all pairs. A group above GROUP_BYTES of text is dealt into
   blocks and each pair of blocks is searched on its own: more tasks, the same links.
5. Components of the confirmed links give the classes.

Defined results: a null or empty text, or one of white space, has an empty set and links with nothing. Rows with a null
id link with nothing and stay (component null, kept). Rows that repeat an id are versions of one document: they share its
component, and each row is returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cluster import cut
from tidelog.llm.graph import components
from tidelog.llm.keyed_links import SCHEMA, links, slice_rows
from tidelog.llm.text_arrays import U, fold, mix, shingles, slices
from tidelog.llm.vector_dedup import joined

HASHES, BITS, CHUNKS = 96, 8, 16
ROWS = HASHES // CHUNKS
LOOSE = HASHES // 2
MISS = 0.01
GROUP_BYTES = 24 << 20
SIGNATURES = 4096
BROADCAST_GROUPS = 100_000
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=U)).astype(np.uint32) | np.uint32(1)
_SHIFTS = mix(np.arange(1001, HASHES + 1001, dtype=U)).astype(np.uint32)


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, HASHES) bytes: the low bits of each minimum; an empty set has zeros."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, HASHES), np.uint8)
    if len(full):
        x, at = (hashes ^ (hashes >> U(32))).astype(np.uint32), first[:-1][full]
        for i in range(HASHES):
            y = x * _SEEDS[i] + _SHIFTS[i]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[full, i] = (np.minimum.reduceat(y, at) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return out


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                hashes, first = shingles(fold(data), offsets, width)
                n = np.diff(first)
                pad = np.r_[hashes, U(0)]
                # the set's own hash: two sums over differently mixed members
                sums = [np.where(n > 0, np.add.reduceat(mix(pad ^ U(k)), first[:-1]), U(0)) for k in (11, 12)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in sums), pa.array(list(map(bytes, signatures(hashes, first))), pa.binary())],
                    ["id", "n_shingles", "set_a", "set_b", "signature"],
                )

    return run


def keys(signature: np.ndarray) -> np.ndarray:
    """(texts, HASHES) longs: for each position, its chunk with that position masked."""
    out = np.empty(signature.shape, np.int64)
    salted = mix(signature.astype(U) + (np.arange(HASHES, dtype=U) << U(20)) + U(7))
    for c in range(CHUNKS):
        part = slice(c * ROWS, (c + 1) * ROWS)
        total = salted[:, part].sum(1, dtype=U)
        out[:, part] = mix(total[:, None] - salted[:, part] + np.arange(c * ROWS, (c + 1) * ROWS, dtype=U)[None, :] * U(0xA24BAED4963EE407)).view(np.int64)
    return out


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            node = np.repeat(part.column("id").to_numpy(zero_copy_only=False).astype(np.int64), HASHES)
            key = keys(np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)).ravel()
            yield from slice_rows(key, node)


def search(ids: np.ndarray, hashes: np.ndarray, first: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Links that connect all documents whose sets have 100 * intersection >= percent * union, some of each component's."""
    size = np.diff(first)
    order = np.argsort(size, kind="stable")
    _, local = np.unique(hashes, return_inverse=True)
    local = np.concatenate([local[first[i] : first[i + 1]] for i in order]) if len(order) else local
    size, ids = size[order], ids[order]
    first = np.r_[0, np.cumsum(size)]
    mark = np.zeros(int(local.max()) + 2 if len(local) else 1, np.int32)
    left = np.flatnonzero(size > 0)
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            near = left[np.searchsorted(size[left] * 100, size[p] * percent) : np.searchsorted(size[left] * percent, size[p] * 100, "right")]
            if not len(near):
                continue
            own = local[first[p] : first[p + 1]]
            mark[own] = 1
            if near[-1] - near[0] + 1 == len(near):
                counts = np.add.reduceat(mark[local[first[near[0]] : first[near[-1] + 1]]], first[near] - first[near[0]])
            else:
                n = size[near]
                flat = np.repeat(first[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                counts = np.add.reduceat(mark[local[flat]], np.cumsum(n) - n)
            mark[own] = 0
            hit = near[counts * 100 >= percent * (size[p] + size[near] - counts)]
            if len(hit):
                a += [int(ids[p])] * len(hit)
                b += ids[hit].tolist()
                queue += hit.tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
    return a, b


def _confirm(width: int, percent: int):
    def group(key: tuple, ids: list, texts: list) -> pa.RecordBatch:
        sets = [(shingles(fold(data), offsets, width)) for _, _, data, offsets in slices(pa.array(texts, pa.large_binary()))]
        hashes = np.concatenate([h for h, _ in sets])
        sizes = np.concatenate([np.diff(f) for _, f in sets])
        a, b = search(np.array(ids, np.int64), hashes, np.r_[0, np.cumsum(sizes)], percent)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts = None, [], []
        for batch in batches:
            for key, i, text in zip(zip(*(batch.column(c).to_pylist() for c in ("component", "x", "y")), strict=True), batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key != now:
                    if len(ids) > 1:
                        yield group(now, ids, texts)
                    now, ids, texts = key, [], []
                ids.append(i)
                texts.append(text)
        if len(ids) > 1:
            yield group(now, ids, texts)

    return run


def missed(similarity: float) -> float:
    """The chance that two sets of this similarity have no chunk within one error."""
    one = similarity**ROWS + ROWS * similarity ** (ROWS - 1) * (1 - similarity)
    return (1 - one) ** CHUNKS


def _compare_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (component, x, y): a star for each group that signatures within LOOSE link in a pair of blocks."""

    def linked(ids: list, signatures_: list) -> pa.RecordBatch:
        own, marks = np.array(ids, np.int64), np.frombuffer(b"".join(signatures_), np.uint8).reshape(-1, HASHES)
        ends = []
        for low in range(0, len(marks), 64):
            i, j = np.nonzero((marks[low : low + 64, None, :] != marks[None, :, :]).sum(2, dtype=np.uint8) <= LOOSE)
            ends.append(np.stack([i + low, j])[:, i + low < j])
        label = joined(len(own), *np.concatenate(ends, 1))
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(own[label[far]]), pa.array(own[far])], ["a", "b"])

    now, ids, held = None, [], []
    for batch in batches:
        for key, i, signature in zip(zip(*(batch.column(c).to_pylist() for c in ("component", "x", "y")), strict=True), batch.column("id").to_pylist(), batch.column("signature").to_pylist(), strict=True):
            if key != now:
                if len(ids) > 1:
                    yield linked(ids, held)
                now, ids, held = key, [], []
            ids.append(i)
            held.append(signature)
    if len(ids) > 1:
        yield linked(ids, held)


def _in_blocks(members: DataFrame) -> DataFrame:
    """members (component, id, blocks, ...) with x, y: each in every pair of blocks that holds its own; null blocks are one."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = members.withColumn("block", F.when(F.col("blocks").isNotNull(), own))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    one = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    return members.withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(others))).withColumns({"x": F.col("pair.x"), "y": F.col("pair.y")})


def _grouped(groups: DataFrame, full: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(groups, (component, blocks) of those above GROUP_BYTES, their number); signatures have thinned out the large ones."""
    weights = lambda g: g.join(full.select("id", "n_shingles"), "id").groupBy("component").agg((F.sum("n_shingles") * 8).alias("bytes"), F.count("*").alias("m")).where(F.col("bytes") > GROUP_BYTES)
    weak = cut(weights(groups).select("component", F.ceil(F.col("m") / SIGNATURES).cast("int").alias("blocks")))
    n = weak.count()
    if not n:
        return groups, weak, 0
    weak = F.broadcast(weak) if n <= BROADCAST_GROUPS else weak
    dealt = _in_blocks(groups.join(weak, "component").join(reps.select(F.col("rep").alias("id"), "signature"), "id")).select("component", "x", "y", "id", "signature")
    near = dealt.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y").mapInArrow(_compare_signatures, "a long, b long")
    groups = cut(groups.join(weak, "component", "left_anti").select("id", "component").unionByName(components(near)))
    large = cut(weights(groups).select("component", F.ceil(F.col("bytes") * 2 / GROUP_BYTES).cast("int").alias("blocks")))
    return groups, large, large.count()


def candidates(reps: DataFrame) -> DataFrame:
    """Candidate links (a, b) of sets; reps: (id, signature)."""
    return links(reps.mapInArrow(_emit_keys, SCHEMA))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs."""
    if missed(percent / 100) > MISS:
        raise ValueError(f"at {percent} percent these signatures would miss {missed(percent / 100):.3f} of the pairs")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    sets = cut(rows.mapInArrow(_sets(width), "id long, n_shingles long, set_a long, set_b long, signature binary"))
    full = sets.where("n_shingles > 0 and id is not null")
    reps = cut(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("rep"), F.first("signature").alias("signature")))
    groups = cut(components(candidates(reps.select(F.col("rep").alias("id"), "signature"))))
    # a group above the limit is dealt into blocks and searched by pairs of blocks; few are that large, and their list is
    # broadcast up to BROADCAST_GROUPS, so that texts aren't shuffled to meet it
    groups, large, n_large = _grouped(groups, full, reps)
    members = rows.join(groups, "id")
    dealt = _in_blocks(members.join(F.broadcast(large) if n_large <= BROADCAST_GROUPS else large, "component", "left")).select("component", "x", "y", "id", "text")
    confirmed = dealt.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y").mapInArrow(_confirm(width, percent), "a long, b long")
    # versions of one id are one node, also where a version's set has another representative
    versions = full.join(reps.select("set_a", "set_b", "n_shingles", "rep"), ["set_a", "set_b", "n_shingles"]).select("id", "rep")
    several = versions.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    tied = versions.join(several, "id").select("a", F.col("rep").alias("b"))
    found = cut(components(confirmed.unionByName(tied)))
    classes = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("class"))
    return sets.join(classes, ["set_a", "set_b", "n_shingles"], "left").select(
        "id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
