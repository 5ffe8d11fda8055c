"""Suffix-array dedup: cut every byte that lies in a LENGTH-byte string which also starts earlier in the corpus.

Column-wise construction inserts a symbol of every string each round, so it suits many short strings; over whole texts
it would take as many rounds as the longest text has bytes. Here it orders the strings of the corpus that may repeat:

1. Anchors. Of the K-byte strings in a window of LENGTH bytes the one with the least hash (the leftmost of equals) is
   its anchor; equal windows have equal anchors at equal places. Successive windows with one anchor form a run; a run is
   told by its anchor's hash and the hash of the bytes that its windows cover. Only runs travel, about one in 35 bytes.
2. Whole copies of a run: all but the first (by id, then start) are cut, first within a slice of the input, so that a
   passage of a third of all texts leaves one row a slice, then over all. Where an anchor has one run left, its windows
   occur once. Where it has several, they may share some windows: these runs go on.
3. Their bytes are fetched. A window reaches at least SIDE bytes to the left or to the right of its anchor; the side and
   those bytes refine the anchor to a group of strings. What a group has in common, K + SIDE bytes, is left out: of a
   window its other REST bytes remain, some before that place and some after it.
4. The strings are put in order by columnwise.construct, about STRINGS of them at a time and whole groups at once; its
   transform and common prefixes are sequential files, in the shared folder where the strings have more than IN_MEMORY
   bytes, else in memory: each of up to 68 rounds writes them anew, and a disk is slower than the rounds. Neighbours that share REST bytes, in one group
   and at one place, are equal windows, and all but the first are cut.
5. A group of more than STRINGS strings is dealt into blocks, which are put in order in the same way. The first windows of
   its blocks, one of each kind a block, are then compared by their bytes over all blocks, with partial minima before the
   shuffle.
6. The cut runs of windows join the texts, and what is left is returned.

Order: (id, two hashes of the text, start); a null id comes first. Rows are told apart by id and 128 bits of the text's hash:
where an id is null or repeated, its different texts are numbered in that order (by a sort of these rows' hashes alone), so
they are documents of their own; fully repeated rows count as one document and get one result each. Texts are UTF-8 bytes, or
any bytes; null is empty; windows never cross documents, and long texts are read in pieces of PIECE bytes. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cluster import cut, shared_folder, table
from tidelog.llm.columnwise import construct
from tidelog.llm.text_arrays import U, mix, range_hashes, slices

LENGTH, K = 100, 32
SPAN = LENGTH - K + 1  # places of an anchor in a window
SIDE = (LENGTH - K) // 2
REST = LENGTH - K - SIDE
PIECE = 1 << 21
PLACE_BITS = 22
STRINGS = 16_000
IN_MEMORY = 32 << 20
BROADCAST_ROWS = 200_000
START_BITS = 31  # a Spark value has less than 2^31 bytes
RUN_BITS = 8  # a run has at most SPAN windows
_NULL = -(1 << 63)
_CODES = mix(np.arange(501, 757, dtype=U))


def block_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the K-byte strings that start at each place."""
    h = _CODES[data]
    width = 1
    while width < K:
        h = h[:-width] * U(0x9FB21C651E98DF25 + 2 * width) + h[width:]
        h ^= h >> U(29)
        width *= 2
    return h * U(0xD6E8FEB86659FD93)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor place, anchor hash) of each run; offsets: where texts begin, at most 2^22 bytes in all."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.view(U)
    h = block_hashes(data)
    least = (h & ~U((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=U)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    anchor = (least & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    n = len(anchor)  # windows
    inside = np.ones(n, bool)
    steps = np.zeros(n + 1, np.int32)  # the last LENGTH - 1 places of a text start no window
    np.add.at(steps, np.minimum(np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1]), n), 1)
    np.add.at(steps, np.minimum(offsets[1:], n), -1)
    inside = np.cumsum(steps[:-1]) == 0
    new = inside & np.r_[True, ~inside[:-1] | (anchor[1:] != anchor[:-1])]
    end = inside & np.r_[~inside[1:] | (anchor[1:] != anchor[:-1]), True]
    start = np.flatnonzero(new)
    return start, np.flatnonzero(end) - start + 1, anchor[start], h[anchor[start]]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, nr = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(nr, nr + n))], ["id", "h1", "h2", "part", "nr"])
        nr += n


def with_versions(rows: DataFrame) -> DataFrame:
    """rows (id, text, ...) with version: 0, or the place of the row's text among those of ids that have several."""
    spark, null = rows.sparkSession, F.col("id").isNull()
    keyed = rows.withColumns({"h1": F.xxhash64(null, "text"), "h2": F.xxhash64(F.lit(2), null, "text")}).withColumn("id", F.coalesce("id", F.lit(_NULL)))
    keys = keyed.select("id", "h1", "h2")
    ends = keys.groupBy("id").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("h1", "h2")))
    several = cut(ends.where("min_h1 <> max_h1 or min_h2 <> max_h2").select("id"))
    if several.isEmpty():
        return keyed.drop("h1", "h2").withColumn("version", F.lit(0).cast("long"))
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    own = keys.join(small(several, several.count()), "id", "left_semi").distinct()
    ordered = table(own.repartitionByRange("id", "h1", "h2").sortWithinPartitions("id", "h1", "h2").mapInArrow(_number, "id long, h1 long, h2 long, part int, nr long"))
    counts = sorted((r.part, r.n) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # a number for each partition
    total = sum(n for _, n in counts)
    if total >> (63 - START_BITS):
        raise ValueError("more different texts under repeated ids than can be numbered")
    before = spark.createDataFrame([(part, sum(n for _, n in counts[:k])) for k, (part, _) in enumerate(counts)], "part int, before long")
    versions = ordered.join(F.broadcast(before), "part").select("id", "h1", "h2", (F.col("before") + F.col("nr") + 1).alias("version"))
    found = keyed.join(small(versions, total), ["id", "h1", "h2"], "left").drop("h1", "h2").withColumn("version", F.coalesce("version", F.lit(0)))
    return found if total <= BROADCAST_ROWS else table(found)


def _pieces(batch: pa.RecordBatch, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row, first place) of runs of texts, long texts in overlapping pieces that share no window."""
    for a, b, data, offsets in slices(batch.column("text"), limit):
        if len(data) <= 2 * limit:
            yield data, offsets, np.arange(a, b), np.zeros(b - a, np.int64)
            continue
        for low in range(0, len(data) - LENGTH + 1, limit):  # one text
            part = data[low : low + limit + LENGTH - 1]
            yield part, np.array([0, len(part)]), np.array([a]), np.array([low])


def _first_of(a: np.ndarray, b: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, new, leader): rows sorted by (a, b, id, place), where each (a, b) begins, and each row's first of its kind."""
    order = np.lexsort((place, ids, b, a))
    x, y = a[order], b[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])] if len(x) else np.zeros(0, bool)
    return order, new, order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(x) else order


def _rows(kind: int, anchor, run, ids, place, n) -> pa.RecordBatch:
    size = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, np.int8)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (anchor, run, ids, place)), pa.array(n.astype(np.int32))],
        ["kind", "anchor", "run", "id", "place", "n"],
    )


RUN_SCHEMA = "kind tinyint, anchor long, run long, id long, place long, n int"
ONLY, CUT, SHARED = 0, 1, 2


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        version = batch.column("version").to_numpy(zero_copy_only=False).astype(np.int64)
        for data, offsets, row, low in _pieces(batch):
            start, n, at, anchor = runs(data, offsets)
            if not len(start):
                continue
            run = range_hashes(data, start, start + n + LENGTH - 1)
            text = np.searchsorted(offsets, start, "right") - 1
            place = (version[row[text]] << START_BITS) + low[text] + start - offsets[text]
            own = ids[row[text]]
            order, new, leader = _first_of(anchor, run, own, place)
            first = order[new]
            yield _rows(ONLY, anchor[first], run[first], own[first], place[first], n[first] + ((at - start)[first] << RUN_BITS))
            late = order[~new & ((own[order] != own[leader]) | (place[order] != place[leader]))]
            yield _rows(CUT, own[late], place[late], own[late], place[late], n[late])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, run, id, place): later rows of a run as CUT; first rows of an anchor's several runs as SHARED.

    n of a row that isn't CUT also tells how far from the run's start its anchor stands.
    """
    last, pending = None, None  # the row that leads the last run; the same while its anchor has no other run
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        cut = kind == CUT
        if cut.any():
            yield batch.filter(pa.array(cut))
        anchor, run, ids, place, n = (batch.column(c).to_numpy(zero_copy_only=False)[~cut] for c in ("anchor", "run", "id", "place", "n"))
        if not len(anchor):
            continue
        before = (last[0], last[1]) if last else (~anchor[0], 0)
        new_anchor = np.r_[anchor[0] != before[0], anchor[1:] != anchor[:-1]]
        new = new_anchor | np.r_[run[0] != before[1], run[1:] != run[:-1]]
        begins = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        lead_id = np.where(which >= 0, ids[begins[np.maximum(which, 0)]] if len(begins) else 0, last[2] if last else 0)
        lead_place = np.where(which >= 0, place[begins[np.maximum(which, 0)]] if len(begins) else 0, last[3] if last else 0)
        late = ~new & ((ids != lead_id) | (place != lead_place))
        yield _rows(CUT, ids[late], place[late], ids[late], place[late], n[late] & ((1 << RUN_BITS) - 1))
        if not len(begins):
            continue
        # runs that lead, by anchor; the first anchor may have begun in an earlier batch
        group = np.cumsum(new_anchor[begins])
        count = np.bincount(group)
        shared = count[group] > 1
        if last and not new_anchor[begins[0]]:
            shared |= group == group[0]
            if pending:
                yield _rows(SHARED, *(np.array([x]) for x in pending))
                pending = None
        if group[-1] > 0 or not last:
            pending = None
        open_one = group == group[-1]
        hold = open_one & ~shared
        go = begins[shared]
        yield _rows(SHARED, anchor[go], run[go], ids[go], place[go], n[go])
        row = lambda i: tuple(int(x[i]) for x in (anchor, run, ids, place, n))
        if hold.any():
            pending = row(begins[hold][0])
        elif open_one.any() and shared[open_one].any():
            pending = None
        last = row(begins[-1])


STRING_SCHEMA = "group long, id long, place long, before int, bytes binary"


def sides(data: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(run, group, offset in the run, bytes before the common ones, first range, second range) of the strings of runs.

    For each run: its windows with SIDE bytes or more before the anchor, and the others, which have as many after it; each
    without the bytes that the group has in common, and so in two ranges of places of data.
    """
    near = anchor - start
    left = np.minimum(n, np.maximum(0, near - SIDE + 1))
    k = np.flatnonzero(left > 0)
    a, s = anchor[k], start[k]
    yield k, mix(range_hashes(data, a - SIDE, a + K) + U(1)), np.zeros(len(k), np.int64), near[k] - SIDE, (s, a - SIDE), (a + K, s + left[k] + LENGTH - 1)
    k = np.flatnonzero(left < n)
    a, s = anchor[k], start[k]
    yield k, mix(range_hashes(data, a, a + K + SIDE) + U(2)), left[k], near[k] - left[k], (s + left[k], a), (a + K + SIDE, s + n[k] + LENGTH - 1)


def _two_ranges(data: np.ndarray, one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """data[one] + data[two] of each string."""
    first = np.stack([one[0], two[0]], 1).ravel()
    size = np.stack([one[1] - one[0], two[1] - two[0]], 1).ravel()
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    ends = np.r_[0, np.cumsum(size)[1::2]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(one[0]), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[at].tobytes())])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of each text's shared runs."""
    for batch in batches:
        ids, version = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "version"))
        spans = batch.column("spans")
        flat, first = spans.flatten(), np.r_[0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        starts, counts = flat.field("start").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, data, offsets in slices(batch.column("text"), PIECE):
            own = slice(first[a], first[b])
            row = np.repeat(np.arange(a, b), np.diff(first[a : b + 1]))
            start, n, near = starts[own], counts[own] & ((1 << RUN_BITS) - 1), counts[own] >> RUN_BITS
            for low in range(0, max(1, len(data)), PIECE) if len(data) > 2 * PIECE else (0,):
                if len(data) > 2 * PIECE:  # one text, taken in pieces
                    part, some = data[low : low + PIECE + 2 * LENGTH], np.flatnonzero((start >= low) & (start < low + PIECE))
                    s = start[some] - low
                else:
                    part, some = data, np.arange(len(start))
                    s = start + offsets[row - a]
                for k, group, offset, before, one, two in sides(part, s, n[some], s + near[some]):
                    r, place = row[some[k]], start[some[k]] + offset
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group.view(np.int64)), pa.array(ids[r]), pa.array((version[r] << START_BITS) + place), pa.array(before.astype(np.int32)), _two_ranges(part, one, two)],
                        ["group", "id", "place", "before", "bytes"],
                    )


def repeats(data: np.ndarray, first: np.ndarray, group: np.ndarray, before: np.ndarray, ids: np.ndarray, places: np.ndarray, folder: str) -> tuple[np.ndarray, ...]:
    """(string, offset, late) of the windows, by the strings' transform and common prefixes: late ones also start earlier.

    Rows that aren't late are the first of their kind. group: less than 2^32.
    """
    _, shared, string, length = construct(data, first, folder if len(data) > IN_MEMORY else None)
    window = length >= REST
    same = np.cumsum(shared < REST)
    string, length, same = string[window].astype(np.int64), length[window], same[window]
    offset = np.diff(first)[string] - length
    i, p = ids[string], places[string] + offset
    # equal bytes in another group, or at another place of it, are another window
    order, new, leader = _first_of(same, group[string] * (LENGTH + 1) + before[string] - offset, i, p)
    fully = ~new & (i[order] == i[leader]) & (p[order] == p[leader])  # the same window of a repeated row
    return string[order[~fully]], offset[order[~fully]], ~new[~fully]


ORDERED_SCHEMA = "id long, place long, n int, group long, at int, window binary"


def _spans(ids: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Windows (id, place) as runs."""
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (places[1:] > places[:-1] + 1)]) if len(ids) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(ids)] - 1 if len(ids) else new
    n = places[last] - places[new] + 1 if len(ids) else new
    return pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(places[new]), pa.array(n.astype(np.int32)), *(pa.nulls(len(new), t) for t in (pa.int64(), pa.int32(), pa.binary()))], ["id", "place", "n", "group", "at", "window"])


def _order_strings(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Of strings sorted by (group, block): the runs of windows that start earlier too; of dealt groups also the first windows."""

    def build(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group, ids, places, before = (rows.column(c).to_numpy().astype(np.int64) for c in ("group", "id", "place", "before"))
        dealt = rows.column("blocks").to_numpy() > 1
        _, number, count = np.unique(group, return_inverse=True, return_counts=True)
        keep = np.flatnonzero((count[number] > 1) | dealt)  # a string alone in its group repeats nothing
        if not len(keep):
            return
        data, first = next((d, o) for _, _, d, o in slices(rows.column("bytes").take(pa.array(keep)), 1 << 62))
        s, offset, late = repeats(data, first, number[keep], before[keep], ids[keep], places[keep], folder)
        own = keep[s]
        yield _spans(ids[own[late]], places[own[late]] + offset[late])
        lead = np.flatnonzero(~late & dealt[own])
        for k in (lead[at : at + 65536] for at in range(0, len(lead), 65536)):
            at, o = first[s[k]] + offset[k], own[k]
            windows = _two_ranges(data, (at, at + REST), (at, at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[o]), pa.array(places[o] + offset[k]), pa.array(np.ones(len(k), np.int32)), pa.array(group[o]), pa.array((before[o] - offset[k]).astype(np.int32)), windows],
                ["id", "place", "n", "group", "at", "window"],
            )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= STRINGS:
            rows = pa.Table.from_batches(held)
            key = np.stack([rows.column(c).to_numpy() for c in ("group", "block")], 1)
            borders = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            whole = int(borders[-1]) if len(borders) else 0
            if whole:
                yield from build(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
    if held:
        yield from build(pa.Table.from_batches(held))


def cut_spans(rows: DataFrame) -> DataFrame:
    """(id, place, n): runs of n windows from a place on that all start earlier too. rows: (id, version, text as binary)."""
    folder = f"{shared_folder(rows.sparkSession)}"
    folder = folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder
    emitted = rows.mapInArrow(_emit_runs, RUN_SCHEMA)
    found = table(emitted.repartition("anchor").sortWithinPartitions("anchor", "run", "id", "place").mapInArrow(_classes, RUN_SCHEMA))
    start = F.expr(f"place & {(1 << START_BITS) - 1}").alias("start")
    version = F.shiftright("place", START_BITS).alias("version")
    shared = found.where(F.col("kind") == SHARED).groupBy("id", version).agg(F.collect_list(F.struct(start, "n")).alias("spans"))
    strings = table(rows.join(shared, ["id", "version"]).mapInArrow(_strings, STRING_SCHEMA))
    large = cut(strings.groupBy("group").count().where(F.col("count") > STRINGS).select("group", F.ceil(F.col("count") / STRINGS).cast("int").alias("blocks")))
    n_large = large.count()
    dealt = strings.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "place"), F.col("blocks")).cast("int"))
    ordered = dealt.repartition("group", "block").sortWithinPartitions("group", "block", "id", "place").mapInArrow(partial(_order_strings, folder=folder), ORDERED_SCHEMA)
    cuts = found.where(F.col("kind") == CUT).select("id", "place", "n")
    if not n_large:
        return cuts.unionByName(ordered.select("id", "place", "n"))
    ordered = table(ordered)
    leads = ordered.where("window is not null")
    firsts = leads.groupBy("group", "at", "window").agg(F.min(F.struct("id", "place")).alias("first"))
    late = leads.join(firsts, ["group", "at", "window"]).where("id <> first.id or place <> first.place")
    return cuts.unionByName(ordered.where("window is null").select("id", "place", "n")).unionByName(late.select("id", "place", "n"))


def _mark(text: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(which bytes are cut, their maximal runs)."""
    steps = np.zeros(len(text) + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + counts + LENGTH - 1, len(text)), -1)
    gone = np.cumsum(steps[:-1]) > 0
    return gone, int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(text) else 0


def _apply(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        flat, first = spans.flatten(), np.r_[0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        starts, counts = flat.field("start").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        out = []
        for k, text in enumerate(batch.column("text").to_pylist()):
            text = text or b""
            if first[k] == first[k + 1]:
                out.append((len(text), 0, 0, text))
            else:
                gone, n_spans = _mark(text, starts[first[k] : first[k + 1]], counts[first[k] : first[k + 1]])
                out.append((len(text), int(gone.sum()), n_spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
        columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        digests = pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())
        kept = columns[3] if with_bytes else pa.nulls(len(out), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("nr"), batch.column("payload"), *columns[:3], digests, kept], ["id", "payload", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes (null unless with_bytes) for the text; other columns stay."""
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")
    others = [c for c in docs.columns if c not in (key, text, *new)]
    body = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    base = docs.select(F.col(f"`{key}`").cast("long").alias("nr"), F.col(f"`{key}`").cast("long").alias("id"), body.alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("payload"))
    base = with_versions(base)
    spans = cut_spans(base.select("id", "version", "text"))
    start = F.expr(f"place & {(1 << START_BITS) - 1}").alias("start")
    grouped = spans.groupBy("id", F.shiftright("place", START_BITS).alias("version")).agg(F.collect_list(F.struct(start, "n")).alias("spans"))
    joined = base.join(grouped, ["id", "version"], "left").select("nr", "payload", "text", "spans")
    payload = joined.schema["payload"].dataType.simpleString()
    done = joined.mapInArrow(partial(_apply, with_bytes=with_bytes), f"id long, payload {payload}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return done.select(F.col("id").alias(key), *(F.col(f"payload.c{i}").alias(c) for i, c in enumerate(others)), *new)
