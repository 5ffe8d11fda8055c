"""Links between the ids that share a key: each to the smallest id of the key, with no list of a key's ids anywhere.

First among the rows of one slice of the input, so that a key held by a third of all rows leaves one row a slice, then
over all slices, in sorted order: only the last key is carried from one batch to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "key long, a long, b long"


def chain(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted order, new: where a key begins, leader: the smallest node of each row's key, in that order)."""
    order = np.lexsort((node, key))
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    return order, new, node[order][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(k) else node


def keyed_rows(key: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())], ["key", "a", "b"])


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = a != b
    pairs = np.unique(np.stack([a[keep], b[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def slice_rows(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each key of a slice and its smallest id; (leader, member) for the slice's other rows with that key."""
    order, new, leader = chain(key, node)
    yield keyed_rows(key[order][new], leader[new], None)
    a, b = distinct_pairs(leader, node[order])
    yield keyed_rows(b, a, b)


def chain_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition's keys; batches come sorted by key, and only the last key is carried over."""
    last_key, last_leader = None, None
    for batch in batches:
        b = batch.column("b")
        linked = np.asarray(b.is_valid())
        a = batch.column("a").to_numpy(zero_copy_only=False)
        if linked.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b.drop_null())], ["a", "b"])
        key, node = batch.column("key").to_numpy(zero_copy_only=False)[~linked], a[~linked]
        if not len(key):
            continue
        new = np.r_[key[0] != last_key if last_key is not None else True, key[1:] != key[:-1]]
        begins = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        leader = np.where(which >= 0, node[begins[np.maximum(which, 0)]] if len(begins) else 0, last_leader if last_leader is not None else 0)
        last_key, last_leader = key[-1], leader[-1]
        x, y = distinct_pairs(leader, node)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def links(emitted: DataFrame) -> DataFrame:
    """(a, b) from rows of slice_rows."""
    return emitted.repartition("key").sortWithinPartitions("key", "a").mapInArrow(chain_keys, "a long, b long").distinct()
