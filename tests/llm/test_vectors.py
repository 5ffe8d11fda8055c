"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from tidelog.llm import vector_dedup
from tidelog.llm.graph import components
from tidelog.llm.vector_dedup import DEALT, _by_all_pairs, _by_windows, near_vectors, passes_for, passes_in, stars


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in good])
    while True:
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(good))])
        if (new == label).all():
            break
        label = new
    out = {i: (0, i, True) for i, _ in rows}
    return out | {i: (int(near[k].sum()), int(label[k]), bool(label[k] == i)) for k, (i, _) in enumerate(good)}


def rows_of(seed, dims=16):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for size in (1,) * 150 + (2,) * 20 + (40, 300):
        base = rng.standard_normal(dims)
        for _ in range(size):
            rows.append((n, (base + rng.standard_normal(dims) * 0.08 * np.linalg.norm(base) / dims**0.5).astype(np.float32).tolist()))
            n += 1
    rows += [(1000 + k, rows[0][1]) for k in range(30)] + [(1100, [2 * v for v in rows[0][1]])]  # exact copies, and a longer one
    return rows + [(2000, None), (2001, []), (2002, [0.0] * dims), (2003, [float("nan")] + [1.0] * (dims - 1)), (2004, [None] + [1.0] * (dims - 1)), (2005, [float("inf")] * dims)]


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}


def test_all_pairs(spark):
    rows = rows_of(1)
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Lone pairs just above the threshold, the hardest to find."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(1500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cosine = 0.9505 + 0.002 * rng.random()
        rows += [(2 * k, a.tolist()), (2 * k + 1, (cosine * a + (1 - cosine**2) ** 0.5 * b).tolist())]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").count()
    assert found >= 0.98 * len(rows)


@pytest.mark.parametrize("ranges", [1, 51, 211])
def test_recall_over_borders(spark, ranges):
    """The windows alone, over few and many ranges, also ranges shorter than a window."""
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((1500, 64)))
    y = rng.standard_normal((1500, 64))
    y = unit(y - (y * x).sum(1, keepdims=True) * x)
    both = np.concatenate([x, 0.952 * x + (1 - 0.952**2) ** 0.5 * y])
    reps = spark.createDataFrame([(i, v.astype("<f8").tobytes()) for i, v in enumerate(both)], "node long, x binary")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        links = {(min(r), max(r)) for r in _by_windows(reps, 70_000, passes_for(3000, 0.95, 128), "<f8", 0.95, 128).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sum((i, i + 1500) in links for i in range(1500)) >= 0.99 * 1500


def test_odd_rows(spark):
    v, w, short = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0]
    rows = [(1, v, 7), (1, w, 8), (2, v, 9), (3, w, 10), (None, v, 11), (4, short, 12), (5, short, 13)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in out) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False)]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_stars_and_passes():
    near = np.zeros((5, 5), bool)
    near[0, 3] = near[3, 4] = near[1, 2] = True
    assert stars(near).tolist() == [0, 1, 1, 0, 0]
    assert passes_for(100, 0.95, 128) <= passes_for(10**6, 0.95, 128) <= passes_for(10**9, 0.95, 128) < 200


def cone(n, cosine=0.85, pairs=300, dims=64):
    """n vectors, a third of them at this cosine of each other; the first `pairs` have a partner at 0.953 inside the cone, at the end."""
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x, axis = unit(rng.standard_normal((n, dims))), unit(rng.standard_normal(dims))
    off = rng.standard_normal((n // 3, dims))
    off = unit(off - (off @ axis)[:, None] * axis)
    x[: n // 3] = cosine**0.5 * axis + (1 - cosine) ** 0.5 * off
    turn = rng.standard_normal((pairs, dims))
    turn -= (turn @ axis)[:, None] * axis
    turn = unit(turn - (turn * off[:pairs]).sum(1)[:, None] * off[:pairs])
    near = (0.953 - cosine) / (1 - cosine)
    x[n - pairs :] = cosine**0.5 * axis + (1 - cosine) ** 0.5 * (near * off[:pairs] + (1 - near**2) ** 0.5 * turn)
    return x


def test_recall_in_a_cone(spark):
    """Pairs at the threshold among thousands of vectors that are near them without being links."""
    x = cone(20_000)
    want = {i: int(k) for i, k in enumerate((x @ x.T >= 0.95).sum(1) - 1)}
    got = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).select("vec_id", "n_links").collect()
    assert sum(k > 0 for k in want.values()) >= 600 and {r.vec_id: r.n_links for r in got} == want


def test_passes_follow_the_crowd():
    x = cone(30_000)
    passes, found, place = passes_in(x[::15], len(x), 0.95, 128), np.zeros(300, bool), np.empty(len(x), int)
    assert passes > 3 * passes_for(len(x), 0.95, 128)
    for turn in range(passes):
        signs = x @ np.random.default_rng([5, turn]).standard_normal((64, 64)) > 0
        place[np.argsort(np.packbits(signs, axis=1).view(">u8").ravel())] = np.arange(len(x))
        found |= np.abs(place[:300] - place[-300:]) <= 128
    assert found.mean() >= 0.99


def test_windows_and_all_pairs_agree(spark):
    rows = [(i, np.array(v, "<f4").tobytes()) for i, v in rows_of(3) if i < 510]
    reps = spark.createDataFrame([(i, x, x) for i, x in rows], "node long, x binary, h binary")
    found = [{r.id: r.component for r in components(links).collect()} for links in (_by_windows(reps, len(rows), 8, "<f4", 0.95, 128), _by_all_pairs(reps, 3 * DEALT, "<f4", 0.95))]
    assert found[0] == found[1] and len(found[0]) > 300


def test_no_switch_to_windows(spark, monkeypatch):
    """Where passes would be cheaper than all pairs, no link is given up for that; only a caller who asks for it gets windows."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((1500, 64)))
    y = rng.standard_normal((1500, 64))
    y = unit(y - (y * x).sum(1, keepdims=True) * x)
    both = np.concatenate([x, 0.951 * x + (1 - 0.951**2) ** 0.5 * y])
    monkeypatch.setattr(vector_dedup, "measured_passes", lambda *_: 1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    found, fewer = ({r.vec_id: r.component_id for r in near_vectors(vectors, approximate=a).where("n_links = 1").collect()} for a in (False, True))
    assert found == {i: i % 1500 for i in range(3000)} and 0 < len(fewer) < 3000
