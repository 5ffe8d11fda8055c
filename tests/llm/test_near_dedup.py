"""MinHash near-dedup against all pairs."""

import random
import re

import numpy as np
import pytest

from tidelog.llm import minhash_dedup
from tidelog.llm.minhash_dedup import near_duplicates

WORDS = [f"w{i}" for i in range(400)]


def shingle_set(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width, percent=80):
    sets = {i: shingle_set(t, width) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u, v = sorted((root(i), root(j)))
                label[v] = u
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words = rng.choices(WORDS, k=rng.randint(1, 120))
        rows.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):  # near copies, in chains
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append(rng.choice((" ", "\n", "\t ")).join(words).upper() if rng.random() < 0.3 else " ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(900, None), (901, ""), (902, " \t\n"), (903, None), (904, "one"), (905, "One"), (906, "É é É"), (907, "é é é")]


@pytest.mark.parametrize("width", [4, 5])
def test_all_pairs(spark, width):
    rows = corpus(width)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, width) and len(got) == len(rows)


def test_large_groups_are_searched_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "GROUP_BYTES", 20_000)
    rng = random.Random(5)
    base = rng.choices(WORDS, k=200)
    rows = []
    for i in range(120):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_large_groups_are_thinned_by_signatures(spark, monkeypatch):
    """Texts in which each shares a third with the next, and near copies of some: one chain of candidates, many classes."""
    monkeypatch.setattr(minhash_dedup, "GROUP_BYTES", 2_000)
    monkeypatch.setattr(minhash_dedup, "SIGNATURES", 20)
    rng = random.Random(11)
    parts = [[f"p{k}_{i}" for i in range(60)] for k in range(81)]
    rows = [(k, " ".join(parts[k] + parts[k + 1])) for k in range(80)]
    rows += [(100 + k, " ".join(w for i, w in enumerate(parts[k] + parts[k + 1]) if i != 50 + k % 20)) for k in range(0, 80, 3)] + corpus(6)[:100]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rng.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 4)


def test_thresholds_that_the_signatures_are_not_made_for(spark):
    with pytest.raises(ValueError, match="would miss"):
        near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=50)
    assert minhash_dedup.missed(0.8) < 1e-7 and minhash_dedup.missed(0.7) < minhash_dedup.MISS


def test_the_contract_query(spark):
    from tidelog.llm.registry import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op5_minhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute([(d.doc_id, d.text) for d in docs], 4)


def test_odd_rows(spark):
    text = " ".join(WORDS[:50])
    rows = [(5, text), (None, text), (3, text), (5, "other words entirely here now"), (7, "other words entirely here now"), (9, " ".join(f"y{i}" for i in range(50_000)))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = sorted((r.id is None, r.id or 0, r.component_id, r.kept) for r in got)
    # the two texts of id 5 belong together, and so do their copies
    assert by == [(False, 3, 3, True), (False, 5, 3, False), (False, 5, 3, False), (False, 7, 3, False), (False, 9, 9, True), (True, 0, None, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_signatures_share_a_key():
    """The pigeonhole: up to 31 differing positions, however placed two a chunk at worst, leave a chunk with one at most."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 256, (1, minhash_dedup.HASHES)).astype(np.uint8)
        b = a.copy()
        at = rng.permutation(minhash_dedup.HASHES)[: 2 * minhash_dedup.CHUNKS - 1]
        b[0, at] ^= 1 + rng.integers(0, 255, len(at)).astype(np.uint8)
        assert set(minhash_dedup.keys(a)[0].tolist()) & set(minhash_dedup.keys(b)[0].tolist())
