"""Suffix-array dedup against a scan of all windows."""

import hashlib
import random
import tempfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import suffix_dedup
from tidelog.llm.columnwise import construct
from tidelog.llm.suffix_dedup import LENGTH, deduplicate


def brute(rows):
    """rows: (id, text) with unique ids. Each: bytes, removed, spans, digest."""
    return brute_bytes({i: (text or "").encode() for i, text in rows})


def brute_bytes(texts):
    seen, out = set(), {}
    for i, data in sorted(texts.items()):
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - LENGTH + 1):
            window = data[at : at + LENGTH]
            if window in seen:
                gone[at : at + LENGTH] = True
            seen.add(window)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(data) else 0
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(spark, rows):
    found = deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}


def corpus(seed):
    rng = random.Random(seed)
    alphabet = "abcdefgh é\n"
    fresh = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [fresh(rng.randint(90, 400)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                s = rng.choice(shared)
                a = rng.randint(0, 40)
                parts.append(s[a : len(s) - rng.randint(0, 40)])
            else:
                parts.append(fresh(rng.randint(0, 150)))
        rows.append((i * 3, "".join(parts)))
    rows += [(500, None), (501, ""), (502, "a" * 350), (503, "ab" * 200), (504, "a" * 99), (505, rows[3][1]), (506, "x" * 100), (507, "x" * 100), (508, fresh(50) + "a" * 120)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_windows(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 4096)
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, text), (2, text[5000:26_000]), (3, "z" * 20_000), (4, text[::-1] + text[:4200])]
    assert got(spark, rows) == brute(rows)


def test_large_groups_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRINGS", 3)
    rows = corpus(4)
    assert got(spark, rows) == brute(rows)


def test_the_contract_query(spark):
    from tidelog.llm.registry import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op6_suffix_array_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute([(d.doc_id, d.text) for d in docs])


def test_odd_rows(spark):
    text = "".join(random.Random(3).choices("abcdef ", k=300))
    rows = [(None, text, 1), (4, text, 2), (4, text, 3), (5, text + "!", 4)]
    found = {r.n_bytes_2: r for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string, n_spans long").withColumnRenamed("n_spans", "n_bytes_2")).collect()}
    assert len(found) == 4 and found[1].n_removed == 0 and found[2].n_removed == found[3].n_removed == 300 and found[4].n_removed == 300
    assert bytes(found[4].kept_bytes) == b"!"
    assert deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = deduplicate(spark.createDataFrame([(1, text, 7)], "doc_id long, text string, n_bytes int")).first()
    assert clash.n_bytes == 300


def test_the_construction_decides(spark, monkeypatch):
    """Without the windows that the construction finds, texts keep bytes that repeat."""
    rows = corpus(1)
    whole = got(spark, rows)
    broken = "def broken(batches, folder):\n    for batch in batches:\n        pass\n    return iter(())\n"
    space = {}
    exec(broken, space)  # a function by value, so that Python workers get it too
    monkeypatch.setattr(suffix_dedup, "_order_strings", space["broken"])
    assert sum(x[1] for x in got(spark, rows).values()) < sum(x[1] for x in whole.values())


def test_many_rows_without_an_id(spark):
    """20,000 of them, in the order of their texts' hashes; and an id that is the least long, one that repeats, and bytes 255."""
    from pyspark.sql import functions as F

    rng = random.Random(7)
    shared = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(50)]
    texts = ["".join(rng.choices("abcdefgh ", k=rng.randint(0, 60))) + (s := rng.choice(shared))[(a := rng.randint(0, 200)) : a + rng.randint(0, 200)] for _ in range(20_000)]
    rows = [(None, t.encode()) for t in texts] + [(-(1 << 63), texts[5].encode()), (7, b"\xff" * 150), (7, b"\xff" * 90 + texts[6].encode()), (7, b"\xff" * 150)]
    docs = spark.createDataFrame([(k, i, bytearray(t)) for k, (i, t) in enumerate(rows)], "k int, doc_id long, text binary").repartition(7)
    null = F.col("doc_id").isNull()
    order = [(r.k, (r.id, r.h1, r.h2)) for r in docs.select("k", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64(null, "text").alias("h1"), F.xxhash64(F.lit(2), null, "text").alias("h2")).collect()]
    keys = dict(order)
    places = {key: n for n, key in enumerate(sorted(set(keys.values())))}
    expected = brute_bytes({places[keys[k]]: t for k, (_, t) in enumerate(rows)})
    found = deduplicate(docs).select("k", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert len(found) == len(rows)
    assert {r.k: tuple(r)[1:] for r in found} == {k: expected[places[keys[k]]] for k in range(len(rows))}


@given(st.lists(st.binary(min_size=1, max_size=12).map(lambda b: bytes((97, 98, 255)[x % 3] for x in b)), min_size=1, max_size=12), st.sampled_from([1, 2, 7, 1 << 20]))
@settings(max_examples=200, deadline=None)
def test_column_wise_construction(strings, block):
    first = np.r_[0, np.cumsum([len(s) for s in strings])]
    b, shared, string, length = construct(np.frombuffer(b"".join(strings), np.uint8), first, tempfile.gettempdir(), block)
    end = 256 if any(255 in s for s in strings) else 255
    suffixes = sorted((s[len(s) - n :], i, n) for i, s in enumerate(strings) for n in range(len(s) + 1))
    assert [(i, n) for _, i, n in suffixes] == list(zip(string.tolist(), length.tolist(), strict=True))
    assert [strings[i][len(strings[i]) - n - 1] if n < len(strings[i]) else end for _, i, n in suffixes] == b.tolist()
    common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    assert [0] + [common(x[0], y[0]) for x, y in zip(suffixes, suffixes[1:], strict=False)] == shared.tolist()


def test_stores_for_the_construction(tmp_path):
    strings = [b"abcab", b"bcabc", b"ab"]
    data, first = np.frombuffer(b"".join(strings), np.uint8), np.r_[0, np.cumsum([len(s) for s in strings])]
    found = [construct(data, first, folder, 3) for folder in (str(tmp_path), f"file://{tmp_path}", "nowhere://store/folder")]
    assert all((x == y).all() for other in found[1:] for x, y in zip(found[0], other, strict=True)) and not list(tmp_path.iterdir())
    with pytest.raises(ValueError):
        construct(np.zeros(300, np.uint8), np.array([0, 300]), str(tmp_path))


def test_small_constructions_need_no_disk(tmp_path, monkeypatch):
    """Its files are written anew each round, which took more time than the rounds; larger ones still go to the folder."""
    strings = [b"x" * 3 + b"y" * suffix_dedup.REST, b"z" + b"y" * suffix_dedup.REST]
    data, first = np.frombuffer(b"".join(strings), np.uint8), np.r_[0, np.cumsum([len(s) for s in strings])]
    args = data, first, np.zeros(2, np.int64), np.array([3, 1]), np.array([1, 2]), np.zeros(2, np.int64)
    (tmp_path / "file").touch()
    string, offset, late = suffix_dedup.repeats(*args, str(tmp_path / "file"))
    assert {(int(string[k]), int(offset[k])) for k in np.flatnonzero(late)} == {(1, 1)}
    monkeypatch.setattr(suffix_dedup, "IN_MEMORY", 0)
    with pytest.raises(OSError):
        suffix_dedup.repeats(*args, str(tmp_path / "file"))
    assert all((x == y).all() for x, y in zip((string, offset, late), suffix_dedup.repeats(*args, str(tmp_path)), strict=True))
