"""Mixing, the quality classifier and chroma fingerprints."""

import io
import random
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import audio_match, chroma, pu_quality
from tidelog.llm.audio_match import align, align_one
from tidelog.llm.mixing import mix
from tidelog.llm.pu_quality import THRESHOLD, estimated_prior, keep_good, score


def test_marginals_are_met(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 40))), rng.choices("abc", (8, 1, 1))[0], rng.choice(["en", "de"])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = [{"a": 0.4, "b": 0.3, "c": 0.3}, {"en": 0.7, "de": 0.3}, 1.0]
    out = mix(docs, F.col("source"), F.col("lang"), F.lit("one"), targets, 0.1).toPandas()
    out["w"] = out.n_tokens * out.probability
    for column, target in (("source", targets[0]), ("lang", targets[1])):
        share = out.groupby(column).w.sum() / out.w.sum()
        assert all(abs(share[k] - v) < 1e-3 for k, v in target.items())
    assert abs(out.w.sum() / out.n_tokens.sum() - 0.1) < 1e-3
    assert abs(out.n_tokens[out.drawn].sum() / out.w.sum() - 1) < 0.15
    again = mix(docs.repartition(7), F.col("source"), F.col("lang"), F.lit("one"), targets, 0.1).where("drawn").select("doc_id").toPandas()
    assert set(again.doc_id) == set(out.doc_id[out.drawn])


def test_odd_rows_of_a_mixture(spark):
    rows = [(1, "a b", None, "en"), (1, "a b", None, "en"), (None, None, "s", None), (2, "", "s", "de"), (3, "x " * 50_000, "t", "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, lang string, ratio double")
    out = mix(docs, F.col("source"), F.col("lang"), F.lit(None), [0.5, {}, 1.0], 1.0).collect()
    assert len(out) == 5 and all(0 <= r.probability <= 1 for r in out) and {r.topic for r in out} == {"(none)"}
    assert {r.probability for r in out if r.source is None} == {1.0}
    assert mix(docs.where("false"), F.col("source"), F.col("lang"), F.lit("x"), [0.5, {}, 1.0], 1.0).count() == 0


def texts(seed, n):
    """Prose, and four kinds of junk, with labels for some."""
    rng = random.Random(seed)
    syllables = "the and ti on er ing at en re st ou ha nd es".split()
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(8, 120))]
        kind = rng.choices(range(5), (86, 4, 4, 3, 3))[0]
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif kind == 2:
            words = [w + rng.choice(["***", "$$$", "###"]) for w in words]
        elif kind == 3:
            words = [x for w in words for x in (w, "|")]
        elif kind == 4:
            words = [words[0]] * len(words)
        else:
            words = [w + rng.choices(["", ",", "."], (8, 1, 1))[0] for w in words]
        rows.append((i, " ".join(words), int(kind == 0)))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = texts(1, 4000)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3], "doc_id long, quality int")
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(q, got[i].score) for i, _, q in rows if got[i].held_out]
    assert np.mean([s >= THRESHOLD for q, s in held if q]) >= 0.99 and np.mean([s < THRESHOLD for q, s in held if not q]) >= 0.9
    # what it learns from are positives and text: turning the labels of held-out rows changes nothing
    turned = labels.withColumn("quality", F.when(pu_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: round(r.score, 4) for r in score(docs, turned).collect()} == {i: round(r.score, 4) for i, r in got.items()}
    kept = {r.doc_id for r in keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_odd_rows_of_the_classifier(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "some text", 0.5), (7, "word " * 50_000, 0.5)], "doc_id long, text string, score double")
    out = score(docs, labels).collect()  # no clear positive: every score is the prior
    assert len(out) == 4 and {r.score for r in out} == {pu_quality.PRIOR} and keep_good(docs, labels).count() == 4
    one = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in score(docs, one).collect())
    assert score(docs.where("false"), labels).count() == 0


def test_the_prior():
    rng = np.random.default_rng(1)
    good, bad = rng.beta(8, 2, 100_000), rng.beta(2, 8, 100_000)
    bins = lambda x: np.bincount((x * 1000).astype(int), minlength=1000)
    assert abs(estimated_prior(bins(np.r_[good[:70_000], bad[:30_000]]), bins(good[70_000:])) - 0.7) < 0.05


def wav(samples, rate=chroma.RATE, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(np.repeat((np.clip(samples, -1, 1) * 32000).astype("<i2"), channels).tobytes())
    return out.getvalue()


def song(seed, seconds=12.0, rate=chroma.RATE):
    rng = np.random.default_rng(seed)
    n, note = int(seconds * rate), int(0.25 * rate)
    t = np.arange(n) / rate
    out = np.zeros(n)
    for at in range(0, n, note):
        for k in rng.choice(36, 3, replace=False):
            out[at : at + note] += np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t[at : at + note])
    return out / 4


def brute_error(a, b):
    """The least share of differing bits at any offset with an overlap of half of the shorter one."""
    best = 2.0
    for shift in range(-len(b) + 1, len(a)):
        low, high = max(0, -shift), min(len(b), len(a) - shift)
        if (high - low) * 2 >= min(len(a), len(b)):
            best = min(best, np.bitwise_count(b[low:high] ^ a[low + shift : high + shift]).sum() / 32 / (high - low))
    return best


def test_recordings(spark):
    rng = np.random.default_rng(1)
    base = [song(k) for k in range(8)]
    rows = [(k, wav(s)) for k, s in enumerate(base)]
    for k, s in enumerate(base[:6]):
        rows.append((10 + k, wav(s * 0.5 + rng.standard_normal(len(s)) * 0.01)))  # quieter, with noise
        rows.append((20 + k, wav(np.r_[np.zeros(chroma.HOP * 6), s][: len(s)])))  # begins later
    rows += [(30, wav(base[0])), (31, wav(song(0, rate=22050), 22050, 2)), (40, None), (41, b""), (42, b"RIFF no sound"), (43, wav(base[1][:2000])), (44, wav(np.zeros(60_000))), (None, wav(base[0]))]
    got = {r.id: r for r in align(spark.createDataFrame([(*r, "own") for r in rows], "id long, media binary, codes string")).collect()}
    assert len(got) == len(rows)
    for k in range(6):
        assert got[10 + k].class_id == got[20 + k].class_id == k and got[10 + k].bit_error <= 0.1
        assert abs(abs(got[20 + k].offset) - 6) <= 1 or got[20 + k].aligned_id != k
    assert got[30].class_id == 0 and got[30].aligned_id == 0 and (got[30].offset, got[30].bit_error) == (0, 0.0) and got[31].class_id == 0
    assert all(got[k].class_id == k and got[k].kept for k in (*range(8), 40, 41, 42, 43, 44)) and got[None].kept and got[None].class_id is None
    assert got[40].n_codes == got[43].n_codes == 0 and got[44].n_codes > 0
    assert align(spark.createDataFrame([], "id long, media binary")).count() == 0


def test_alignment_finds_the_best_offset():
    rng = np.random.default_rng(2)
    p = rng.integers(0, 2**32, 200, dtype=np.uint32)
    other = p[37:150].copy()
    flips = rng.random((len(other), 32)) < 0.05
    other ^= (flips * (1 << np.arange(32, dtype=np.uint64))).sum(1).astype(np.uint32)
    offset, error = align_one(p, np.r_[other, rng.integers(0, 2**32, 90, dtype=np.uint32)], np.array([0, len(other), len(other) + 90, len(other) + 90]))
    assert offset[0] == 37 and error[0] == pytest.approx(brute_error(p, other)) and error[1] > 0.3 and error[2] == 2.0


def _codes(n, seed, places=48):
    return np.random.default_rng(seed).integers(0, 2**32, (n, places), dtype=np.uint32)


def _flipped(codes, share, seed):
    flips = np.random.default_rng(seed).random((*codes.shape, 32)) < share
    return codes ^ (flips * (1 << np.arange(32, dtype=np.uint64))).sum(-1).astype(np.uint32)


def _frame(spark, codes):
    return spark.createDataFrame([(k, bytearray(c.astype("<u4").tobytes())) for k, c in enumerate(codes)], "node long, data binary").repartition(8)


def test_recall_in_a_crowd(spark):
    """Lone pairs among 10,000 other recordings, by their share of differing bits."""
    base = _codes(600, 5)
    shares = np.repeat([0.08, 0.1, 0.12], 200)
    copies = np.stack([_flipped(c, s, 100 + k) for k, (c, s) in enumerate(zip(base, shares, strict=True))])
    found = {(min(r), max(r)) for r in audio_match.tested_links(_frame(spark, np.concatenate([base, _codes(10_000, 6), copies])), 0.2).collect()}
    recall = [np.mean([(k, k + 10_600) in found for k in np.flatnonzero(shares == s)]) for s in (0.08, 0.1, 0.12)]
    assert recall[0] >= 0.98 and recall[1] >= 0.9 and recall[2] >= 0.75, recall


def test_keys_whose_first_holder_is_another(spark):
    """Pairs that share all their keys with one unlike recording of a smaller number, which leads them."""
    pairs = _codes(20, 7)
    unlike = np.concatenate([np.concatenate([_codes(1, 50 + k, 30)[0], p[:18]])[None] for k, p in enumerate(pairs)])
    near = pairs.copy()
    near[:, 18:] ^= np.uint32(1 << 4 | 1 << 12 | 1 << 20 | 1 << 28)  # near, without a part that a key takes
    codes = np.concatenate([unlike, pairs, near])
    one, three = ({(min(r), max(r)) for r in audio_match.tested_links(_frame(spark, codes), 0.12, rounds).collect()} for rounds in (1, 6))
    count = lambda found: sum((20 + k, 40 + k) in found for k in range(20))
    assert count(one) <= 3 and count(three) >= 15


def test_short_recordings(spark):
    rng = np.random.default_rng(12)
    tone = song(3, seconds=2.6)
    rows = [(1, wav(tone)), (2, wav(tone * 0.7 + rng.standard_normal(len(tone)) * 0.003)), (3, wav(song(4, seconds=2.6)))]
    got = {r.id: r for r in align(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert 1 < got[1].n_codes <= audio_match.LAG and got[2].class_id == got[1].class_id == 1 and got[3].class_id == 3


def test_samples_of_24_bits():
    x = song(1, 1.0)
    raw = np.ascontiguousarray((x * (1 << 22)).astype("<i4")[:, None].view(np.uint8).reshape(-1, 4)[:, :3])
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1), file.setsampwidth(3), file.setframerate(chroma.RATE)
        file.writeframes(raw.tobytes())
    assert np.allclose(chroma.read_wav(out.getvalue()), x / 2, atol=1e-5)


def test_recall_of_near_recordings(spark):
    """Played vectors with a cosine of about 0.985, against alignment of all pairs."""
    from tidelog.llm.op4_query import play

    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        v = rng.standard_normal(64)
        rows += [(2 * k, v.tolist()), (2 * k + 1, (v + rng.standard_normal(64) * 0.17).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in align(df, "vec_id", "embedding", play).collect()}
    codes = {i: audio_match.codes_of(bytes(r.codes)) for i, r in got.items()}
    near = [(i, j) for i in codes for j in codes if i < j and brute_error(codes[i], codes[j]) <= audio_match.MAX_ERROR]
    assert len(near) >= 55
    assert np.mean([got[i].class_id == got[j].class_id for i, j in near]) >= 0.95


def test_no_link_is_left_out(spark, monkeypatch):
    """Lone pairs near the limit that share no key, and links that keys lead to not at all."""
    base = _codes(200, 21)
    codes = np.concatenate([base, _flipped(base, 0.115, 22)])
    error = lambda p, q: audio_match.align_one(p, q, np.array([0, len(q)]))[1][0]
    want = {(i, i + 200) for i in range(200) if error(codes[i], codes[i + 200]) <= 0.12}
    reps = _frame(spark, codes)
    by_keys = {(min(r), max(r)) for r in audio_match.tested_links(reps, 0.12).collect()}
    rest = audio_match.links_between(reps, spark.createDataFrame([(b, a) for a, b in by_keys] + [(a, a) for a, _ in by_keys], "node long, component long"), 0.12).collect()
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in rest}
    assert len(want) > 100 and found and not found & by_keys and by_keys | found >= want
    assert all(r.error == pytest.approx(brute_error(codes[r.a], codes[r.b])) and r.offset == 0 for r in rest)
    monkeypatch.setattr(audio_match, "tested_links", lambda reps, *_: spark.createDataFrame([], "a long, b long"))
    rows = [(1, wav(song(1))), (2, wav(song(1) * 0.5)), (3, wav(song(2)))]
    assert {r.id: r.class_id for r in align(spark.createDataFrame(rows, "id long, media binary")).collect()} == {1: 1, 2: 1, 3: 3}


def _study(spark, sf):
    """(measures, trusted, labels, held out) of a small table."""
    folder = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    raw = [(t or "").encode() for t in docs["text"]]
    x = pu_quality.measures(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])]).astype(np.float64)
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in docs["doc_id"]])
    return x, held, np.array([labels.get(i, -1) for i in docs["doc_id"]])


def test_least_non_negative_risk(spark):
    """The fitted weights against the risk written out plainly: no other weights nearby, and no far ones, have a lower one."""
    x, held, label = _study(spark, "sf0.01")
    x, trusted = x[~held], label[~held] == 1
    rows = spark.createDataFrame([(bytearray(v.astype(np.float32).tobytes()), bool(t), k % 2 == 0) for k, (v, t) in enumerate(zip(x, trusted, strict=True))], "x binary, trusted boolean, half boolean")
    for fixed in (None, 0.9):  # a prior that is too high brings the bracket to 0
        if fixed:
            own, pu_quality.estimated_prior = pu_quality.estimated_prior, lambda *_: fixed
        try:
            mean, scale, w, prior = pu_quality.fit(rows.repartition(5))
        finally:
            if fixed:
                pu_quality.estimated_prior = own
        assert np.allclose(mean, x.mean(0)) and np.allclose(scale, x.std(0) + 1e-3, rtol=1e-4)
        points = np.c_[np.ones(len(x)), np.clip((x - mean) / scale, -6, 6)]
        loss = lambda g: np.log1p(np.exp(-np.clip(g, -500, 500)))

        def risk(v):
            g = points @ v
            bracket = loss(-g).mean() - prior * loss(-g[trusted]).mean()
            return prior * loss(g[trusted]).mean() + max(0.0, bracket) + pu_quality.RIDGE / 2 * (v[1:] ** 2).sum(), bracket

        least, bracket = risk(w)
        assert bracket > -1e-3 and (fixed is None or bracket < 1e-3)
        rng = np.random.default_rng(8)
        for size in (1e-3, 1e-2, 0.1, 1.0):
            assert all(risk(w + size * rng.standard_normal(len(w)))[0] >= least - 1e-4 for _ in range(100))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_labels(spark, sf):
    folder = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = pu_quality.score(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").toPandas()
    bad, good = found[found["quality"] == 0], found[found["quality"] == 1]
    assert bad["predicted"].mean() < 0.1 and good["predicted"].mean() > 0.99
    assert np.mean(good["score"].to_numpy()[:, None] > bad["score"].to_numpy()[None, :]) > 0.99
