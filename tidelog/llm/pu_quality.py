"""Quality classifier by positive-unlabelled learning (non-negative unbiased risk).

Trusted positives are rows that a label marks as good; all other text, whatever its label, is unlabelled web text. With
a class prior p, the risk of a score g under the logistic loss l is

    p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])

(du Plessis et al.; Kiryo et al.). With scores linear in the measures and a ridge on the weights this risk is convex: it is
the greater of two convex functions, with the bracket and without. Its least is found by Newton steps; where the bracket
would be negative there, the least lies where it is 0, and the steps solve for the weights and its multiplier together, until
they move by less than TOLERANCE. Each text is a fixed list of measures (shares of kinds of bytes and words, repetition, lengths),
taken of the whole text; the score is logistic in them. Nothing else of a row is read for its score.

- Measures are taken once, and written to the shared folder with two marks: trusted, and open to learning.
- Means and deviations, the gradient and the curvature are sums over every open row; a pass returns as many numbers as
  the model has parameters, whatever the input. Only these sums come to the driver. At most MAX_POSITIVES trusted rows,
  those with the least hash of their id, are used; the unlabelled rows are all used.
- The class prior is estimated first: a plain classifier of positives against unlabelled text is fitted, both scores are
  counted in BINS bins (by partial sums), and the prior is the least ratio of the two upper tails, with a confidence
  margin (best bin estimation, Garg et al.), less two standard errors: a prior that is too high makes junk good, and one that
  is a little too low does no harm. Half of the positives, those that it wasn't fitted on, are counted.

Defined results: null and empty texts have measures of 0 and get a score. Null ids have no label and aren't held out, and
learn nothing. A repeated id has one label; where its labels differ the row is no positive. Without any positive or any open
row every score is the prior PRIOR. Other columns pass through; clashing names are replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cluster import table
from tidelog.llm.text_arrays import range_hashes, slices, words

MAX_POSITIVES = 200_000
BINS = 1000
PRIOR = 0.5
THRESHOLD = 0.3
STEPS, RIDGE, TOLERANCE = 30, 0.05, 1e-2
NAMES = (
    "bytes", "words", "word_length", "upper", "digits", "shout", "marks", "bars", "stops", "other_marks", "wide", "lines",
    "repeats", "repeats_2", "short", "long", "bare", "odd_end", "capitals", "begins_upper",
)
N = len(NAMES)
_CLASS = np.full(256, 6, np.uint8)  # what is in no class below: other marks
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b"!?", b"#$%&*@^~=+<>\\/_{}[]", b"|", b""), 0):
    _CLASS[list(_bytes)] = _k
_CLASS[list(b".,;:")] = 7
_CLASS[128:] = 8
_CLASS[list(b" \t\r")] = 9
_CLASS[10] = 10
_LETTER, _UPPER = np.isin(_CLASS, (0, 1, 8)), _CLASS == 1


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, N): shares by their square root, sizes by their logarithm."""
    n = np.diff(offsets)
    safe = np.maximum(n, 1)
    kinds = _CLASS[data]
    starts, ends, first = words(data, offsets)
    count = np.diff(first)
    some = np.maximum(count, 1)

    def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return np.diff(sums[at])

    share = lambda k: per_text(kinds == k, offsets) / safe
    of_words = lambda flags: per_text(flags, first) / some
    size = ends - starts
    if len(starts):
        hashes, text = range_hashes(data, starts, ends), np.repeat(np.arange(len(count)), count)
        again = lambda k: np.r_[np.zeros(min(k, len(hashes)), bool), (hashes[k:] == hashes[:-k]) & (text[k:] == text[:-k])]
        letters = np.r_[0, np.cumsum(_LETTER[data])]
        uppers = np.r_[0, np.cumsum(_UPPER[data])]
        n_letters, n_upper = letters[ends] - letters[starts], uppers[ends] - uppers[starts]
        end_kind = kinds[ends - 1]
        flags = (again(1), again(2), size <= 3, size >= 13, n_letters == 0, ~np.isin(end_kind, (0, 1, 2, 7, 8)), (n_upper * 2 > n_letters) & (size > 1), _UPPER[data[starts]])
    else:
        flags = (np.zeros(0, bool),) * 8
    out = [np.log1p(n), np.log1p(count), np.log1p(per_text(size, first) / some)]
    out += [np.sqrt(share(k)) for k in (1, 2, 3, 4, 5, 7, 6, 8, 10)]
    out += [np.sqrt(of_words(f)) for f in flags]
    return np.stack(out, 1).astype(np.float32)


def _measure(batches: Iterator[pa.RecordBatch], others: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            rows = pa.array([x.tobytes() for x in measures(data, offsets)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in others), rows], [*others, "x"])


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, N).astype(np.float64)


def _flag(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _long(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(np.asarray(values, np.float64))], ["k", "v"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * N + 3)
    for batch in batches:
        x = _points(batch)
        trusted = _flag(batch, "trusted")
        total += np.r_[len(x), trusted.sum(), (trusted & _flag(batch, "half")).sum(), x.sum(0), (x * x).sum(0)]
    yield _long(total)


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(x)), np.clip((x - mean) / scale, -6, 6)]


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def _sums(batches: Iterator[pa.RecordBatch], mean, scale, w, half_only: bool) -> Iterator[pa.RecordBatch]:
    """Sums of: rows, positives; l(-g) of both; sigma(g) x of both; x of positives; sigma (1 - sigma) x x' of both."""
    d = N + 1
    total = np.zeros(4 + 3 * d + 2 * d * d)
    for batch in batches:
        x = _design(_points(batch), mean, scale)
        trusted = _flag(batch, "trusted")
        if half_only:
            trusted &= _flag(batch, "half")
        g = x @ w
        s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
        p, curve = x[trusted], s * (1 - s)
        total += np.r_[
            len(x), len(p), _softplus(g).sum(), _softplus(g[trusted]).sum(), s @ x, s[trusted] @ p, p.sum(0),
            ((x * curve[:, None]).T @ x).ravel(), ((p * curve[trusted][:, None]).T @ p).ravel(),
        ]
    yield _long(total)


def _bins(batches: Iterator[pa.RecordBatch], mean, scale, w) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * BINS)
    for batch in batches:
        s = 1 / (1 + np.exp(-np.clip(_design(_points(batch), mean, scale) @ w, -500, 500)))
        own = _flag(batch, "trusted") & ~_flag(batch, "half")
        at = np.minimum((s * BINS).astype(int), BINS - 1)
        total += np.r_[np.bincount(at, minlength=BINS), np.bincount(at[own], minlength=BINS)]
    yield _long(total)


def _add_up(rows: DataFrame, job) -> np.ndarray:
    """The sums of a job's numbered values over all partitions; as many as the model asks for."""
    found = rows.mapInArrow(job, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max(r.k for r in found) + 1 if found else 0)
    for r in found:
        out[r.k] = r.v
    return out


def estimated_prior(unlabelled: np.ndarray, positives: np.ndarray, risk: float = 0.1) -> float:
    """The least ratio of upper tails, each with its margin of confidence; two standard errors less."""
    n_u, n_p = unlabelled.sum(), positives.sum()
    if not n_u or not n_p:
        return PRIOR
    tail_u, tail_p = np.cumsum(unlabelled[::-1]) / n_u, np.cumsum(positives[::-1]) / n_p
    margin = np.sqrt(np.log(4 / risk) / (2 * n_u)) + np.sqrt(np.log(4 / risk) / (2 * n_p))
    at = np.flatnonzero(tail_p > margin)
    if not len(at):
        return PRIOR
    best = at[np.argmin((tail_u[at] + margin) / tail_p[at])]
    u, p = tail_u[best], tail_p[best]
    error = np.sqrt(u * (1 - u) / n_u + (u / p) ** 2 * p * (1 - p) / n_p) / p
    return float(np.clip(u / p - 2 * error, 0.01, 0.99))


def step(w: np.ndarray, free: bool, prior: float, ridge: np.ndarray, sums: tuple) -> tuple[np.ndarray, bool]:
    """(the next step of the weights, whether the bracket stays free to be positive).

    sums: E_unl[l(-g)], E_pos[l(-g)], then of unlabelled and positives each the mean of sigma(g) x, the mean of x of positives, and
    of both the mean of sigma (1 - sigma) x x'.
    """
    r_u, r_p, g_u, g_p, x_p, h_u, h_p = sums
    bracket, across = r_u - prior * r_p, g_u - prior * g_p
    without = prior * (g_p - x_p) + ridge @ w  # the gradient of the risk without the bracket
    curve = ridge + 1e-9 * np.eye(len(w))
    whole = np.linalg.solve(h_u + curve, -(without + across))
    if free and bracket + across @ whole >= 0:
        return whole, True
    # on the bracket's border: the curvature is weighed by the multiplier, which the same equations give
    weight = 0.5
    for _ in range(3):
        both = np.block([[weight * h_u + (1 - weight) * prior * h_p + curve, across[:, None]], [across[None, :], np.zeros((1, 1))]])
        solved = np.linalg.solve(both, -np.r_[without, bracket])
        weight = float(np.clip(solved[-1], 0.0, 1.0))
    if solved[-1] > 1:
        return whole, True
    return (solved[:-1], False) if solved[-1] >= 0 else (np.linalg.solve(prior * h_p + curve, -without), False)


def fit(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """(mean, scale, weights, prior) from rows (x, trusted, half) that are open to learning; None without positives."""
    d = N + 1
    m = _add_up(rows, _moments)
    if not len(m) or m[0] == 0 or m[1] == 0:
        return None
    mean = m[3 : 3 + N] / m[0]
    scale = np.sqrt(np.maximum(m[3 + N :] / m[0] - mean**2, 0)) + 1e-3
    halves = 0 < m[2] < m[1]
    ridge = RIDGE * np.diag([0.0] + [1.0] * N)

    def taken(w: np.ndarray, half_only: bool):
        v = _add_up(rows, partial(_sums, mean=mean, scale=scale, w=w, half_only=half_only))
        cut = np.cumsum([4, d, d, d, d * d])
        g_u, g_p, x_p, h_u, h_p = v[cut[0] : cut[1]], v[cut[1] : cut[2]], v[cut[2] : cut[3]], v[cut[3] : cut[4]], v[cut[4] :]
        return v[2] / v[0], v[3] / v[1], g_u / v[0], g_p / v[1], x_p / v[1], h_u.reshape(d, d) / v[0], h_p.reshape(d, d) / v[1]

    def moved_by(move: np.ndarray) -> np.ndarray:
        return move * min(1.0, 3.0 / max(1e-12, float(np.abs(move).max())))

    # positives against unlabelled text, alike in weight: gives the order of texts that the prior is read from
    w = np.zeros(d)
    for _ in range(STEPS):
        _, _, g_u, g_p, x_p, h_u, h_p = taken(w, halves)
        move = np.linalg.solve(0.5 * (h_u + h_p) + ridge + 1e-9 * np.eye(d), -(0.5 * (g_u + g_p - x_p) + ridge @ w))
        w = w + moved_by(move)
        if np.abs(move).max() < TOLERANCE:
            break
    counted = _add_up(rows, partial(_bins, mean=mean, scale=scale, w=w))
    prior = estimated_prior(counted[:BINS], counted[BINS:])
    # the non-negative risk, from the log odds of the prior on
    w, free = np.r_[np.log(prior / (1 - prior)), np.zeros(N)], True
    for _ in range(STEPS):
        move, free = step(w, free, prior, ridge, taken(w, False))
        w = w + moved_by(move)
        if np.abs(move).max() < TOLERANCE:
            break
    else:
        warnings.warn(f"the weights still move by {np.abs(move).max():.3f} after {STEPS} steps", stacklevel=2)
    return mean, scale, w, prior


def _score(batches: Iterator[pa.RecordBatch], model, others: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if model is None:
            s = np.full(batch.num_rows, PRIOR)
        else:
            mean, scale, w, _ = model
            s = 1 / (1 + np.exp(-np.clip(_design(_points(batch), mean, scale) @ w, -500, 500)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(np.round(s, 6))], [*others, "score"])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(measured: DataFrame, labels: DataFrame, key: str, label: str, max_positives: int) -> tuple | None:
    """The model learned from measured (id, held, x) and labels (key, label)."""
    good = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    good = good.groupBy("id").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least = 1 and most = 1")
    known = measured.select("id", "held", "x").where(~F.col("held") & F.col("id").isNotNull())
    # the bound on positives is a bound on the hash of their ids, so that it needs no sort of them
    n_good = good.count()
    order = F.pmod(F.xxhash64("id", F.lit("positives")), F.lit(1 << 30))
    good = good.where(order < int((1 << 30) * min(1.0, max_positives / max(1, n_good)))).select("id")
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0
    return fit(table(known.join(good.withColumn("trusted", F.lit(True)), "id", "left").select("x", F.coalesce("trusted", F.lit(False)).alias("trusted"), half.alias("half"))))


def _measured(docs: DataFrame, key: str, text: str, others: list[str]) -> tuple[DataFrame, list[str], str]:
    base = docs.select(F.col(f"`{key}`").alias("id"), held_out(F.col(f"`{key}`")).alias("held"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.col(f"`{text}`").cast("binary").alias("text"))
    names = [c for c in base.columns if c != "text"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text")
    return table(base.mapInArrow(partial(_measure, others=names), f"{kinds}, x binary")), names, kinds


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_positives: int = MAX_POSITIVES) -> DataFrame:
    """docs without its text, with held_out, score and predicted. labels: (key, label), 1 for trusted positives."""
    others = [c for c in docs.columns if c not in ("held_out", "score", "predicted", text, key)]
    measured, names, kinds = _measured(docs, key, text, others)
    model = train(measured, labels, key, label, max_positives)
    scored = measured.mapInArrow(partial(_score, model=model, others=names), f"{kinds}, score double")
    return scored.select(F.col("id").alias(key), *(F.col(f"c{i}").alias(c) for i, c in enumerate(others)), F.col("held").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keep(batches: Iterator[pa.RecordBatch], model, nr: int) -> Iterator[pa.RecordBatch]:
    mean, scale, w, _ = model
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(nr)):
            x = measures(data, offsets).astype(np.float64)
            s = np.round(1 / (1 + np.exp(-np.clip(_design(x, mean, scale) @ w, -500, 500))), 6)
            yield batch.slice(a, b - a).filter(pa.array(s >= THRESHOLD))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_positives: int = MAX_POSITIVES) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, as they are. Texts are measured again rather than shuffled."""
    measured, _, _ = _measured(docs, key, text, [])
    model = train(measured, labels, key, label, max_positives)
    return docs if model is None else docs.mapInArrow(partial(_keep, model=model, nr=docs.columns.index(text)), docs.schema)
