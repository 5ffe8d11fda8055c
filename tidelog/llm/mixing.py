"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). A cell's token count starts as its weight; each round rakes the
weights to the target marginal of the source, then of the language, then of the topic. Rounds go on, ROUNDS at a time, until no
marginal is off by more than TOLERANCE of all tokens; where targets can't all be met that never happens, and MOST_ROUNDS end it
with a warning. A number of rounds may also be fixed, for a result that is a fixed expression of the input. The ratio of a cell's raked
weight to its tokens says how much more often its tokens are wanted than they occur; scaled so that `budget` of all
tokens are drawn, it is each document's probability of being drawn. Probabilities end at 1, and what a full cell can't
give is taken from the others, in proportion (`FILLS` rounds). A document is drawn when a hash of its id lies below its
probability: the draw is the same on every run, and needs no shuffle.

Only cells are shuffled: they are counted with partial sums first, so a source that holds a third of all rows is a few rows.
Raking sums the cells of a value by window functions; sums over all cells are aggregates, a number each. Up to BROADCAST_CELLS cells (counted) are broadcast to the documents; more are
joined by shuffle, where AQE splits a hot cell. Everything is DataFrame expressions.

Targets: for each dimension either a dict of value -> share, or a number a: shares in proportion to tokens ** a (1 keeps
them, 0 makes all values equal). Values that a dict doesn't name keep their observed share; all shares are normalised.
A target value that no document has can't be met; the others grow to fill.

Defined results: null dimensions are a value of their own; null and empty texts have 0 tokens, and get the ratio of their
cell (a cell without tokens: 0 probability). A null id hashes as ''. Repeated ids draw alike. An empty table gives an
empty result. Other columns are passed through; clashing names are replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.cluster import cut

ROUNDS, FILLS = 10, 5
TOLERANCE, MOST_ROUNDS = 1e-6, 50
BROADCAST_CELLS = 100_000
DIMENSIONS = ("d0", "d1", "d2")
NEW = ("n_tokens", "topic", "ratio", "probability", "drawn")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _share(dimension: str, target: dict[str, float] | float, total: float) -> Column:
    """The target share of a cell's value, before all values' shares are normalised."""
    of = F.sum("n").over(Window.partitionBy(dimension))
    if not isinstance(target, dict):
        return F.pow(of / total, F.lit(float(target)))
    named = F.element_at(F.create_map(*(F.lit(x) for k, v in target.items() for x in (k, float(v)))), F.col(dimension)) if target else F.lit(None)
    return F.coalesce(named, of / total)


def rake(cells: DataFrame, targets: list[dict[str, float] | float], budget: float, rounds: int | None = None) -> DataFrame:
    """cells (d0, d1, d2, n) with ratio and probability. rounds: so many, whatever the marginals are then."""
    live = cells.where("n > 0")
    numbers = lambda df, *sums: [float(x or 0) for x in df.agg(*sums).first()]
    (total,) = numbers(live, F.sum("n"))
    for d, target in zip(DIMENSIONS, targets, strict=True):
        live = live.withColumn(f"share_{d}", _share(d, target, total))
    # each value counts once: its cells' tokens weigh it
    one = {d: F.col(f"share_{d}") * F.col("n") / F.sum("n").over(Window.partitionBy(d)) for d in DIMENSIONS}
    sums = numbers(live.select(*(c.alias(d) for d, c in one.items())), *(F.sum(d) for d in DIMENSIONS))
    live = live.withColumns({f"share_{d}": F.col(f"share_{d}") / (x or 1.0) for d, x in zip(DIMENSIONS, sums, strict=True)})
    live = live.withColumn("w", F.col("n") / (total or 1.0))
    for _ in range(0, rounds or MOST_ROUNDS, rounds or ROUNDS):
        for _ in range(rounds or ROUNDS):
            for d in DIMENSIONS:
                live = live.withColumn("w", F.col("w") * F.col(f"share_{d}") / F.sum("w").over(Window.partitionBy(d)))
        live = cut(live)
        if rounds:
            break
        # the last dimension is met exactly; the others show how far the rounds have come
        marginals = live.select(*(F.abs(F.sum("w").over(Window.partitionBy(d)) - F.col(f"share_{d}")).alias(d) for d in DIMENSIONS[:-1]))
        if max(numbers(marginals, *(F.max(d) for d in DIMENSIONS[:-1]))) <= TOLERANCE:
            break
    else:
        warnings.warn(f"the targets aren't met after {MOST_ROUNDS} rounds", stacklevel=2)
    (weight,) = numbers(live, F.sum("w"))
    live = live.withColumn("ratio", F.col("w") * total / (weight or 1.0) / F.col("n"))
    live = live.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * budget))
    for _ in range(FILLS):
        full = F.col("probability") >= 1
        taken, open_ = numbers(live, F.sum(F.when(full, F.col("n")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("ratio") * F.col("n"))))
        if open_ > 0:
            live = live.withColumn("probability", F.when(full, F.col("probability")).otherwise(F.least(F.lit(1.0), F.col("ratio") * ((budget * total - taken) / open_))))
    return live.select(*DIMENSIONS, "ratio", "probability")


def mix(docs: DataFrame, source: Column, language: Column, topic: Column, targets: list[dict[str, float] | float], budget: float, key: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """docs with n_tokens, topic, ratio, probability and drawn. rounds: a fixed number, else until the marginals are met."""
    keep = [c for c in docs.columns if c not in NEW]
    value = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), value(source).alias("d0"), value(language).alias("d1"), value(topic).alias("d2"),
        tokens(F.col(f"`{text}`")).alias("n_tokens"), uniform(F.col(f"`{key}`")).alias("u"),
    )
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n"))
    cells = cut(cells)
    raked = cut(rake(cells, targets, budget, rounds))
    few = cells.count() <= BROADCAST_CELLS
    joined = rows.join(F.broadcast(raked) if few else raked, list(DIMENSIONS), "left")
    chance = F.coalesce("probability", F.lit(0.0))
    return joined.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "n_tokens", F.col("d2").alias("topic"),
        F.round(F.coalesce("ratio", F.lit(0.0)), 6).alias("ratio"), F.round(chance, 6).alias("probability"), (F.col("u") < chance).alias("drawn"),
    )
