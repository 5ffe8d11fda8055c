"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Phrases: a text's words, joined by doubled spaces, hold every place where a phrase's words stand in a row. Only texts that
hold all words of a phrase somewhere are written out that way.

Templates: a block is a line or a sentence of a text (it ends at a line feed, or at one of .!?;: and a space); a template
T is found in a block B where |B and T| >= threshold * |T|, on sets of words. The join is exact: T's words are ordered by
how many blocks hold them, of all blocks of the corpus that pass the length filter, rarest first. A block that meets the
threshold with T

- has at least need = ceil(threshold * |T|) words that some template has (length filter);
- holds one of any |T| - need + 1 words of T: texts and sentences without the longest ones of any template are passed over
  before they are cut into words;
- holds one of T's |T| - need + 1 rarest words (prefix: only these are joined, an equi-join on the word's rank);
- and if the first common word stands at place p of T and q of B, in that order, then need <= min(|T| - p, |B| - q), both
  counted from 0 (positional filter).

With wrapped=True a sentence may also run over line feeds (it ends at one of .!?;: and a space or a line feed, or at a line
without words). Where it does, its stretches of 2 * SPAN words, one from every SPAN-th word on, are blocks as well, SPAN being
twice the words of the longest template: a notice with up to as many words put in between is inside one of them, however its
lines are cut. Without it, lines are judged one by one.

Words that no template has take no part, so most blocks are left before anything is joined; the rest are written once. The
words' counts, and nothing else, come to the driver; templates are taken CHUNK at a time, so that the words in a plan and
the prefixes that are broadcast stay few, however many templates there are. What is found is told by two hashes of the text,
not by a number of its row: the text itself is never shuffled, and equal texts are found once. Up to BROADCAST_FOUND texts
with a template (counted) are broadcast to the rows; more are joined by shuffle. All expressions are DataFrame functions.

Score: 1 where a phrase was found; else the best containment of a template that any block met, else 0.

Defined results: null or empty texts have no words, no labels and score 0. Repeated rows and ids are judged row by row.
An empty table gives an empty result. Other columns are passed through; clashing names are replaced by the results. No
templates, or no phrases: their labels are missing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cluster import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD_YET = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same before A-Z are folded
BLOCK_END = "\n|[.!?;:] "
SENTENCE_END = r"[.!?;:](?: |\r?\n)|\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n"
CHUNK = 200
BROADCAST_FOUND = 200_000
NEW = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def folded(text: Column) -> Column:
    """The words, each with a space before and after, so that a phrase's places can't overlap."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.regexp_replace(F.trim(F.regexp_replace(plain, NO_WORD, " ")), " ", "  "), F.lit(" "))


def count_words(text: Column) -> Column:
    """Words of a folded text: each has a space before and after."""
    return F.when(text == "  ", F.lit(0)).otherwise((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("long")


def _phrase(phrase: str) -> str:
    return " " + "  ".join(phrase.split()) + " "


def _n_words(text: Column) -> Column:
    """Words of a text as it is: the parts between what is no word, but for an empty one at either end."""
    parts = F.split(text, NO_WORD_YET)
    ends = (F.get(parts, F.lit(0)) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.size(parts) - ends, F.lit(0)).cast("long")


def _may_hold(text: Column, phrase: str) -> Column:
    """False only for texts without the phrase: lower() folds A-Z, whatever else it does to other characters."""
    low, parts = F.lower(text), [w for w in phrase.split() if w.isascii()]
    return reduce(lambda x, y: x & y, (F.contains(low, F.lit(w)) for w in parts), F.lit(True))


def _marks(sets: dict[str, list[str]], need: dict[str, int]) -> list[str]:
    """Words of which every block that meets a template holds one: each template's |T| - need + 1 longest, or nothing where one isn't ASCII."""
    marks = {w for t, ws in sets.items() for w in sorted(ws, key=lambda w: (-len(w), w))[: len(ws) - need[t] + 1]}
    return sorted(marks) if all(w.isascii() for w in marks) else []


def _blocks(rows: DataFrame, known: list[str], marks: list[str], least: int, span: int, wrapped: bool) -> DataFrame:
    """(k1, k2, block): the known words of each block that has at least `least` of them; rows: (k1, k2, own_text)."""
    own = lambda words: F.array_intersect(words, F.array(*map(F.lit, known)))
    # lower() is fast and finds no fewer words than folding A-Z does; what passes is folded exactly
    marked = lambda text: reduce(lambda x, y: x | y, (F.contains(F.lower(text), F.lit(w)) for w in marks)) if marks else F.lit(True)
    lines = rows.where(marked("own_text")).select("k1", "k2", F.explode(F.split("own_text", SENTENCE_END if wrapped else BLOCK_END)).alias("line"))
    lines = lines.where(marked("line"))
    if all(w.isascii() for w in known):
        lines = lines.where(F.size(own(F.split(F.lower("line"), NO_WORD))) >= least)
    lines = lines.select("k1", "k2", F.translate("line", UPPER, LOWER).alias("line"))
    words = F.split("line", NO_WORD)
    if wrapped:
        stretches = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - span - 1, F.lit(0)), F.lit(span)), lambda at: F.slice(words, at + 1, 2 * span))
        single = F.transform(F.split("line", BLOCK_END), lambda line: F.split(line, NO_WORD))
        lines = lines.select("k1", "k2", F.explode(F.when(F.contains(F.col("line"), F.lit("\n")), F.concat(single, stretches)).otherwise(single)).alias("words"))
        words = F.col("words")
    return lines.select("k1", "k2", own(words).alias("block")).where(F.size("block") >= least)


def _found(rows: DataFrame, templates: dict[str, str], threshold: float, wrapped: bool) -> DataFrame:
    """(k1, k2, template, containment) of the templates that a block of the text meets."""
    sets = {label: sorted(set(body.split())) for label, body in templates.items()}
    need = {label: math.ceil(round(threshold * len(words), 9)) for label, words in sets.items()}
    known = sorted({w for words in sets.values() for w in words})
    blocks = table(_blocks(rows, known, _marks(sets, need), min(need.values()), 2 * max(len(body.split()) for body in templates.values()), wrapped).distinct())
    counts = {r.word: r.n for r in blocks.select(F.explode("block").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(known, key=lambda w: (counts.get(w, 0), w)))}
    index, ordered = [], {t: sorted(rank[w] for w in ws) for t, ws in sets.items()}
    for t, ranks in ordered.items():
        index += [(r, t, len(ranks), need[t], p, ranks) for p, r in enumerate(ranks[: len(ranks) - need[t] + 1])]
    index = rows.sparkSession.createDataFrame(index, "rank int, template string, size int, need int, p int, all array<int>")
    ranks = F.create_map(*(F.lit(x) for w, i in rank.items() for x in (w, i)))
    ranked = blocks.select("k1", "k2", F.array_sort(F.transform("block", lambda w: F.element_at(ranks, w))).alias("block"))
    met = ranked.select("k1", "k2", "block", F.posexplode("block").alias("q", "rank")).join(F.broadcast(index), "rank")
    met = met.where(F.col("need") <= F.least(F.col("size") - F.col("p"), F.size("block") - F.col("q")))
    met = met.withColumn("common", F.size(F.array_intersect("block", "all"))).where("common >= need")
    return met.select("k1", "k2", "template", (F.col("common") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, str], templates: dict[str, str], threshold: float = 0.8, text: str = "text", wrapped: bool = False) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score. wrapped: also match over line feeds."""
    keep = [c for c in docs.columns if c not in NEW]
    own_text = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    told = [F.xxhash64(own_text).alias("k1"), F.xxhash64(F.lit(1), own_text).alias("k2")]
    texts, labels = docs.select(*told, own_text.alias("own_text")), sorted(t for t, body in templates.items() if body.split())
    parts = [_found(texts, {t: templates[t] for t in labels[k : k + CHUNK]}, threshold, wrapped) for k in range(0, len(labels), CHUNK)]

    # phrases, in place; the words before a place are counted in the text before it
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), *told, own_text.alias("own_text"), _n_words(own_text).alias("n_words"))
    some = reduce(lambda x, y: x | y, (_may_hold(F.col("own_text"), p) for p in phrases), F.lit(False))
    rows = rows.withColumn("folded", F.when(some, folded(F.col("own_text"))).otherwise(F.lit("  "))).drop("own_text")
    hits, firsts, lasts, marks = [F.lit(0).cast("long")], [F.lit(None).cast("long")], [F.lit(None).cast("long")], [F.lit(None).cast("string")]
    for phrase, label in phrases.items():
        mark, size = _phrase(phrase), len(phrase.split())
        inside = F.contains(F.col("folded"), F.lit(mark))
        hits.append(F.when(inside, (F.length("folded") - F.length(F.replace(F.col("folded"), F.lit(mark), F.lit("")))) / len(mark)).otherwise(0).cast("long"))
        firsts.append(F.when(inside, count_words(F.substring_index("folded", mark, 1))))
        lasts.append(F.when(inside, F.col("n_words") - count_words(F.substring_index("folded", mark, -1)) - size))
        marks.append(F.when(inside, F.lit(label)))
    base = F.array_distinct(F.filter(F.array(*marks), lambda x: x.isNotNull()))
    rows = rows.select(
        *(f"c{i}" for i in range(len(keep))), "k1", "k2", "n_words", reduce(lambda x, y: x + y, hits).alias("n_base"),
        F.array_min(F.array(*firsts)).alias("first_word"), F.array_max(F.array(*lasts)).alias("last_word"), base.alias("base"),
    )
    if parts:
        several = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(F.collect_set("template").alias("templates"), F.max("containment").alias("containment"))
        several = table(several)
        rows = rows.join(F.broadcast(several) if several.count() <= BROADCAST_FOUND else several, ["k1", "k2"], "left")
    else:
        rows = rows.withColumns({"templates": F.lit(None).cast("array<string>"), "containment": F.lit(None).cast("double")})
    return rows.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("templates", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
