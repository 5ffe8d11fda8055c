"""URL filters: host-suffix / path-prefix expressions, joined to rules on short hash prefixes.

Every URL is expanded into one expression per shape that the rules use: a number of host labels and a length of path.
Expressions meet the rules on a 32-bit prefix of their SHA-256 digest (an equi-join on an int); the full digest then
confirms the match, and of a URL's confirmed rules the longest wins. Everything is DataFrame expressions; no Python runs
on the executors, and rows are never numbered, so it doesn't matter in what order or how often they are read.

The rules are a Python list, so their number is known. Rules of one shape with one hash prefix are one row of a table. Up
to BROADCAST_RULES rules (about 200 bytes each) of at most SHAPES shapes, each shape's table is broadcast and joined to the
rows in place: nothing is shuffled. Beyond that the distinct (host, path) pairs are judged on their own, by one join on
(shape, hash prefix, salt): each rule is repeated SALTS times, each expression takes one salt, so that one that a third of
all URLs share is spread over SALTS tasks. What matched then joins the rows on (host, path), salted in the same way.

Defined results: a null URL, or one without ``://``, has an empty host and path and matches no rule; so it is allowed.
Repeated rows stay repeated. Rules with the same host and path: ``block`` wins over ``allow``. An empty table gives an empty
result. Other columns of the input are passed through; clashing names (host, path, rule, verdict) are replaced by the
results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
SHAPES = 64
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """host: a domain (it and all its subdomains match); path: a prefix that begins with ``/`` or is empty."""

    action: str
    host: str
    path: str

    @classmethod
    def parse(cls, action: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(action, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


def url_host(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _expression(labels: int, length: int) -> Column:
    """The URL's expression of a shape; null where its path is too short."""
    return F.when(F.length("path") >= length, F.concat(F.substring_index("host", ".", -labels), F.lit(" "), F.substring("path", 1, length)))


def _table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(labels, length, short, found): the rules of a shape that share a hash prefix, with their digests."""
    table = spark.createDataFrame([(r.action, r.host, r.path, r.host.count(".") + 1) for r in rules], "action string, rule_host string, rule_path string, labels int")
    won = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("length"), (F.col("action") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("action").alias("verdict"),
    )
    table = table.select("labels", F.length("rule_path").alias("length"), F.sha2(F.concat("rule_host", F.lit(" "), "rule_path"), 256).alias("digest"), won.alias("won"))
    return table.withColumn("short", _short(F.col("digest"))).groupBy("labels", "length", "short").agg(F.collect_list(F.struct("digest", "won")).alias("found"))


def _confirmed(found: Column, digest: Column) -> Column:
    """The best of the found rules whose full digest is the expression's."""
    return F.array_max(F.transform(F.filter(found, lambda r: r["digest"] == digest), lambda r: r["won"]))


def _in_place(rows: DataFrame, table: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """rows with the winning rule, by a broadcast join for each shape."""
    for k, (labels, length) in enumerate(shapes):
        own = table.where((F.col("labels") == labels) & (F.col("length") == length)).select(F.col("short").alias(f"s{k}"), F.col("found").alias(f"f{k}"))
        rows = rows.withColumn(f"e{k}", F.sha2(_expression(labels, length), 256))
        rows = rows.withColumn("short", _short(F.col(f"e{k}"))).join(F.broadcast(own), F.col("short") == F.col(f"s{k}"), "left").drop("short", f"s{k}")
    return rows.withColumn("won", F.array_max(F.array(*(_confirmed(F.col(f"f{k}"), F.col(f"e{k}")) for k in range(len(shapes))))))


def _by_pairs(rows: DataFrame, table: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """rows with the winning rule, by a join of the distinct (host, path) pairs' expressions."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    shaped = F.array(*(F.struct(F.lit(labels).alias("labels"), F.lit(length).alias("length"), _expression(labels, length).alias("text")) for labels, length in shapes))
    expanded = rows.select("host", "path").distinct().select("host", "path", F.explode(F.filter(shaped, lambda x: x["text"].isNotNull())).alias("x"))
    expanded = expanded.select("host", "path", "x.labels", "x.length", F.sha2("x.text", 256).alias("digest"), F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    met = expanded.withColumn("short", _short(F.col("digest"))).join(table.withColumn("salt", spread), ["labels", "length", "short", "salt"])
    best = met.withColumn("won", _confirmed(F.col("found"), F.col("digest"))).where("won is not null").groupBy("host", "path").agg(F.max("won").alias("won"))
    return rows.withColumn("salt", F.floor(F.rand(1) * SALTS).cast("int")).join(best.withColumn("salt", spread), ["host", "path", "salt"], "left")


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", broadcast_limit: int = BROADCAST_RULES) -> DataFrame:
    """pages with host, path, rule (the winning rule's ``host/path``, else null) and verdict."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c == url]
    rows = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    if not rules:
        return rows.select(*names, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    way = _in_place if len(rules) <= broadcast_limit and len(shapes) <= SHAPES else _by_pairs
    return way(rows, _table(pages.sparkSession, rules), shapes).select(*names, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
