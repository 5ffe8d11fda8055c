"""URL filters, sharding and license scans: cases that the tables don't have."""

import math
import random
import re

import pytest

from tidelog.llm import license_scan
from tidelog.llm.op1_query import RULES
from tidelog.llm.op9_query import PHRASES, TEMPLATES, THRESHOLD
from tidelog.llm.sharding import MAX_BITS, shard, write_shards
from tidelog.llm.url_filter import Rule, judge


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r.host + r.path), r.action == "block", r.host + r.path))
    return host, path, best.host + best.path, best.action


URLS = [
    None, "", "no scheme", "http://", "http://COM/en/", "http://a.Example.com/en/7x?q#f", "https://example.net/de/8", "http://xnet/de/", "http://b.net/de/9#x", "ftp://a.b.c.org/es/?x", "http://org/es", "http://x://com/en/",
    "http://com?x/en/", "http://例え.com/en/日本", "http://a.com\n/en/", "http://" + "sub." * 500 + "com/en/" + "y" * 5000, "http://..com/en/", "http://com./en/", "http://com/en/7", "http://example.com/en/7", "http://user@Example.com/en/7",
]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_urls(spark, limit):
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string")
    got = judge(pages, RULES, broadcast_limit=limit).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {(i, *brute(u, RULES)) for i, u in enumerate(URLS + URLS)} and len(got) == 2 * len(URLS)
    assert judge(pages.where("false"), RULES, broadcast_limit=limit).count() == 0


def test_many_rules(spark):
    rng = random.Random(1)
    rules = [Rule.parse(rng.choice(["block", "allow"]), ".".join(rng.choices("abc", k=rng.randint(1, 3))) + rng.choice(["", "/", "/x", "/x/y"])) for _ in range(60)]
    rows = [(i, f"http://{'.'.join(rng.choices('abc', k=rng.randint(1, 4)))}{rng.choice(['', '/', '/x', '/x/y/z', '?/x'])}") for i in range(400)]
    got = {r.page_id: (r.rule, r.verdict) for r in judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {i: brute(u, rules)[2:] for i, u in rows}
    assert judge(spark.createDataFrame(rows, "page_id long, url string"), [], default="block").where("verdict = 'block' and rule is null").count() == 400


def test_rows_in_any_order(spark):
    """Inputs that a round-robin repartition deals out, whose rows stand elsewhere when fewer columns are read."""
    urls = [(i, rng_url, f"{i % 7}") for i, rng_url in enumerate(random.Random(5).choices([u for u in URLS if u], k=1500))]
    pages = spark.createDataFrame(urls, "page_id long, url string, other string").repartition(5, "other").repartition(37)
    for limit in (100_000, 0):
        got = judge(pages, RULES, broadcast_limit=limit).select("page_id", "host", "path", "rule", "verdict").collect()
        assert {tuple(r) for r in got} == {(i, *brute(u, RULES)) for i, u, _ in urls} and len(got) == len(urls)
    texts = [(i, t, f"{i % 5}") for i, t in enumerate(random.Random(6).choices([*TEMPLATES.values(), "MIT license", "none", "", "a mit license b"], k=600))]
    docs = spark.createDataFrame(texts, "doc_id long, text string, other string").repartition(5, "other").repartition(37)
    got = license_scan.scan(docs, PHRASES, TEMPLATES, THRESHOLD).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert {r.doc_id: tuple(r)[1:-1] for r in got} == {i: scan_brute(t)[:-1] for i, t, _ in texts} and len(got) == len(texts)


def test_templates_in_chunks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t and t.upper()) for i, t in enumerate([*TEMPLATES.values(), "mit license", None])], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, license_scan.scan(docs, PHRASES, TEMPLATES, THRESHOLD).collect()))
    whole = rows()
    monkeypatch.setattr(license_scan, "CHUNK", 3)
    monkeypatch.setattr(license_scan, "BROADCAST_FOUND", 0)
    assert rows() == whole
    assert [r.labels for r in license_scan.scan(docs, PHRASES, {}).orderBy("doc_id").collect()][-2:] == ["mit", ""]
    assert license_scan.scan(docs, {}, TEMPLATES).where("labels <> ''").count() == len(TEMPLATES)


def test_shards(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(800)] + [(None, None), (None, "a"), (900, "y" * 5000), (901, "same" * 100), *[(901, "same" * 100)] * 20]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, depth int")
    got = shard(docs, 2000).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert len(r.shard) == r.depth and r.n_bytes == len(r.text or "")
    for name, own in by.items():
        assert {(r.shard_bytes, r.shard_rows) for r in own} == {(sum(x.n_bytes for x in own), len(own))}
        assert sum(x.n_bytes for x in own) <= 2000 or len(name) == MAX_BITS and all(x.oversized for x in own)
        assert not any(o != name and o.startswith(name) for o in by)  # a directory: no shard inside another
    # only what is too large is split: a shard and its sibling's subtree don't fit together
    for name in by:
        if name:
            assert sum(x.n_bytes for o, own in by.items() if o.startswith(name[:-1]) for x in own) > 2000
    assert shard(docs.where("false"), 2000).count() == 0
    assert {r.shard for r in shard(docs, 1 << 30).select("shard").distinct().collect()} == {""}
    write_shards(docs.drop("depth"), str(tmp_path / "shards"), 2000)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def scan_brute(text):
    words, hits = words_of(text), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    low, best, found = "".join(c.lower() if c.isascii() else c for c in text or ""), 0.0, set()
    for block in re.split("\n|[.!?;:] ", low):
        own = set(words_of(block))
        for t, body in TEMPLATES.items():
            ws = set(body.split())
            common = len(own & ws)
            if common >= math.ceil(round(THRESHOLD * len(ws), 9)):
                found.add(t)
                best = max(best, common / len(ws))
    at = [i for i, _ in hits]
    base = {label for _, label in hits}
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if hits else best


def test_licenses(spark):
    rng = random.Random(3)
    texts = [
        None, "", "   ", "MIT License", "mit--license mit license", "mit mit license license", "the mit\nlicense", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0", "gnu general public license general public license",
        "permitlicense smit license", "é mit license é", "x" * 100_000 + " mit license " + "word " * 20_000, "Copyright 2020. All rights reserved", "copyright: all rights reserved",
    ]
    for body in TEMPLATES.values():
        words = body.split()
        for _ in range(4):
            own = [w for w in words if rng.random() < 0.85] + rng.choices(["foo", "bar"], k=rng.randint(0, 3))
            rng.shuffle(own)
            texts.append(rng.choice(["\n", ". ", " "]).join([" ".join(own), "other words", " ".join(words)[: rng.randint(0, 60)]]))
    docs = spark.createDataFrame([(i, t, "own", 3) for i, t in enumerate(texts + texts)], "doc_id long, text string, labels string, row int")
    got = license_scan.scan(docs, PHRASES, TEMPLATES, THRESHOLD).collect()
    assert len(got) == 2 * len(texts) and got[0].row == 3
    for r in got:
        mine = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, pytest.approx(r.score))
        assert mine == scan_brute(r.text), (r.doc_id, r.text[:80] if r.text else r.text)
    assert license_scan.scan(docs.where("false"), PHRASES, TEMPLATES, THRESHOLD).count() == 0


def test_wrapped_notices(spark):
    """Every template, hard-wrapped in a comment, between lines of other text."""
    texts, names = [], list(TEMPLATES)
    for name in names:
        for width in (1, 4, 9):
            words = TEMPLATES[name].split()
            texts.append("\n".join(["some first line.", "", *("# " + " ".join(words[k : k + width]) for k in range(0, len(words), width)), "#", "last line"]))
    texts += ["copyright all\n\nrights reserved", "copyright all.\nrights reserved", "copyright all\n" + "x\n" * 200 + "rights reserved", "x\n" * 333 + "copyright all\r\nrights reserved" + "\nx" * 333]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs, {"mit license": "mit"}, TEMPLATES, THRESHOLD, wrapped=True).collect()}
    for k in range(3 * len(names)):
        assert names[k // 3] in got[k].labels.split(",") and got[k].score == 1.0, texts[k]
    assert [got[3 * len(names) + k].labels for k in range(4)] == ["", "", "", "all-rights-reserved"]
