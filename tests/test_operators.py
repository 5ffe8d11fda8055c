"""Operators on small frames: edge cases that the tables don't have."""

import datetime
import struct

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import documents, measures, names, strings, types
from tidelog.operators import asof, catalog, changes, feed, gtid, ordered, relay, stats
from tidelog.sources import settings as toml

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def intervals(spark, rows):
    return spark.createDataFrame(rows, "source string, start long, end long")


def ids(df):
    return {(r.source, n) for r in (df if isinstance(df, list) else df.collect()) for n in range(r.start, r.end + 1)}


def is_canonical(rows):
    rows = sorted((r.source, r.start, r.end) for r in rows)
    return all(a[0] != b[0] or a[2] + 1 < b[1] for a, b in zip(rows, rows[1:], strict=False))


spans = st.lists(st.tuples(st.sampled_from(["u", "v"]), st.integers(0, 40), st.integers(0, 6)), max_size=12)


@given(a=spans, b=spans)
@few
def test_sets_behave_as_sets(spark, a, b):
    x, y = (intervals(spark, [(s, n, n + k) for s, n, k in rows]) for rows in (a, b))
    sx, sy = ids(x), ids(y)
    for made, expected in ((gtid.merge(x, span=8), sx), (gtid.union(x, y, 4), sx | sy), (gtid.intersect(x, y, 8), sx & sy), (gtid.difference(x, y, 16), sx - sy), (gtid.difference(x, y), sx - sy)):
        found = made.collect()
        assert ids(found) == expected and is_canonical(found)
    rows = spark.createDataFrame([(s, n) for s in "uv" for n in range(50)], "s string, n long")
    assert {tuple(r) for r in gtid.contains(rows, x, "s", "n", span=8).collect()} == sx
    assert {(r.source, r.start, r.end) for r in gtid.parse(gtid.set_text(x)).collect()} == {(r.source, r.start, r.end) for r in gtid.merge(x).collect()}


def test_known_sets(spark):
    added = gtid.union(intervals(spark, [("u", 3, 5)]), intervals(spark, [("u", n, n) for n in (2, 4, 5, 7, 0)] + [("v", 9, 9)]))
    assert sorted(r.gtid_set for r in gtid.set_text(added).collect()) == ["u:0:2-5:7", "v:9"]
    assert [tuple(r) for r in gtid.merge(intervals(spark, [("u", 1, 191), ("u", 192, 199), ("u", 5, 1), ("u", None, 3)])).collect()] == [("u", 1, 199)]
    text = one(spark, gtid.uuid_text(gtid.uuid_bytes(F.lit("80549ecc-d2f2-11ea-b790-0242ac130002"))))
    assert text == "80549ecc-d2f2-11ea-b790-0242ac130002"


@given(rows=st.lists(st.tuples(st.sampled_from(["a", None]), st.integers(0, 200), st.one_of(st.none(), st.integers(-5, 5))), max_size=40, unique_by=lambda r: (r[0], r[1])), span=st.sampled_from([1, 7, 64]))
@few
def test_ordered_operators(spark, rows, span):
    df = spark.createDataFrame(rows, "k string, at long, v long")
    by_key = {k: sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in ("a", None)}
    previous, seen, total, number = {}, {}, {}, {}
    for k, own in by_key.items():
        last = s = None
        for i, r in enumerate(own):
            previous[r[:2]] = own[i - 1][2] if i else "none"
            last = r[2] if r[2] is not None else last
            s = (s or 0) + r[2] if r[2] is not None else s
            seen[r[:2]], total[r[:2]], number[r[:2]] = last, s, i + 1
    got = ordered.with_previous(df, ["k"], "at", ["v"], span=span).collect()
    assert {(r.k, r.at): "none" if r.previous is None else r.previous.v for r in got} == previous
    assert {(r.k, r.at): r.s for r in ordered.with_last_seen(df, ["k"], "at", F.col("v"), "s", span).collect()} == seen
    assert {(r.k, r.at): r.t for r in ordered.with_running(df, ["k"], "at", {"t": F.col("v")}, span).collect()} == total
    assert {(r.k, r.at): r.n for r in ordered.with_number(df, ["k"], "at", "n", span).collect()} == number


def test_differences(spark):
    rows = spark.createDataFrame([(1, ["1", "a", None, "x"], ["1", "b", "c", None]), (2, ["1"], ["1", "2"]), (3, [], []), (4, ["1"], None)], "event_id long, before array<string>, after array<string>")
    out = {r.event_id: r for r in changes.updates(rows).collect()}
    assert [(c.column_index, c.before, c.after) for c in out[1].diff] == [(1, "a", "b"), (2, None, "c"), (3, "x", None)]
    assert (out[1].changed, out[1].percent) == (3, 75.0) and (out[2].changed, out[2].total) == (1, 2) and out[3].percent == 0.0 and 4 not in out
    assert {r.kind for r in changes.fields(changes.updates(rows).where("event_id = 1")).collect()} == {"value_to_value", "null_to_value", "value_to_null"}
    five = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["x", "y", "c", "d", "e"])], "before array<string>, after array<string>")
    row = changes.updates(five).select("percent", changes.savings(F.col("changed"), F.col("total")).alias("saved"), changes.apply_diff(F.col("before"), F.col("diff")).alias("patched")).first()
    assert (row.percent, row.saved, row.patched) == (40.0, 60.0, ["x", "y", "c", "d", "e"])


def test_table_maps_end_with_their_statement(spark):
    log = spark.createDataFrame([(1, "map", "a"), (2, "row", None), (3, "end", None), (4, "row", None), (5, "map", "b"), (6, "map", "c"), (7, "end", None), (8, "end", None)], "pos long, kind string, value string")
    out = asof.with_table_map(log, [], "pos", F.col("kind") == "map", F.col("kind") == "end", F.col("value"), span=2)
    assert {r.pos: r.table_map for r in out.collect()} == {1: "a", 2: "a", 3: "a", 4: None, 5: "b", 6: "c", 7: "c", 8: None}


def test_segments(spark, tmp_path):
    feed_rows = spark.createDataFrame([(i, i % 7, "INSERT", None, [str(i)]) for i in range(203)], "event_id long, key long, op string, before array<string>, after array<string>")
    entries = relay.segments_by_entries(relay.numbered(relay.records(feed_rows, "d", "t"), ["database_name", "table_name"], "event_log_pos", span=64))
    table = relay.segment_table(entries, ["table_name"]).orderBy("segment_id").collect()
    assert [(r.first_index, r.entries, r.full) for r in table] == [(1, 100, True), (101, 100, True), (201, 3, False)]
    relay.write(entries, str(tmp_path / "relay"))
    assert len(list((tmp_path / "relay").rglob("*.parquet"))) == 1  # not one a segment
    back = relay.read(spark, str(tmp_path / "relay"))
    assert back.count() == 203 and back.where("not crc_ok").count() == 0 and back.where("index = 150").first().segment_id == 2
    assert relay.verify(entries.withColumn("payload", F.lit("other"))).where("crc_ok").count() == 0
    assert relay.apply(feed_rows.unionByName(spark.createDataFrame([(300, 1, "DELETE", ["1"], None)], feed_rows.schema)), ["key"], "event_id").count() == 6


@pytest.mark.parametrize(("name", "expected"), [("a.b", ("default", "a", "b")), ("`a`.`b`.c", ("a", "b", "c")), ("c", None), ("a.b.c.d", None), ("`a.b", None), (None, None), ("", None)])
def test_qualified_names(spark, name, expected):
    found = one(spark, names.qualified_name(F.lit(name)))
    assert (None if found is None else tuple(found)) == expected


def test_other_names(spark):
    assert tuple(one(spark, names.physical_name(F.lit("test##t1##145")))) == ("test", "t1", 145) and one(spark, names.physical_name(F.lit("t1"))) is None
    assert tuple(one(spark, names.segment_name(F.lit("db#t/rlog-1-2-101.log")))) == (1, 2, 101)
    assert tuple(one(spark, names.host_port(F.lit("10.0.0.1:3306")))) == ("10.0.0.1", 3306) and one(spark, names.host_port(F.lit("10.0.0.1"))) is None


def test_strings(spark):
    assert one(spark, strings.similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, strings.similarity(F.lit(""), F.lit(""))) == 1.0 and one(spark, strings.similarity(F.lit(""), F.lit("a"))) == 0.0
    assert one(spark, strings.repeat_ratio(F.lit("aaab"))) == 0.5 and one(spark, strings.repeat_ratio(F.lit(""))) == 0.0
    assert one(spark, strings.run_length_encode(F.lit(b"aaab" + b"c" * 300))) == b"\x03a\x01b\xffc\x2dc"
    assert one(spark, strings.run_length_decode(F.lit(b"\x03a\x01b"))) == b"aaab" and one(spark, strings.run_length_decode(F.lit(b"\x03"))) is None
    assert one(spark, strings.detect_charset(F.lit(b"ab"))) is None and one(spark, strings.detect_charset(F.lit(b"abc"))) == 11
    assert one(spark, strings.detect_charset(F.lit("é é".encode()))) == 33 and one(spark, strings.detect_charset(F.lit(b"\xff\xfe\xfd"))) is None
    assert one(spark, strings.detect_charset(F.lit(b"\xef\xbb\xbfabc"))) == 33
    assert [one(spark, strings.decode_charset(F.lit(data), F.lit(code))) for data, code in ((b"\xc4\xe3", 28), (b"\xa7A", 1), (b"\xff\x00", 63), (b"a", 999))] == ["你", "你", "ff00", None]
    assert one(spark, strings.pretty_bytes(F.lit(1500))) == "1.50 KB" and one(spark, strings.pretty_bytes(F.lit(12))) == "12 B"
    assert one(spark, strings.pretty_duration(F.lit(90061))) == "1d 1h 1m 1s" and one(spark, strings.pretty_duration(F.lit(0))) == "0s"


def test_types_and_measures(spark):
    assert one(spark, types.target_name(F.lit("LONG"))) == "int" and one(spark, types.target_code(F.lit("BigInt"))) == 5 and one(spark, types.target_code(F.lit("what"))) is None
    assert one(spark, types.sql_source(F.lit("INT(11) UNSIGNED"))) == "LONG" and one(spark, types.sql_source(F.lit("character varying(3)"))) == "VARCHAR"
    assert one(spark, measures.bucket(F.lit(100), measures.SIZE_BUCKETS)) == "0-100B" and one(spark, measures.bucket(F.lit(101), measures.SIZE_BUCKETS)) == "101B-1KB"
    assert one(spark, measures.percent_bucket(F.lit(10.9))) == "0-10%" and one(spark, measures.percent_bucket(F.lit(11.0))) == "11-25%"
    assert one(spark, measures.share(F.lit(0), F.lit(0), 100.0)) == 100.0
    assert one(spark, measures.error_category(F.lit("cannot decode"))) == "Parse Error" and one(spark, measures.error_category(F.lit(None).cast("string"))) == "Unknown Error"
    assert one(spark, measures.is_recoverable(F.lit("ChecksumMismatch"))) and not one(spark, measures.is_recoverable(F.lit("Bug")))
    assert tuple(one(spark, catalog.precision_scale(F.lit("decimal(10,2)")))) == (10, 2) and one(spark, catalog.precision_scale(F.lit("int"))) is None


def test_json(spark):
    doc = F.lit('{"a": {"b": [1, {"c": "7"}]}, "n": null, "f": 1.5}')
    assert one(spark, documents.json_path(doc, "a.b[1].c")) == "7" and one(spark, documents.json_long(doc, "a.b[1].c")) == 7 and one(spark, documents.json_double(doc, "f")) == 1.5
    assert one(spark, documents.json_has(doc, "n")) and not one(spark, documents.json_has(doc, "z")) and one(spark, documents.json_has(doc, "a.b[0]"))
    assert one(spark, documents.json_keys(doc)) == ["a", "n", "f"] and one(spark, documents.json_length(doc, "a.b")) == 2 and one(spark, documents.json_keys(F.lit("no json"))) == []


def test_geometry(spark):
    ring = [(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)]
    polygon = b"\1" + struct.pack("<III", 3, 1, 5) + b"".join(struct.pack("<2d", *p) for p in ring)
    point = b"\0" + struct.pack(">I2d", 1, 1, 2)
    several = b"\1" + struct.pack("<II", 4, 2) + b"\1" + struct.pack("<I2d", 1, 1, 2) + b"\1" + struct.pack("<I2d", 1, 3, 4)
    rows = spark.createDataFrame([(1, polygon), (2, point), (3, several), (4, b"nothing"), (5, None)], "id long, data binary").withColumn("g", documents.decode_wkb("data"))
    got = {r.id: r.g for r in rows.collect()}
    assert got[1].wkt == "POLYGON((0 0, 4 0, 4 3, 0 3, 0 0))" and got[2].wkt == "POINT(1 2)" and got[3].wkt == "MULTIPOINT((1 2), (3 4))"
    assert got[4].kind is None and got[5].kind is None
    box = rows.where("id = 1").select(documents.bounding_box(F.col("g.xs"), F.col("g.ys")).alias("b")).first().b
    assert (box.min_x, box.max_x, box.width, box.area) == (0, 4, 4, 12)
    inside = rows.where("id = 1").select(documents.point_in_ring(F.col("g.rings")[0], F.lit(1.0), F.lit(1.0)).alias("a"), documents.point_in_ring(F.col("g.rings")[0], F.lit(5.0), F.lit(1.0)).alias("b")).first()
    assert inside.a and not inside.b


def test_definitions():
    kind, table, columns = catalog.parse_definition("create table if not exists `d`.`t` (`id` int(11) unsigned not null auto_increment, v varchar(10) default 'a,b', e enum('x','y'), p double precision, primary key (`id`), key k (v))")
    assert (kind, table) == ("CREATE", "d.t") and [(c["name"], c["source_type"]) for c in columns] == [("id", "LONG"), ("v", "VARCHAR"), ("e", "ENUM"), ("p", "DOUBLE")]
    assert columns[0]["primary_key"] and columns[0]["unsigned"] and not columns[0]["nullable"] and columns[1]["nullable"]
    kind, table, columns = catalog.parse_definition("ALTER TABLE t ADD COLUMN (a INT, b TEXT), DROP COLUMN c, MODIFY d BIGINT NOT NULL AFTER a, CHANGE e f DATE")
    assert (kind, table) == ("ALTER", "t") and [(c["action"], c["name"]) for c in columns] == [("add", "a"), ("add", "b"), ("drop", "c"), ("modify", "d"), ("modify", "f")]
    assert catalog.parse_definition("SELECT 1") == (None, None, None) and catalog.parse_definition(None) == (None, None, None)


def test_rates_need_a_second(spark):
    t = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([("a", t), ("a", t + datetime.timedelta(milliseconds=500)), ("b", t), ("b", t + datetime.timedelta(seconds=4))], "k string, ts timestamp_ntz")
    got = {r.k: r.events_per_second for r in stats.events(log, ["k"], F.lit(10), F.lit(1.0), F.lit(False)).collect()}
    assert got == {"a": 0.0, "b": 0.5}
    empty = stats.events(log.where("false"), ["k"], F.lit(10), F.lit(1.0), F.lit(False))
    assert empty.count() == 0 and stats.nulls(log.where("false"), ["k"]).first().percent == 0.0


def test_settings(spark):
    read = toml.read_settings('[mysql]\nhost = "db"\nuse_ssl = true\ntables = ["a", "b"]\n')
    assert read["mysql.host"] == "db" and read["mysql.use_ssl"] == "true" and read["mysql.tables"] == "a,b" and read["server_id"] == "65535"
    rows = toml.read_catalog(spark, '[[tables]]\nschema = "test"\nname = "t0"\n[[tables.columns]]\nname = "p"\ntype = "float"\n[[tables.columns]]\nname = "id"\ntype = "bigint"\nprimary_key = true\nnullable = false\n').collect()
    assert [(r.column_name, r.type, r.nullable, r.primary_key) for r in rows] == [("p", "float", True, False), ("id", "bigint", False, True)]
    typed = toml.typed_rows(spark.createDataFrame([("1", "x"), ("z", "y")], "a string, b string"), {"a": "int"}).collect()
    assert [r.a for r in typed] == [1, None]


def test_snapshots_and_routes(spark):
    rows = spark.createDataFrame([(1, None)], "id long, name string")
    made = feed.from_snapshot(rows, ["id"], "t").first()
    assert made.after == ["1", None] and made.op == "INSERT" and made.row_key == "1"
    rules = spark.createDataFrame([("x", ["d"], ["t", "t"], "y")], "task string, databases array<string>, tables array<string>, target string")
    assert catalog.route(feed.from_snapshot(rows, ["id"], "t").withColumn("database_name", F.lit("d")), rules).count() == 1
    assert [tuple(r) for r in catalog.tables_of(spark.createDataFrame([("DEF", "d", "t", "a, b", "")], "catalog string, database_name string, table_name string, primary_keys string, unique_keys string")).collect()] == [("default", "d", "t", ["a", "b"], [])]


def test_samples_are_alike(spark):
    rows = spark.range(10_000)
    first, again = (sorted(r.id for r in stats.sample(df, "id", 0.1).collect()) for df in (rows, rows.repartition(5)))
    assert first == again and 800 < len(first) < 1200 and stats.sample(rows, "id", 0.0).count() == 0 and stats.sample(rows, "id", 1.0).count() == 10_000


def test_a_set_of_many_intervals(spark):
    n = (1 << 20) + 5
    sets = spark.range(1).select(F.concat(F.lit("u:"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (2 * k).cast("string")), ":")).alias("gtid_set"))
    assert gtid.parse(sets).agg(F.count("*"), F.max("end")).first() == (n, 2 * n)


def test_run_lengths_are_made_in_slices():
    """The arrays of a batch are many times its bytes, so not all of a batch is held as arrays."""
    import tracemalloc

    values = [bytes(range(k % 200, 256)) * 400 if k % 5 else None for k in range(400)] + [b"", b"a" * 600_000, b"z"]
    data = pd.Series(values, dtype=object)
    size = sum(len(v or b"") for v in values)
    tracemalloc.start()
    packed = strings._encode_runs(data)
    restored = strings._decode_runs(packed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert restored.tolist() == values and peak < 12 * size
    assert strings._encode_runs(pd.Series([], dtype=object)).tolist() == []


def test_equal_intervals_are_merged_without_being_found_first(spark, monkeypatch):
    """Finding equal intervals would hold all of them in a task's memory."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(gtid, "cut", kept)
    rows = intervals(spark, [("u", 1, 3), ("u", 1, 3), ("u", 3, 9), ("u", 11, 12), ("v", 5, 5), ("v", 5, 5)])
    assert sorted(tuple(r) for r in gtid.merge(rows, span=4).collect()) == [("u", 1, 9), ("u", 11, 12), ("v", 5, 5)]
    assert plans[0].count("Aggregate [") == 1
