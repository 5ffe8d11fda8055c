"""Binary forms against Python's struct, and target values."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidelog.functions import encodings as e
from tidelog.functions import values
from tidelog.operators import catalog, printing

NUMBERS = [0, 1, 250, 251, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 1 << 32, (1 << 63) - 1, -1, -251, -(1 << 31), None]


def varint(n):
    for size, mark in ((2, 251), (4, 252), (8, 253)):
        if n < 251:
            return bytes([n])
        if n < 1 << (8 * size):
            return bytes([mark]) + n.to_bytes(size, "little")


def test_fixed_integers(spark):
    df = spark.createDataFrame([(n,) for n in NUMBERS], "n long")
    for order, sign in (("little", "<"), ("big", ">")):
        for r in df.select("n", e.int_bytes(F.col("n"), 8, order).alias("b"), e.read_int(e.int_bytes(F.col("n"), 8, order), 1, 8, order).alias("back"), e.read_int(e.int_bytes(F.col("n"), 2, order), 1, 2, order, True).alias("low")).collect():
            assert (r.n is None and r.b is None) or (bytes(r.b) == struct.pack(f"{sign}q", r.n) and r.back == r.n)
            assert r.n is None or r.low == struct.unpack("<h", struct.pack("<q", r.n)[:2])[0]


def test_variable_fields(spark):
    rows = [(abs(n) if n else n, n, t, None if n == 1 else bytearray(t.encode())) for n in NUMBERS[:-1] for t in ("", "é" * 300)]
    df = spark.createDataFrame(rows, "u long, i long, s string, b binary")
    fields = [("u", "u64"), ("i", "i64"), ("s", "string?"), ("b", "bytes?")]
    for fixed in (True, False):
        for order in ("little", "big"):
            packed = df.withColumn("data", e.encode_fields([(F.col(c), k) for c, k in fields], fixed, order))
            if not fixed and order == "little":
                for r in packed.collect():
                    zigzag = r.i * 2 if r.i >= 0 else -r.i * 2 - 1
                    assert bytes(r.data).startswith(varint(r.u) + varint(zigzag) + b"\1" + varint(len(r.s.encode())))
            if fixed or order == "little":
                back = e.decode_fields(packed.select(F.col("data"), F.col("i").alias("k")), "data", fields, fixed, order)
                want = sorted(rows, key=str)
                assert sorted(((r.u, r.i, r.s, None if r.b is None else bytearray(r.b)) for r in back.collect()), key=str) == want


def test_values_of_target_rows(spark):
    df = spark.createDataFrame([(2.5, 7, "é"), (None, None, None)], "d double, i int, s string")
    full, none = df.select(*(e.target_bytes(F.col(c), k).alias(k) for c, k in (("d", "double"), ("d", "float"), ("i", "short"), ("s", "string"), ("s", "json")))).collect()
    head = lambda code: b"\0" + struct.pack("<i", code) + b"\0\0"
    assert bytes(full.double) == head(7) + struct.pack("<d", 2.5) and bytes(full.float) == head(8) + struct.pack("<f", 2.5) and bytes(full.short) == head(3) + b"\7\0"
    assert bytes(full.string) == head(13) + b"\2\0\0\0" + "é".encode() and bytes(full.json)[:5] == b"\0" + struct.pack("<i", 30)
    assert all(bytes(x) == b"\1" for x in none)


def test_entries_and_strings(spark):
    df = spark.createDataFrame([(5, "text"), (6, "")], "i long, p string").withColumn("f", e.entry_frame(F.col("i"), F.col("p")))
    for r in df.withColumn("e", e.read_frame(F.col("f"))).withColumn("broken", e.read_frame(F.concat(F.expr("substring(f, 1, 16)"), F.lit(bytearray(4)), F.lit(b"text").cast("binary")))).collect():
        raw = r.p.encode()
        assert bytes(r.f) == struct.pack("<qqI", r.i, len(raw), zlib.crc32(raw)) + raw and r.e.crc_ok and bytes(r.e.payload) == raw
        assert r.broken.crc_ok is False
    row = spark.range(1).select(
        e.null_terminated(F.lit(bytearray(b"a\x10\0b"))).alias("a"), e.null_terminated(F.lit(bytearray(b"\0"))).alias("b"), e.null_terminated(F.lit(bytearray(b"ab"))).alias("c"), e.read_length(F.lit(bytearray([251])))["value"].alias("d"),
        e.fixed_text(F.lit(bytearray(b"abc")), 2, 3).alias("e"), e.point2d(F.lit(bytearray(struct.pack("<2d", 1.5, -2)))).alias("f"), e.point2d(F.lit(bytearray(15))).alias("g"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, tuple(row.f), row.g) == ("a\x10", "", None, None, None, (1.5, -2.0), None)


@pytest.mark.parametrize("text,kind,want", [
    ("2020-02-29", "DATE", "1582934400000"), ("2021-02-29", "DATE", None), ("2020-01-01 01:02:03.456789", "DATETIME", "1577840523456"), ("2020-01-01 25:00:00", "DATETIME2", None), ("10:00:00.5", "TIME2", "36000500"),
    ("838:59:59", "TIME", None), ("300", "TINY", "300"), ("3000000000", "LONG", None), ("3000000000", "LONGLONG", "3000000000"), ("101", "BIT", None), ("a", "ENUM", None), ("a,b", "SET", None), ("x", "BLOB", "x"), (None, "DATE", None),
])
def test_target_values(spark, text, kind, want):
    assert spark.createDataFrame([(text, kind)], "t string, k string").select(values.target_value(F.col("t"), F.col("k"))).first()[0] == want


def test_lines_and_catalog(spark):
    df = spark.createDataFrame([("X", 5, None, [1, 2], 'a"b\\c\nd')], "event_name string, pos long, file string, n array<int>, t string")
    line = lambda *a: printing.lines(df, *a).first().line
    assert line() == "[X], pos 5 in -" and line("json", ["pos", "file", "n"]) == '{"pos":5,"n":[1,2]}'
    assert line("yaml", ["pos", "file", "n", "t"]) == '---\npos: 5\nfile: null\nn: [1,2]\nt: "a\\"b\\\\c\\nd"'
    with pytest.raises(ValueError):
        printing.lines(df, "xml")
    names = ["schema_id", "table_schema", "table_id", "table_name", "physical_table_name", "distribute_type", "distribute_columns", "primary_columns", "current_version", "is_materialized"]
    rows = [("1", "db", "7", "t", "s##t##7", "HASH", "a,b", "a", 3, 1), ("1", None, "7", "t", "s##t##7", "HASH", "a", "a", 3, 0), ("1", "db", "7", "t", "s##u##7", "HASH", "a", "a", 3, 0)]
    kinds = ", ".join(f"{n} {'long' if n == 'current_version' else 'int' if n == 'is_materialized' else 'string'}" for n in names)
    good, missing, other = catalog.checked_tables(spark.createDataFrame(rows, kinds)).collect()
    assert (good.schema_name, good.table_id, good.distribute_columns, good.is_materialized, good.error) == ("s", 7, ["a", "b"], True, None)
    assert missing.error == "missing: table_schema" and "another table" in other.error
