"""JSON paths and geometry."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(text: Column, path: str) -> Column:
    """The value at ``a.b[0].c`` as text (strings bare, objects and arrays as JSON); null if it is missing."""
    return F.get_json_object(text, "$." + path)


def json_has(text: Column, path: str) -> Column:
    """Whether a path exists; a null at its end counts as one."""
    head, _, tail = path.rpartition(".")
    if not tail.endswith("]"):
        keys = F.json_object_keys(F.get_json_object(text, "$." + head) if head else text)
        return F.coalesce(F.array_contains(keys, tail), F.lit(False))
    return F.get_json_object(text, "$." + path).isNotNull()


def json_long(text: Column, path: str) -> Column:
    """A number or a string of digits as a long; null for anything else."""
    return json_path(text, path).try_cast("bigint")


def json_double(text: Column, path: str) -> Column:
    return json_path(text, path).try_cast("double")


def json_keys(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))


def json_length(text: Column, path: str) -> Column:
    return F.json_array_length(json_path(text, path))


GEOMETRY = "struct<kind:string, wkt:string, xs:array<double>, ys:array<double>, rings:array<array<struct<x:double,y:double>>>>"
# Geometry kinds of well-known binary.
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


def _number(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e16 else repr(v)


def read_wkb(data: bytes, at: int = 0) -> tuple[str, str, list, list, int]:
    """(kind, text, points, rings, end) of a geometry in well-known binary; ValueError if it isn't one."""
    if at + 5 > len(data) or data[at] not in (0, 1):
        raise ValueError("no geometry")
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5

    def count() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise ValueError("cut short")
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        return n

    def points(n: int) -> list:
        nonlocal at
        if n < 0 or at + 16 * n > len(data):
            raise ValueError("cut short")
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at)
        at += 16 * n
        return list(zip(flat[::2], flat[1::2], strict=True))

    said = lambda ps: ", ".join(f"{_number(x)} {_number(y)}" for x, y in ps)
    kind = KINDS.get(code)
    if kind == "POINT":
        found = points(1)
        return kind, f"POINT({said(found)})", found, [], at
    if kind == "LINESTRING":
        found = points(count())
        return kind, f"LINESTRING({said(found)})", found, [], at
    if kind == "POLYGON":
        rings = [points(count()) for _ in range(count())]
        return kind, "POLYGON(" + ", ".join(f"({said(r)})" for r in rings) + ")", [p for r in rings for p in r], rings, at
    if kind is None:
        raise ValueError("no geometry")
    inner, everything, rings = [], [], []
    for _ in range(count()):
        own, text, found, own_rings, at = read_wkb(data, at)
        inner.append(text if kind == "GEOMETRYCOLLECTION" else text.removeprefix(own))
        everything += found
        rings += own_rings
    return kind, f"{kind}({', '.join(inner)})", everything, rings, at


def _decode_wkb(data: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in data:
        try:
            kind, text, found, rings, _ = read_wkb(bytes(raw))
            rows.append((kind, text, [p[0] for p in found], [p[1] for p in found], [[{"x": x, "y": y} for x, y in r] for r in rings]))
        except (ValueError, TypeError, struct.error):
            rows.append((None, None, None, None, None))
    return pd.DataFrame(rows, columns=["kind", "wkt", "xs", "ys", "rings"])


def decode_wkb(data: Column) -> Column:
    """struct(kind, wkt, xs, ys, rings) of well-known binary; all null for what isn't a geometry."""
    return F.pandas_udf(_decode_wkb, GEOMETRY)(data)


def bounding_box(xs: Column, ys: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y, width, height, area); null without a point."""
    low_x, high_x, low_y, high_y = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    box = F.struct(
        low_x.alias("min_x"), low_y.alias("min_y"), high_x.alias("max_x"), high_y.alias("max_y"), (high_x - low_x).alias("width"),
        (high_y - low_y).alias("height"), ((high_x - low_x) * (high_y - low_y)).alias("area"),
    )
    return F.when(F.size(xs) > 0, box)


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) crosses a closed ring (array of struct(x, y)) an odd number of times."""
    n = F.size(ring)
    before = F.when(n > 0, F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, n - 1))).otherwise(ring)
    crosses = F.zip_with(
        ring, before,
        lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(None)).otherwise(b["y"] - a["y"]) + a["x"]), 1).otherwise(0),
    )
    return F.aggregate(crosses, F.lit(0), lambda s, c: s + c) % 2 == 1


def same_point(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (F.abs(x1 - x2) < 1e-10) & (F.abs(y1 - y2) < 1e-10)


def _binary_json(data: pd.Series) -> pd.Series:
    import json

    from tidelog.sources.cells import json_value

    def text(raw):
        if raw is None:
            return None
        try:
            return json.dumps(json_value(bytes(raw)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, IndexError, struct.error):
            return None

    return data.map(text, na_action="ignore")


def binary_json(data: Column) -> Column:
    """The JSON text of a document in the log's binary form; null where it is none."""
    return F.pandas_udf(_binary_json, "string")(data)
