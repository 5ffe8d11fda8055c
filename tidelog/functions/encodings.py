"""Binary forms of values, made and read by Spark's own functions.

int_bytes and read_int are integers of fixed size; the log's length-encoded integers and strings; the codec of relay entries
(fixed or variable integers, in either order of bytes); the row format of target values. Doubles and floats are the only
ones that need Arrow: no function of Spark gives their bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.types import TARGET_TYPES

LITTLE, BIG = "little", "big"
# The first bytes that announce 2, 4 and 8 bytes of a variable integer, of the codec and of the log.
CODEC_MARKS = {2: 251, 4: 252, 8: 253}
LOG_MARKS = {2: 252, 3: 253, 8: 254}


def int_bytes(value: Column, size: int, order: str = LITTLE) -> Column:
    """The low bytes of an integer, as many as size."""
    whole = F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))
    if order == BIG:
        return F.substring(whole, 9 - size, size)
    return F.concat(*(F.substring(whole, 8 - k, 1) for k in range(size)))


def read_int(data: Column, at: Column | int, size: int, order: str = LITTLE, signed: bool = False) -> Column:
    """The integer in `size` bytes from a place on (1 is the first byte); null beyond the end. Eight bytes are signed."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substr(data, at, F.lit(size))
    if order == LITTLE:
        part = F.concat(*(F.substr(part, F.lit(size - k), F.lit(1)) for k in range(size)))
    value = F.conv(F.hex(part), 16, -10 if size == 8 else 10).cast("long")
    if signed and size < 8:
        value = F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)
    return F.when(F.octet_length(data) >= at + size - 1, value)


def _marked(value: Column, marks: dict[int, int], order: str) -> Column:
    out = F.lit(None).cast("binary")
    for size, mark in sorted(marks.items(), reverse=True):
        own = F.concat(F.lit(bytearray([mark])), int_bytes(value, size, order))
        out = own if size == 8 else F.when((value >= 0) & (value < 1 << (8 * size)), own).otherwise(out)
    return F.when((value >= 0) & (value < 251), int_bytes(value, 1)).otherwise(out)


def length_encoded(value: Column) -> Column:
    """A length as the log writes it: one byte up to 250, else a mark and 2, 3 or 8 bytes."""
    return _marked(value.cast("long"), LOG_MARKS, LITTLE)


def read_length(data: Column, at: Column | int = 1) -> Column:
    """struct(value, size): a length-encoded integer and the bytes it takes; the value of the null mark (251) is null."""
    first = read_int(data, at, 1)
    at = F.lit(at) if isinstance(at, int) else at
    value, size = F.when(first < 251, first), F.lit(1)
    for n, mark in LOG_MARKS.items():
        value, size = F.when(first == mark, read_int(data, at + 1, n)).otherwise(value), F.when(first == mark, n + 1).otherwise(size)
    return F.struct(value.alias("value"), size.alias("size"))


def length_encoded_string(text: Column) -> Column:
    data = text.cast("binary")
    return F.concat(length_encoded(F.octet_length(data)), data)


def read_length_encoded_string(data: Column, at: Column | int = 1) -> Column:
    """The text (bytes that aren't UTF-8 as U+FFFD) of a length-encoded string; null where its bytes aren't all there."""
    head = read_length(data, at)
    at = F.lit(at) if isinstance(at, int) else at
    body = F.substr(data, at + head["size"], head["value"].cast("int"))
    return F.when(F.octet_length(body) == head["value"], F.make_valid_utf8(body.cast("string")))


def null_terminated(data: Column, at: int = 1) -> Column:
    """The text up to a zero byte; null without one. Bytes that aren't UTF-8 are U+FFFD."""
    digits = F.hex(F.substr(data, F.lit(at), F.octet_length(data)))
    pairs = F.regexp_extract(digits, "^((?:[0-9A-F]{2})*?)00", 1)
    return F.when(digits.rlike("^(?:[0-9A-F]{2})*?00"), F.make_valid_utf8(F.unhex(pairs).cast("string")))


def fixed_text(data: Column, at: int, size: int) -> Column:
    """The text of `size` bytes from a place on; null where they aren't all there."""
    part = F.substr(data, F.lit(at), F.lit(size))
    return F.when(F.octet_length(part) == size, F.make_valid_utf8(part.cast("string")))


# the codec of relay entries -------------------------------------------------------------------------------------------

INTEGERS = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "i8": 1, "i16": 2, "i32": 4, "i64": 8}


def _integer(value: Column, kind: str, fixed: bool, order: str) -> Column:
    value = value.cast("long")
    if fixed or INTEGERS[kind] == 1:
        return int_bytes(value, INTEGERS[kind], order)
    if kind[0] == "i":  # small negative numbers stay short
        value = F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))
    return _marked(value, CODEC_MARKS, order)


def encode_fields(fields: list[tuple[Column, str]], fixed: bool = True, order: str = LITTLE) -> Column:
    """The fields one after another. Kinds: integers, bool, string, bytes; a kind with ? at its end may be null.

    fixed: integers and lengths at their full size (lengths in 8 bytes); else in as few bytes as they need.
    """
    parts = []
    for value, kind in fields:
        bare = kind.rstrip("?")
        if bare in INTEGERS:
            own = _integer(value, bare, fixed, order)
        elif bare == "bool":
            own = int_bytes(value.cast("int"), 1)
        else:
            data = value.cast("binary")
            own = F.concat(_integer(F.octet_length(data), "u64", fixed, order), data)
        parts.append(F.when(value.isNull(), F.lit(bytearray([0]))).otherwise(F.concat(F.lit(bytearray([1])), own)) if kind.endswith("?") else own)
    return F.concat(*parts)


def decode_fields(rows: DataFrame, data: str, fields: list[tuple[str, str]], fixed: bool = True, order: str = LITTLE) -> DataFrame:
    """rows with a column for each (name, kind) that encode_fields wrote; what isn't all there is null."""
    out = rows.withColumn("_at", F.lit(1))
    for name, kind in fields:
        bare, at = kind.rstrip("?"), F.col("_at")
        out = out.withColumn("_there", read_int(F.col(data), at, 1) == 1 if kind.endswith("?") else F.lit(True))
        if kind.endswith("?"):
            out = out.withColumn("_at", at + 1)
        size = INTEGERS.get(bare, 1 if bare == "bool" else 8)
        if fixed or size == 1:
            out = out.withColumn("_n", F.struct(read_int(F.col(data), at, size, order, bare[0] == "i").alias("value"), F.lit(size).alias("size")))
        else:
            first, value, taken = read_int(F.col(data), at, 1), read_int(F.col(data), at, 1), F.lit(1)
            for n, mark in CODEC_MARKS.items():
                value, taken = F.when(first == mark, read_int(F.col(data), at + 1, n, order)).otherwise(value), F.when(first == mark, n + 1).otherwise(taken)
            if bare[0] == "i":
                value = F.shiftrightunsigned(value, 1).bitwiseXOR(-value.bitwiseAND(1))
            out = out.withColumn("_n", F.struct(value.alias("value"), taken.alias("size")))
        if bare in INTEGERS or bare == "bool":
            value, used = (F.col("_n.value") if bare in INTEGERS else F.col("_n.value") == 1), F.col("_n.size")
        else:
            body = F.substr(F.col(data), at + F.col("_n.size"), F.col("_n.value").cast("int"))
            body = F.when(F.octet_length(body) == F.col("_n.value"), body)
            value, used = (body.cast("string") if bare == "string" else body), F.col("_n.size") + F.col("_n.value").cast("int")
        out = out.withColumn(name, F.when(F.col("_there"), value)).withColumn("_at", F.when(F.col("_there"), at + used).otherwise(at))
    return out.drop("_at", "_there", "_n")


def entry_frame(index: Column, payload: Column) -> Column:
    """A segment's entry: index and size in 8 bytes each, the CRC-32 in 4, then the payload."""
    data = payload.cast("binary")
    return F.concat(int_bytes(index, 8), int_bytes(F.octet_length(data), 8), int_bytes(F.crc32(data), 4), data)


def read_frame(data: Column) -> Column:
    """struct(index, size, crc, payload, crc_ok) of an entry; the payload is null where it isn't all there."""
    payload = F.substring(data, 21, 2147483647)
    size, crc = read_int(data, 9, 8), read_int(data, 17, 4)
    return F.struct(read_int(data, 1, 8).alias("index"), size.alias("size"), crc.alias("crc"), F.when(F.octet_length(payload) == size, payload).alias("payload"), (F.crc32(payload) == crc).alias("crc_ok"))


def segment_header(segment: Column, version: Column, first_index: Column, max_bytes: Column, max_entries: Column) -> Column:
    """The 64 bytes at the head of a segment's file; the last 36 are 0."""
    return F.concat(int_bytes(segment, 4), int_bytes(version, 4), int_bytes(first_index, 8), int_bytes(max_bytes, 8), int_bytes(max_entries, 4), F.lit(bytearray(36)))


# values of target rows ------------------------------------------------------------------------------------------------


def _double_bits(values: pd.Series) -> pd.Series:
    return pd.Series(values.to_numpy(np.float64).view(np.int64))


def _float_bits(values: pd.Series) -> pd.Series:
    return pd.Series(values.to_numpy(np.float32).view(np.int32).astype(np.int64))


def double_bytes(value: Column) -> Column:
    return F.when(value.isNotNull(), int_bytes(F.pandas_udf(_double_bits, "long")(value.cast("double")), 8))


def float_bytes(value: Column) -> Column:
    return F.when(value.isNotNull(), int_bytes(F.pandas_udf(_float_bits, "long")(value.cast("float")), 4))


def target_bytes(value: Column, kind: str, extra_flag: bool = False) -> Column:
    """A value of a target row: a null flag (1 and nothing more for null), the type's code in 4 bytes, two bytes of 0, the value.

    extra_flag: one more 0 after the null flag. Temporal kinds take epoch milliseconds. Decimals are written as their text, like
    strings, with a 4-byte length, so that none loses digits.
    """
    sizes = {"boolean": 1, "byte": 1, "short": 2, "int": 4, "long": 8, "date": 8, "time": 8, "datetime": 8, "timestamp": 8}
    if kind in sizes:
        raw = int_bytes(value.cast("int") if kind == "boolean" else value, sizes[kind])
    elif kind in ("float", "double"):
        raw = float_bytes(value) if kind == "float" else double_bytes(value)
    else:
        data = (value.cast("string") if kind == "decimal" else value).cast("binary")
        raw = F.concat(int_bytes(F.octet_length(data), 4), data)
    head = bytearray([0]) * (2 if extra_flag else 1) + bytearray(TARGET_TYPES[kind].to_bytes(4, "little")) + bytearray(2)
    return F.when(value.isNull(), F.lit(bytearray([1]))).otherwise(F.concat(F.lit(head), raw))


def _points(data: pd.Series) -> pd.DataFrame:
    good = data.map(lambda b: b is not None and len(b) == 16).to_numpy(bool)
    out = np.full((len(data), 2), np.nan)
    if good.any():
        out[good] = np.frombuffer(b"".join(data[good]), "<f8").reshape(-1, 2)
    return pd.DataFrame({"x": out[:, 0], "y": out[:, 1], "good": good})


def point2d(data: Column) -> Column:
    """struct(x, y) of 16 bytes that hold two doubles; null for any other number of bytes. (A sample of a type of one's own.)"""
    found = F.pandas_udf(_points, "x double, y double, good boolean")(data)
    return F.when(found["good"], F.struct(found["x"].alias("x"), found["y"].alias("y")))
