"""String functions: similarity, comparison forms, run lengths, character sets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STRING_HEADER_BYTES = 24
SLICE = 1 << 18


def similarity(a: Column, b: Column) -> Column:
    """1 for equal strings, 0 if one is empty, else 1 - edit distance / length of the longer, in characters."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def comparison_form(text: Column) -> Column:
    return F.lower(F.trim(text))


def memory_estimate(text: Column) -> Column:
    return (F.octet_length(text) + STRING_HEADER_BYTES).cast("long")


def worth_interning(text: Column, min_length: int, repeats_likely: Column) -> Column:
    n = F.octet_length(text)
    return (n >= min_length) & (repeats_likely | (n > 50))


def repeat_ratio(text: Column) -> Column:
    """Share of characters that equal the one before; 0 for an empty text."""
    n = F.char_length(text)
    return F.when(n == 0, 0.0).otherwise((n - F.char_length(F.regexp_replace(text, r"(?s)(.)\1+", "$1"))) / n)


def worth_compressing(text: Column, min_length: int) -> Column:
    return (F.octet_length(text) >= min_length) & (repeat_ratio(text) > 0.2)


def _joined(data: pd.Series):
    """(all bytes, where each value's begin, which values are null), nulls being empty."""
    import numpy as np

    raw = [b"" if x is None else bytes(x) for x in data]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64), data.isna().to_numpy()


def _in_slices(run: Callable[[pd.Series], pd.Series], data: pd.Series) -> pd.Series:
    """run on slices of a batch, of some SLICE bytes each: its arrays are many times the bytes of what it is given."""
    import numpy as np

    before = np.cumsum([0, *(0 if x is None else len(x) for x in data)])[:-1]
    cuts = [0, *(np.flatnonzero(np.diff(before // SLICE)) + 1).tolist(), len(data)]
    return pd.Series([x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in run(data.iloc[a:b].reset_index(drop=True))], dtype=object)


def _encode_runs(data: pd.Series) -> pd.Series:
    return _in_slices(_encoded, data)


def _encoded(data: pd.Series) -> pd.Series:
    import numpy as np

    x, first, null = _joined(data)
    if not len(x):
        return pd.Series([None if n else b"" for n in null], dtype=object)
    new = np.r_[True, x[1:] != x[:-1]]
    new[first[:-1][np.diff(first) > 0]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(x)])
    pieces = -(-size // 255)
    count = np.full(int(pieces.sum()), 255)
    count[np.cumsum(pieces) - 1] = size - (pieces - 1) * 255
    out = np.stack([count.astype(np.uint8), np.repeat(x[start], pieces)], 1).tobytes()
    ends = 2 * np.r_[0, np.cumsum(pieces)][np.searchsorted(start, first)]
    return pd.Series([None if n else out[a:b] for n, a, b in zip(null, ends[:-1].tolist(), ends[1:].tolist(), strict=True)], dtype=object)


def run_length_encode(data: Column) -> Column:
    """(count, byte) pairs of runs of at most 255 bytes."""
    return F.pandas_udf(_encode_runs, "binary")(data)


def _decode_runs(data: pd.Series) -> pd.Series:
    return _in_slices(_decoded, data)


def _decoded(data: pd.Series) -> pd.Series:
    import numpy as np

    odd = data.map(lambda x: x is not None and len(x) % 2 == 1).to_numpy(bool)
    x, first, null = _joined(data.where(~odd, None))
    pairs = x.reshape(-1, 2)
    ends = np.r_[0, np.cumsum(pairs[:, 0].astype(np.int64))][first // 2]
    out = np.repeat(pairs[:, 1], pairs[:, 0]).tobytes()
    return pd.Series([None if n else out[a:b] for n, a, b in zip(null | odd, ends[:-1].tolist(), ends[1:].tolist(), strict=True)], dtype=object)


def run_length_decode(data: Column) -> Column:
    """The bytes of (count, byte) pairs; null where the length is odd."""
    return F.pandas_udf(_decode_runs, "binary")(data)


# Character sets by id: name, most bytes of a character, Python's name of the encoding.
CHARSETS = {
    1: ("big5", 2, "big5"), 3: ("dec8", 1, "latin-1"), 8: ("latin1", 1, "cp1252"), 11: ("ascii", 1, "ascii"), 28: ("gbk", 2, "gbk"),
    33: ("utf8", 3, "utf-8"), 45: ("utf8mb4", 4, "utf-8"), 63: ("binary", 1, "hex"), 95: ("cp932", 2, "cp932"), 129: ("euckr", 2, "euc_kr"),
}


def _decode_charset(data: pd.Series, charset: pd.Series) -> pd.Series:
    def decode(raw, code):
        if raw is None or code is None or int(code) not in CHARSETS:
            return None
        name = CHARSETS[int(code)][2]
        return bytes(raw).hex() if name == "hex" else bytes(raw).decode(name, "replace")

    return pd.Series([decode(a, None if pd.isna(b) else b) for a, b in zip(data, charset, strict=True)], dtype=object)


def decode_charset(data: Column, charset: Column) -> Column:
    """Bytes in a character set, by id, as text: binary as hexadecimal digits, bytes that don't fit replaced, unknown ids null."""
    # UTF-8 and binary are Spark's own; Python sees only the others
    own = charset.isin(33, 45, 63)
    other = F.pandas_udf(_decode_charset, "string")(F.when(~own, data), charset)
    return F.when(charset.isin(33, 45), F.make_valid_utf8(data.cast("string"))).when(charset == 63, F.lower(F.hex(data))).otherwise(other)


def detect_charset(data: Column) -> Column:
    """33 after a byte order mark or for valid UTF-8, 11 for ASCII; null under three bytes or if neither."""
    text = data.cast("string")
    return (
        F.when(F.octet_length(data) < 3, F.lit(None)).when(F.hex(F.substring(data, 1, 3)) == "EFBBBF", 33)
        .when(F.octet_length(data) == F.octet_length(F.regexp_replace(F.make_valid_utf8(text), r"[^\x00-\x7F]", "")), 11)
        .when(F.is_valid_utf8(text), 33).cast("int")
    )


def valid_in_charset(data: Column, charset: Column) -> Column:
    """ASCII and UTF-8 are tested; other known sets take any byte; unknown ids are null."""
    text = data.cast("string")
    ascii_only = F.octet_length(data) == F.octet_length(F.regexp_replace(F.make_valid_utf8(text), r"[^\x00-\x7F]", ""))
    return F.when(charset == 11, ascii_only).when(charset.isin(33, 45), F.is_valid_utf8(text)).when(charset.isin(*CHARSETS), F.lit(True))


def is_multibyte(charset: Column) -> Column:
    return charset.isin(*(k for k, v in CHARSETS.items() if v[1] > 1))


def max_char_bytes(charset: Column) -> Column:
    out = F.lit(1)
    for code, (_, size, _) in CHARSETS.items():
        if size > 1:
            out = F.when(charset == code, size).otherwise(out)
    return out


def charset_form(name: Column) -> Column:
    """The form in which two spellings of a character set's name are equal."""
    return F.translate(F.lower(name), "-_", "")


def pretty_bytes(n: Column) -> Column:
    """A size in decimal units with two decimals."""
    out = F.format_string("%.0f B", n.cast("double"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(n >= 1000**power, F.format_string(f"%.2f {unit}", n / float(1000**power))).otherwise(out)
    return out


def pretty_duration(seconds: Column) -> Column:
    """Whole seconds as days, hours, minutes and seconds, without parts that are 0."""
    s = seconds.cast("long")
    parts = [(F.floor(s / 86400), "d"), (F.floor(s / 3600) % 24, "h"), (F.floor(s / 60) % 60, "m"), (s % 60, "s")]
    return F.when(s == 0, "0s").otherwise(F.concat_ws(" ", *(F.when(v > 0, F.concat(v.cast("string"), F.lit(u))) for v, u in parts)))
