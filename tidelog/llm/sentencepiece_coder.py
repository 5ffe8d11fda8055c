"""SentencePiece encoding and decoding of a text column, on executors, batch by batch (see pieces.py for the method).

The model's bytes (at most MAX_MODEL_BYTES, checked) are broadcast; nothing is read from a folder by an executor, nothing
is shuffled, and a batch's memory is bounded by BATCH_BYTES of text or by its longest text.

Defined results: a null or empty text has no ids and decodes to an empty text. Bytes that aren't valid UTF-8 are read as
U+FFFD, as make_valid_utf8 places it, and such a text isn't ``restored``. Repeated rows are encoded row by row. Other
columns pass through; clashing names are replaced. An empty table gives an empty result. ``restored`` tells whether decoding
gives the text back; it doesn't where a text holds the space mark U+2581 itself, which the model can't tell from a space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.pieces import BATCH_BYTES, Encoder, Model
from tidelog.llm.pieces import decode as decode_ids
from tidelog.llm.text_arrays import slices

MAX_MODEL_BYTES = 64 << 20
NEW = ("ids", "n_tokens", "ids_sha256", "decoded_sha256", "restored")


@lru_cache(maxsize=2)
def _model(data: bytes) -> Model:
    return Model.load(data)


def _encode(batches: Iterator[pa.RecordBatch], model: Broadcast, others: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(_model(model.value))
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text"), BATCH_BYTES):
            ids, first = encoder.encode(data, offsets)
            decoded, at = decode_ids(encoder.model, ids, first)
            little = ids.astype("<i4")
            cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            back = [decoded[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            valid = batch.column("valid").slice(a, b - a).to_pylist()
            same = [v and x == data[i:j].tobytes() for v, x, i, j in zip(valid, back, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            kept = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)) if with_ids else pa.nulls(b - a, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(a, b - a) for c in others), kept, pa.array(np.diff(first)),
                    pa.array([hashlib.sha256(little[i:j]).hexdigest() for i, j in cut]), pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array(same, pa.bool_()),
                ],
                [*others, *NEW],
            )


def _decode(batches: Iterator[pa.RecordBatch], model: Broadcast, others: list[str]) -> Iterator[pa.RecordBatch]:
    own = _model(model.value)
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            column = part.column("ids")
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            ids = np.where((ids >= 0) & (ids < len(own.pieces)), ids, own.unknown)
            data, at = decode_ids(own, ids, first)
            text = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(text, pa.string())], [*others, "text"])


def _shipped(df: DataFrame, model: bytes) -> Broadcast:
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"a model of more than {MAX_MODEL_BYTES} bytes")
    Model.load(model)  # refused here, not on an executor
    return df.sparkSession.sparkContext.broadcast(model)


def _numbered(df: DataFrame, without: tuple[str, ...]) -> tuple[list[str], list, list[str], str]:
    """(columns that stay, numbered expressions, their names, their types)."""
    others = [c for c in df.columns if c not in without]
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*columns).schema.fields)
    return others, columns, [f"c{i}" for i in range(len(others))], kinds


def encode(docs: DataFrame, model: bytes, text: str = "text", with_ids: bool = True) -> DataFrame:
    """docs without its text, with ids (null unless with_ids), n_tokens, the digests of ids and of their decoding, and restored."""
    others, columns, names, kinds = _numbered(docs, (text, *NEW))
    whole = F.col(f"`{text}`").cast("string")
    base = docs.select(*columns, F.make_valid_utf8(whole).cast("binary").alias("text"), F.coalesce(F.is_valid_utf8(whole), F.lit(True)).alias("valid"))
    run = partial(_encode, model=_shipped(docs, model), others=names, with_ids=with_ids)
    done = base.mapInArrow(run, f"{kinds}ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string, restored boolean")
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, others, strict=True)), *NEW)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "text") -> DataFrame:
    """df without its ids, with their text; null ids are empty, and ids that the model doesn't have are unknown."""
    others, columns, names, kinds = _numbered(df, (ids, text))
    base = df.select(*columns, F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    done = base.mapInArrow(partial(_decode, model=_shipped(df, model), others=names), f"{kinds}text string")
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, others, strict=True)), F.col("text").alias(text))
