"""op4: chroma fingerprints and alignment of a recording of every row of embeddings.

No table holds sound, so each vector is played: its components, scaled to mean square 1, set how loud the 12 pitch classes
are in 32 steps of two hops. Near vectors make near recordings. A recording (175 kB as 16-bit samples) is made where it is
fingerprinted, and never stored.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.audio_match import align
from tidelog.llm.chroma import HOP, RATE

NAME = "op4_chroma_fingerprints"
STEPS = 32
_TIME = np.arange(2 * HOP * STEPS + 2 * HOP) / RATE
_TONES = np.stack([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * _TIME + k) for k in range(12)]).astype(np.float32).reshape(12, STEPS + 1, 2 * HOP)


def play(vector: list | None) -> np.ndarray:
    """Samples in [-1, 1] with 16 bits; none for a vector that is null, empty or zero, or has null or non-finite parts."""
    if not vector or None in vector:
        return np.zeros(0, np.float32)
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return np.zeros(0, np.float32)
    x = x / np.abs(x).max()
    x = x / np.sqrt((x * x).mean())
    step, tone = np.arange(STEPS + 1)[:, None], np.arange(12)[None, :]
    loud = np.exp(0.4 * np.clip(x[(11 * step + 5 * tone) % len(x)], -4, 4)).astype(np.float32)
    sound = np.einsum("tk,ktn->tn", loud, _TONES, optimize=True).ravel()
    return np.round(sound * (32000 / np.abs(sound).max())).astype(np.float32) / 32768


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return align(vectors, "vec_id", "embedding", play).drop("codes")
