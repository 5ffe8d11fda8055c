"""Chroma fingerprints of recordings: packed integers from integral-image filters over pitch-class frames.

Samples at RATE are cut into overlapping frames; each frame's power is folded onto the 12 pitch classes, smoothed over
time and scaled to length 1 (silent frames are 0). FILTERS compare the sums of rectangles of this image, taken from its
integral image, as log((1 + a) / (1 + b)); each value falls into one of four ranges, two bits in Gray code, so that
neighbouring ranges differ in one bit. Sixteen filters make one 32-bit integer for each place in time.
"""

from __future__ import annotations

import io
import wave

import numpy as np

RATE, FRAME, HOP = 11025, 4096, 1365
LOWEST, HIGHEST = 28.0, 3520.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WIDTH = 16  # frames under one code
CODES_PER_SECOND = RATE / HOP
#: kind, first pitch class, pitch classes, frames. 0: low against high classes, 1: early against late, 2: quarters
#: across, 3: middle classes against outer, 4: middle time against outer.
FILTERS = tuple((k % 5, (5 * k) % 7, 4 + 2 * (k % 2) if k % 5 < 3 else 6, (16, 8, 12, 4)[k % 4] if k % 5 != 4 else 12) for k in range(16))
#: Where each filter's outer ranges begin: about the quartiles of its values over noise.
SPREAD = (0.18, 0.11, 0.17, 0.23, 0.09, 0.18, 0.16, 0.10, 0.18, 0.09, 0.20, 0.07, 0.16, 0.21, 0.09, 0.20)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _folding() -> np.ndarray:
    """(bins, 12): which pitch class a frequency bin counts for, and how much: its middle counts fully."""
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(freq), 12), np.float32)
    for i, f in enumerate(freq):
        if LOWEST <= f <= HIGHEST:
            out[i, round(12 * np.log2(f / 27.5)) % 12] = 1
    return out


_FOLD, _WINDOW = _folding(), np.hanning(FRAME).astype(np.float32)


def read_wav(data: bytes) -> np.ndarray:
    """Mono samples at RATE of a PCM WAV file; what isn't one has none."""
    try:
        with wave.open(io.BytesIO(data)) as file:
            width, channels, rate = file.getsampwidth(), file.getnchannels(), file.getframerate()
            raw = file.readframes(file.getnframes())
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0, np.float32)
    if width not in (1, 2, 3, 4) or not channels or not rate:
        return np.zeros(0, np.float32)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 3:  # a low byte more, which counts for nothing
        raw, width = np.pad(np.frombuffer(raw, np.uint8).reshape(-1, 3), ((0, 0), (1, 0))).tobytes(), 4
    x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    x = ((x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))).reshape(-1, channels).mean(1)
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x) * RATE // rate) * (rate / RATE), np.arange(len(x)), x)
    return x.astype(np.float32)


def chroma(samples: np.ndarray, block: int = 512) -> np.ndarray:
    """(frames, 12) smoothed pitch-class frames."""
    n = (len(samples) - FRAME) // HOP + 1 if len(samples) >= FRAME else 0
    if n <= 0:
        return np.zeros((0, 12))
    rows = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((n, 12))
    for low in range(0, n, block):
        spectrum = np.fft.rfft(rows[low : low + block] * _WINDOW)
        out[low : low + block] = (spectrum.real**2 + spectrum.imag**2) @ _FOLD
    padded = np.pad(out, ((2, 2), (0, 0)))
    out = sum(w * padded[k : k + n] for k, w in enumerate(SMOOTH))
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(norm > 1e-4 * FRAME, out / np.maximum(norm, 1e-12), 0)


def values(image: np.ndarray) -> np.ndarray:
    """(places, 16) filter values of a chroma image."""
    places = len(image) - WIDTH + 1
    if places <= 0:
        return np.zeros((0, len(FILTERS)))
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def box(t: int, p: int, w: int, h: int) -> np.ndarray:
        a, b = total[t : t + places], total[t + w : t + w + places]
        return b[:, p + h] - a[:, p + h] - b[:, p] + a[:, p]

    out = np.empty((places, len(FILTERS)))
    for i, (kind, p, h, w) in enumerate(FILTERS):
        t = (WIDTH - w) // 2
        everything = box(t, p, w, h)
        if kind == 0:
            a = box(t, p, w, h // 2)
        elif kind == 1:
            a = box(t, p, w // 2, h)
        elif kind == 2:
            a = box(t, p, w // 2, h // 2) + box(t + w // 2, p + h // 2, w // 2, h // 2)
        elif kind == 3:
            a = box(t, p + h // 3, w, h // 3) * 2
            everything = everything + a / 2
        else:
            a = box(t + w // 3, p, w // 3, h) * 2
            everything = everything + a / 2
        out[:, i] = np.log1p(a) - np.log1p(everything - a)
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """The packed integers (uint32) of a recording; none if it is shorter than FRAME + (WIDTH - 1) * HOP samples."""
    found = values(chroma(samples))
    codes = np.zeros(len(found), np.uint32)
    for i, spread in enumerate(SPREAD):
        codes = (codes << np.uint32(2)) | _GRAY[np.searchsorted((-spread, 0.0, spread), found[:, i], "right")]
    return codes
