"""Media columns: WAV bytes to spectral-peak pair fingerprints.

A clip's WAV bytes are read with the wave module, cut into windowed frames and transformed (short-time
Fourier transform). Peaks are the cells that no cell of their neighbourhood exceeds. Every peak is
paired with every later peak of its target zone; a pair's hash packs both frequencies and the time
between, and is stored with the anchor's time.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, HOP = 256, 128
#: A peak is the largest cell within so many frames and frequency bins on each side.
NEAR_FRAMES, NEAR_BINS = 3, 8
#: A peak's power is at least this share of the clip's largest.
FLOOR = 1e-4
#: The target zone: frames ahead of the anchor, and bins above or below it.
ZONE_FRAMES, ZONE_BINS = 24, 64
RATE, SEGMENT, TONES = 8_000, 512, 8
#: Clips that are Python objects at a time, and frames that are transformed at a time.
_SLICE, _BLOCK = 64, 4_096


def read_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples in -1..1 of PCM WAV bytes of 8, 16, 24 or 32 bits; channels are averaged."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width > 4:
        raise wave.Error(f"samples of {8 * width} bits")
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(np.float32) / 0x800000 - 1
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(axis=1)


def stft_power(x: np.ndarray, window: int = WINDOW, hop: int = HOP) -> np.ndarray:
    """Power by frame and frequency bin; a clip shorter than a window is padded with silence to one frame."""
    if len(x) < window:
        x = np.pad(x, (0, window - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x.astype(np.float32), window)[::hop]
    power = np.empty((len(frames), window // 2 + 1), np.float32)
    for at in range(0, len(frames), _BLOCK):  # spectra take several times what their powers do
        z = np.fft.rfft(frames[at : at + _BLOCK] * _hann(window), axis=1)
        power[at : at + _BLOCK] = z.real**2 + z.imag**2
    return power


@lru_cache
def _hann(window: int) -> np.ndarray:
    return np.hanning(window).astype(np.float32)


def _largest_near(p: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Maximum over 2 * reach + 1 cells along an axis, by doubling."""
    shape = list(p.shape)
    shape[axis] += 2 * reach
    q = np.full(shape, -1.0, p.dtype)
    cut = lambda a, lo, n: a[lo : lo + n] if axis == 0 else a[:, lo : lo + n]
    cut(q, reach, p.shape[axis])[:] = p
    width, want = 1, 2 * reach + 1
    while width < want:
        step = min(width, want - width)
        n = q.shape[axis] - step
        q = np.maximum(cut(q, 0, n), cut(q, step, n))
        width += step
    return q


def peaks(power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, by time and then by frequency; silence has none."""
    top = power.max(initial=0)
    if top <= 0:
        return np.zeros(0, int), np.zeros(0, int)
    best = _largest_near(_largest_near(power, NEAR_FRAMES, 0), NEAR_BINS, 1)
    return np.nonzero((power >= best) & (power >= FLOOR * top))


def pair_hashes(frames: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor frames and hashes of all pairs: anchor's bin << 20 | other's bin << 8 | frames between."""
    frames, bins = frames.astype(np.int64), bins.astype(np.int64)
    first = np.searchsorted(frames, frames, side="right")
    width = np.searchsorted(frames, frames + ZONE_FRAMES, side="right") - first
    i = np.repeat(np.arange(len(frames)), width)
    j = np.repeat(first, width) + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
    near = np.abs(bins[j] - bins[i]) <= ZONE_BINS
    i, j = i[near], j[near]
    return frames[i], (bins[i] << 20) | (bins[j] << 8) | (frames[j] - frames[i])


_NO_FRAMES, _NO_PRINTS = np.zeros(0, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fingerprint(data: bytes | None) -> tuple[str, int | None, int | None, int | None, np.ndarray, np.ndarray]:
    """Status, sample rate, samples, peaks, and the times in milliseconds and hashes of the pairs."""
    if data is None:
        return "null", None, None, None, *_NO_PRINTS
    try:
        rate, x = read_wav(bytes(data))
    except (wave.Error, EOFError, ValueError, RuntimeError, OverflowError, struct.error):
        return "unreadable", None, None, None, *_NO_PRINTS
    frames, bins = peaks(stft_power(x)) if len(x) else (_NO_FRAMES, _NO_FRAMES)
    at, hashes = pair_hashes(frames, bins)
    return "ok", rate, len(x), len(frames), at * HOP * 1000 // max(rate, 1), hashes


_FIELDS = [("status", pa.string()), ("sample_rate", pa.int64()), ("n_samples", pa.int64()), ("n_peaks", pa.int32())]
_PRINT = pa.struct([("t_ms", pa.int64()), ("hash", pa.int64())])
_PRINTS = "status string, sample_rate long, n_samples long, n_peaks int, prints array<struct<t_ms: long, hash: long>>"


def _batch(found: list[tuple]) -> pa.StructArray:
    """Rows of :func:`fingerprint` as one Arrow array; the prints never become Python objects."""
    plain = [pa.array([r[i] for r in found], kind) for i, (_, kind) in enumerate(_FIELDS)]
    ends = np.concatenate([[0], np.cumsum([len(r[4]) for r in found])]).astype(np.int32)
    times, hashes = (np.concatenate([r[k] for r in found]) if found else np.zeros(0, np.int64) for k in (4, 5))
    pairs = pa.StructArray.from_arrays([pa.array(times, pa.int64()), pa.array(hashes, pa.int64())], fields=list(_PRINT))
    none = pa.array([r[0] != "ok" for r in found], pa.bool_())
    prints = pa.ListArray.from_arrays(pa.array(ends), pairs, mask=none)
    return pa.StructArray.from_arrays([*plain, prints], names=[*(n for n, _ in _FIELDS), "prints"])


def fingerprints(clips: DataFrame, id_column: str = "vec_id", wav_column: str = "wav") -> DataFrame:
    """(id, status, sample_rate, n_samples, n_peaks, prints), one row per row of ``clips``.

    ``prints`` is an array of structs (t_ms, hash), ordered by time. Only the two named columns are
    read; others are ignored whatever their names. Null bytes have status "null" and bytes that the
    wave module can't read (also empty ones, and samples of over 32 bits) "unreadable", both with nulls elsewhere. A clip without
    samples, or of silence, is "ok" with no prints. Cells that tie for the largest of their
    neighbourhood are all peaks. Repeated rows are repeated. Clips of any length are read whole, and
    no pair of the target zone is left out. An empty table gives no rows.
    """

    @F.arrow_udf(_PRINTS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = [_batch([fingerprint(x.as_py()) for x in b.slice(at, _SLICE)]) for at in range(0, len(b), _SLICE)]
            yield pa.concat_arrays(parts) if parts else _batch([])

    found = clips.select(F.col(id_column).alias(id_column), of(F.col(wav_column).cast("binary")).alias("p"))
    return found.select(id_column, "p.status", "p.sample_rate", "p.n_samples", "p.n_peaks", "p.prints")


def write_wav(x: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.round(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def render_wav(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, wav): each vector as a clip of tones, for tables that hold no recordings.

    The vector is cut into segments of eight values; each value is the loudness of one of eight
    tones, whose pitches step up from segment to segment. Null or empty vectors give null bytes.
    """
    t = np.arange(SEGMENT) / RATE
    bank = np.stack([[np.sin(2 * np.pi * (250 + 440 * k + 50 * (s % 8)) * t) for k in range(TONES)] for s in range(8)])

    @F.pandas_udf("binary")
    def wav(v: pd.Series) -> pd.Series:
        def one(x):
            if x is None or not len(x):
                return None
            x = np.nan_to_num(np.asarray(x, dtype=np.float64))
            x = np.pad(x, (0, -len(x) % TONES)).reshape(-1, 1, TONES)
            y = (x @ bank[np.arange(len(x)) % 8]).ravel()
            return write_wav(y / max(1e-9, np.abs(y).max()) * 0.9)

        return v.map(one)

    return vectors.select(F.col(id_column).alias(id_column), wav(F.col(vector_column)).alias("wav"))
