"""Short-time features of sample arrays: level, zero crossings, spectral centroid, pitch; and what spans take from them.

A clip's samples are an array in its row; a batch of clips is worked off in numpy, clip by clip, and every frame of a clip at once. Frames stand around
multiples of the hop: beyond the clip's ends there is silence, for zero crossings its first and last sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

FRAME, HOP, RATE = 400, 320, 16_000
LOWEST, HIGHEST = 50.0, 500.0
#: A lag is a period if its normalised difference falls under this.
TROUGH = 0.1


def framed(x: np.ndarray, frame: int, hop: int, mode: str) -> np.ndarray:
    """(frames, frame): one frame around each multiple of the hop, from 0 to the last within the samples."""
    if not len(x):
        return np.zeros((0, frame))
    padded = np.pad(x, frame // 2, mode=mode)
    return np.lib.stride_tricks.sliding_window_view(padded, frame)[::hop]


def levels(x: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Root mean square of each frame."""
    return np.sqrt((framed(x, frame, hop, "constant") ** 2).mean(axis=1))


def crossings(x: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Share of a frame's samples whose sign differs from the one before; zero is positive, and what is nearly 0 counts as zero."""
    sign = np.signbit(np.where(np.abs(framed(x, frame, hop, "edge")) <= 1e-10, 0.0, framed(x, frame, hop, "edge")))
    return (sign[:, 1:] != sign[:, :-1]).sum(axis=1) / frame


def centroids(x: np.ndarray, rate: float = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Mean frequency of each frame's spectrum under a Hann window, weighted by magnitude; 0 in silence."""
    n = np.arange(frame)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / frame)
    size = np.abs(np.fft.rfft(framed(x, frame, hop, "constant") * window, axis=1))
    total = size.sum(axis=1)
    return np.where(total > 1e-12, (size * (np.arange(size.shape[1]) * rate / frame)).sum(axis=1) / np.maximum(total, 1e-12), 0.0)


def pitches(x: np.ndarray, rate: float = RATE, frame: int = FRAME, hop: int = HOP, low: float = LOWEST, high: float = HIGHEST) -> tuple[np.ndarray, np.ndarray]:
    """Pitch of each frame in Hz and whether it is voiced.

    For each lag, the squared difference of the frame and itself so much later, over the mean of those of all smaller lags. The period is at the bottom of the first trough under
    TROUGH between the two limits, set between samples by a parabola; a frame without one, or silent, has pitch 0. Frames are twice as long as the longest period, at
    least, so that every lag compares as many samples.
    """
    longest, shortest = int(np.ceil(rate / low)), max(int(np.floor(rate / high)), 1)
    width = max(frame, longest)
    rows = framed(x, width + longest, hop, "constant")
    if not len(rows):
        return np.zeros(0), np.zeros(0, bool)
    head = rows[:, :width]
    size = 1 << int(width + 2 * longest).bit_length()
    together = np.fft.irfft(np.fft.rfft(rows, size, axis=1) * np.conj(np.fft.rfft(head, size, axis=1)), size, axis=1)[:, : longest + 1]
    energy = np.concatenate((np.zeros((len(rows), 1)), np.cumsum(rows * rows, axis=1)), axis=1)
    later = energy[:, width : width + longest + 1] - energy[:, : longest + 1]
    apart = np.maximum(energy[:, width : width + 1] + later - 2 * together, 0.0)
    lags = np.arange(1, longest + 1)
    level = np.cumsum(apart[:, 1:], axis=1) / lags
    share = np.ones_like(apart)
    np.divide(apart[:, 1:], level, out=share[:, 1:], where=level > 1e-12 * np.maximum(energy[:, -1:], 1e-12))
    under = (share < TROUGH) & (np.arange(longest + 1) >= shortest)
    voiced = under.any(axis=1)
    out = np.zeros(len(rows))
    for i in np.flatnonzero(voiced).tolist():
        lag = int(under[i].argmax())
        while lag + 1 <= longest and share[i, lag + 1] < share[i, lag]:
            lag += 1
        shift = 0.0
        if 0 < lag < longest:
            a, b, c = share[i, lag - 1 : lag + 2]
            shift = float(np.clip(0.5 * (a - c) / (a - 2 * b + c), -0.5, 0.5)) if a - 2 * b + c > 0 else 0.0
        out[i] = rate / (lag + shift)
    return out, voiced


def prosody(clips: DataFrame, key: str, samples: str, rate: float = RATE, frame: int = FRAME, hop: int = HOP, low: float = LOWEST, high: float = HIGHEST) -> DataFrame:
    """(key, frame, time, pitch, rms, voiced, centroid, zcr): one row a frame of each clip, in seconds and Hz.

    Null and empty clips give no rows; samples that are null or not finite count as silence. Repeated rows each count.
    """
    ship(clips.sparkSession)
    kind, names = clips.schema[key].dataType.simpleString(), [key, "frame", "time", "pitch", "rms", "voiced", "centroid", "zcr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                held = b.column(1)[i]
                if not held.is_valid or not len(held.values):
                    continue
                x = np.nan_to_num(held.values.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0, posinf=0.0, neginf=0.0)
                pitch, voiced = pitches(x, rate, frame, hop, low, high)
                parts = [levels(x, frame, hop), centroids(x, rate, frame, hop), crossings(x, frame, hop)]
                n = min(len(pitch), *map(len, parts))
                made = [np.arange(n, dtype=np.int32), np.arange(n) * hop / rate, pitch[:n], parts[0][:n], voiced[:n], parts[1][:n], parts[2][:n]]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * n, b.column(0).type), *map(pa.array, made)], names)

    return clips.select(key, samples).mapInArrow(run, f"`{key}` {kind}, frame int, time double, pitch double, rms double, voiced boolean, centroid double, zcr double")


def for_spans(frames: DataFrame, spans: DataFrame, by: list[str], time: str, start: str, stop: str, values: list[str]) -> DataFrame:
    """spans with the values of the first frame at or after each span's middle, of the last frame where there is none; null where a key has no frames.

    One sort by key and time of both tables together: no interval join.
    """
    centre = spans.withColumn("_t", (F.col(start) + F.col(stop)) / 2)
    held = frames.select(*by, F.col(time).alias("_t"), F.struct(F.col(time).alias("t"), *values).alias("_v")).withColumn("_span", F.lit(0))
    last = frames.groupBy(*by).agg(F.max_by(F.struct(*values), time).alias("_last"))
    both = centre.withColumns({"_v": F.lit(None).cast(held.schema["_v"].dataType), "_span": F.lit(1)}).unionByName(held, allowMissingColumns=True)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_t"), F.asc("_span")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_w", F.last("_v", ignorenulls=True).over(ahead)).where("_span = 1").join(last, by, "left")
    return found.select(*spans.columns, *[F.coalesce(F.col(f"_w.{v}"), F.col(f"_last.{v}")).alias(v) for v in values])
