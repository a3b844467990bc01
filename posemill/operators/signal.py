"""Periodic limb movement: the gated FFT cadence of a window, and a coarse spectrum in plain SQL."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the current feature set: the band in Hz, the share of power in its peak, and the noise floor.
BAND = (0.3, 3.0)
GATE = 0.35
FLOOR = 1e-9


def filled_forward(values: np.ndarray, limit: int) -> np.ndarray:
    """Gaps on the line between their neighbours, the first limit values of each; the last value is held that long."""
    known = np.flatnonzero(~np.isnan(values))
    if not len(known):
        return values
    out = values.copy()
    line = np.interp(np.arange(len(values)), known, values[known])
    before = np.searchsorted(known, np.arange(len(values)), "right") - 1
    since = np.arange(len(values)) - np.where(before >= 0, known[before], len(values))
    take = np.isnan(values) & (before >= 0) & (since <= limit)
    out[take] = line[take]
    return out


def cadence_per_minute(values: np.ndarray, fps: float, seconds: float = 8.0) -> float | None:
    """Cycles a minute of a signal with NaN for missing frames; 0 if it is flat or has no dominant frequency in the
    band; None if too few frames are there."""
    if len(values) < int(0.6 * seconds * fps):
        return None
    filled = filled_forward(np.asarray(values, float), int(fps))
    x = filled[~np.isnan(filled)]
    if len(x) < 0.6 * len(filled) or len(x) < 8:
        return None
    width = max(3, int(fps * 0.12) | 1)
    x = np.convolve(x, np.full(width, 1.0 / width), "same")
    at = np.arange(len(x))
    x = x - np.polyval(np.polyfit(at, x, 1), at)
    if np.percentile(x, 90) - np.percentile(x, 10) < FLOOR:
        return 0.0
    x = x * np.hanning(len(x))
    power = np.abs(np.fft.rfft(x)) ** 2
    hertz = np.fft.rfftfreq(len(x), 1.0 / fps)
    inside = (hertz >= BAND[0]) & (hertz <= BAND[1])
    if not inside.any() or power[inside].max() / (power[1:].sum() + FLOOR) < GATE:
        return 0.0
    n = 1 << math.ceil(math.log2(8 * len(x)))
    fine = np.abs(np.fft.rfft(x, n)) ** 2
    hertz = np.fft.rfftfreq(n, 1.0 / fps)
    inside = (hertz >= BAND[0]) & (hertz <= BAND[1])
    return float(hertz[inside][np.argmax(fine[inside])] * 60)


def cadence(df: DataFrame, keys: list[str], time: str, values: list[str], fps: float | str, seconds: float = 8.0) -> DataFrame:
    """keys and <value>_freq for every group of frames (a centred window). fps: frames a second, or a column that holds
    them, alike in a group. Filters go before this call: none crosses it. A group is a window's frames, so it is bounded
    by seconds times fps."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{v}_freq` double" for v in values])
    names = [*keys, *[f"{v}_freq" for v in values]]
    rate = F.col(fps) if isinstance(fps, str) else F.lit(float(fps))
    # A window is one row of arrays, so that Python gets many windows at once.
    frames = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])))
    rows = df.groupBy(*keys).agg(frames.alias("_f"), F.first(rate.cast("double")).alias("_fps")).select(*keys, "_fps", *[F.col(f"_f.v{i}").alias(f"_v{i}") for i in range(len(values))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates, told = batch.column("_fps").to_pylist(), []
            for i in range(len(values)):
                own = batch.column(f"_v{i}")
                told.append(pa.array([cadence_per_minute(x.values.to_numpy(zero_copy_only=False), r, seconds) if r is not None else None for x, r in zip(own, rates)], pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *told], names)

    return rows.mapInArrow(run, schema)


def dft_power(df: DataFrame, keys: list[str], position: str, value: str, size: int, bins: int) -> DataFrame:
    """keys, bin, power: |sum of value * e^(-2 pi i bin position / size)| ** 2 for bins 1 to `bins`, as sums by group."""
    angle = F.lit(2 * math.pi / size) * F.col(position)
    sums = [x for k in range(1, bins + 1) for x in (F.sum(F.col(value) * F.cos(angle * k)).alias(f"c{k}"), F.sum(F.col(value) * F.sin(angle * k)).alias(f"s{k}"))]
    rows = F.array(*[F.struct(F.lit(k).alias("bin"), (F.col(f"c{k}") ** 2 + F.col(f"s{k}") ** 2).alias("power")) for k in range(1, bins + 1)])
    return df.groupBy(*keys).agg(*sums).select(*keys, F.inline(rows))
