"""Digital filters of sampled channels, one key at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .islands import ordered

Names = Sequence[str]


def butterworth(rate: float, cutoff: float) -> tuple[float, float]:
    """b0 (= b1) and a1 of the first-order low-pass filter."""
    k = np.tan(np.pi * cutoff / rate)
    return k / (1 + k), (k - 1) / (k + 1)


def low_pass(x: np.ndarray, rate: float, cutoff: float) -> np.ndarray:
    """The causal filter from a zero state."""
    b, a = butterworth(rate, cutoff)
    out, last_x, last_y = np.empty(len(x)), 0.0, 0.0
    for i, v in enumerate(x):
        last_y = b * (v + last_x) - a * last_y
        last_x = v
        out[i] = last_y
    return out


def zero_lag(x: np.ndarray, rate: float, cutoff: float) -> np.ndarray:
    """Forward and backward over the signal with its edge values held for a second at both ends."""
    pad = int(rate)
    y = np.concatenate([np.full(pad, x[0]), x, np.full(pad, x[-1])])
    y = low_pass(low_pass(y, rate, cutoff)[::-1], rate, cutoff)[::-1]
    return y[pad : pad + len(x)]


def median_filter(x: np.ndarray, width: int) -> np.ndarray:
    """Running median of odd width, zeros beyond the edges."""
    y = np.pad(x, width // 2)
    return np.median(np.lib.stride_tricks.sliding_window_view(y, width), axis=1) if len(x) else x


def mean_filter(x: np.ndarray, width: int) -> np.ndarray:
    """Centred mean of odd width; the ends keep their values."""
    if len(x) < width:
        return x.copy()
    out, half, total = x.astype(float).copy(), width // 2, np.cumsum(np.append(0.0, x))
    out[half : len(x) - half] = (total[width:] - total[:-width]) / width
    return out


def wiener(x: np.ndarray, width: int = 5, noise: float = 2e-4) -> np.ndarray:
    """Local mean plus the share of the local variance that isn't noise."""
    y = np.lib.stride_tricks.sliding_window_view(np.pad(x, width // 2), width)
    mean, var = y.mean(1), y.var(1)
    return mean + np.maximum(var - noise, 0) / np.maximum(var, noise) * (x - mean)


def upsample(t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values on every whole unit of time from the first to the last, linear between samples."""
    grid = np.arange(t[0], t[-1] + 1)
    return grid, np.interp(grid, t, x)


def downsample(grid: np.ndarray, x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Values at the given times; times that repeat are an error."""
    if len(np.unique(t)) != len(t):
        raise ValueError("times repeat")
    return x[np.searchsorted(grid, t)]


def downsample_flags(grid: np.ndarray, flag: np.ndarray, t: np.ndarray) -> np.ndarray:
    """1 where more than half of the time since the sample before was 1, or its last unit was."""
    total, at = np.cumsum(np.append(0, flag)), np.searchsorted(grid, t)
    before = np.append(at[0] - 1, at[:-1])
    share = (total[at + 1] - total[before + 1]) / np.maximum(at - before, 1)
    return ((share > 0.5) | (flag[at] == 1)).astype(np.int32)


def filter_chain(x: np.ndarray, t: np.ndarray, *, cutoff: float, median: int, mean: int, rate: float = 1000.0) -> np.ndarray:
    """Upsample to one sample a unit, zero-lag low pass, median, mean, and back to the samples' times."""
    if len(x) < 2:
        return x.astype(float)
    grid, y = upsample(t, x)
    return downsample(grid, mean_filter(median_filter(zero_lag(y, rate, cutoff), median), mean), t)


def filter_channels(df: DataFrame, key: Names, order: Names, time: str, channels: dict[str, dict]) -> DataFrame:
    """`df` with the channels filtered; each has its cutoff, median and mean widths. Missing values are bridged first."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        t = pdf[time].to_numpy(np.float64)
        for c, spec in channels.items():
            x = pdf[c].to_numpy(np.float64)
            ok = np.isfinite(x)
            if ok.sum() > 1:
                pdf[c] = filter_chain(np.interp(t, t[ok], x[ok]), t, **spec)
        return pdf

    return df.groupBy(*key).applyInPandas(run, ", ".join(f"`{c}` {'double' if c in channels else kinds[c]}" for c in df.columns))


def impute_blinks(df: DataFrame, key: Names, order: Names, time: str, blink: str, gaze: Names, head: Names, label: str, *, most: float = 1000, near: float = 8, moved: float = 0.1, external: str = "External", bridged: bool = False) -> DataFrame:
    """imputed and missing flags of blinks. Imputed rows keep their raw gaze or, if `bridged`, are linear between their neighbours.

    A blink of at most `most` is imputed if the mean directions within `near` before and after it differ by less
    than `moved`, or if all of it has the one label `external`.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        t, b = pdf[time].to_numpy(np.float64), pdf[blink].fillna(0).to_numpy(int)
        g, h = pdf[list(gaze)].to_numpy(np.float64), pdf[list(head)].to_numpy(np.float64)
        d = g - h
        with np.errstate(invalid="ignore", divide="ignore"):
            d = d / np.linalg.norm(d, axis=1, keepdims=True)
        imputed = np.zeros(len(t), np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], b, [0]])))
        for i, j in zip(edges[::2], edges[1::2], strict=True):
            if t[j - 1] - t[i] > most:
                continue
            before, after = (t >= t[i] - near) & (t < t[i]) & (b == 0), (t > t[j - 1]) & (t <= t[j - 1] + near) & (b == 0)
            close = before.any() and after.any() and np.linalg.norm(d[before].mean(0) - d[after].mean(0)) < moved
            if close or set(pdf[label].iloc[i:j]) == {external}:
                imputed[i:j] = 1
        bridge = np.flatnonzero(b == 0)
        if bridged and len(bridge) > 1:
            for c in gaze:
                x = pdf[c].to_numpy(np.float64).copy()
                x[imputed == 1] = np.interp(t[imputed == 1], t[bridge], x[bridge])
                pdf[c] = x
        return pdf.assign(imputed=imputed, missing=(b == 1).astype(np.int32) - imputed)

    schema = ", ".join([*(f"`{c}` {'double' if c in gaze else kinds[c]}" for c in df.columns), "imputed int", "missing int"])
    return df.groupBy(*key).applyInPandas(run, schema)


def bridge_windows(t: np.ndarray, lost: np.ndarray, signals: Sequence[np.ndarray], pad: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """Signals with straight lines over the windows of lost samples, and the samples that are in such a window.

    Each run of lost samples, from the sample before it to the one after and `pad` units farther, is a window on the
    grid of whole units. A window that reaches into the next is one with it: the line bends in the middle of
    what they share, at the mean of the signal there. Flags go back to samples by majority.
    """
    grid = np.arange(t[0], t[-1] + 1)
    edges = np.diff(np.concatenate([[0], lost.astype(int), [0]]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    a = np.maximum(t[np.maximum(begin - 1, 0)] - t[0] - pad, 0).astype(int)
    b = np.minimum(t[np.minimum(end + 1, len(t) - 1)] - t[0] + pad, len(grid) - 1).astype(int)
    flag, out = np.zeros(len(grid), int), []
    for i, j in zip(a, b, strict=True):
        flag[i : j + 1] = 1
    for x in signals:
        y = np.interp(grid, t, x)
        raw, k = y.copy(), 0
        while k < len(a):
            knots = [(a[k], raw[a[k]])]
            while k + 1 < len(a) and a[k + 1] <= b[k]:
                shared = slice(a[k + 1], b[k] + 1)
                knots.append(((a[k + 1] + b[k]) / 2, raw[shared].mean()))
                k += 1
            knots.append((b[k], raw[b[k]]))
            lo, hi = int(knots[0][0]), int(knots[-1][0])
            if hi > lo:
                at, value = zip(*sorted(dict(knots).items()), strict=True)
                y[lo : hi + 1] = np.interp(np.arange(lo, hi + 1), at, value)
            k += 1
        out.append(downsample(grid, y, t))
    return out, downsample_flags(grid, flag, t)


def bridge_blinks(df: DataFrame, key: Names, order: Names, time: str, lost: str, channels: Names, *, pad: int = 1, name: str = "window") -> DataFrame:
    """`df` with the channels bridged over windows of lost samples, and `name`: 1 in such a window. Times of a key don't repeat."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        t, flag = pdf[time].to_numpy(np.float64), pdf[lost].fillna(0).to_numpy(int)
        values, window = bridge_windows(t, flag, [pdf[c].to_numpy(np.float64) for c in channels], pad)
        return pdf.assign(**dict(zip(channels, values, strict=True)), **{name: window})

    return df.groupBy(*key).applyInPandas(run, ", ".join([*(f"`{c}` {'double' if c in channels else kinds[c]}" for c in df.columns), f"`{name}` int"]))


def upsample_rows(df: DataFrame, key: Names, order: Names, time: str, channels: Names, step: int = 1) -> DataFrame:
    """(key, time, channels) on a regular grid between samples, linear; each interval is exploded where it lies."""
    w = ordered(key, order)
    df = df.select(*key, *order, time, *channels) if time not in order else df.select(*key, *order, *channels)
    nxt = df.withColumns({"_t1": F.lead(time).over(w), **{f"_n_{c}": F.lead(c).over(w) for c in channels}})
    last = F.coalesce(F.col("_t1") - 1, F.col(time))
    grid = F.sequence(F.ceil(F.col(time) / step) * step, F.floor(last / step) * step, F.lit(step))
    on = nxt.withColumn("_g", F.explode(F.when(F.ceil(F.col(time) / step) * step <= F.floor(last / step) * step, grid)))
    share = F.coalesce(F.try_divide(F.col("_g") - F.col(time), F.col("_t1") - F.col(time)), F.lit(0.0))
    return on.select(*key, F.col("_g").alias(time), *[(F.col(c) + share * (F.coalesce(f"_n_{c}", c) - F.col(c))).alias(c) for c in channels])
