"""Fixation detectors. Thresholds on speed are window plans; hidden-state and clustering detectors are numpy kernels by key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintspan.functions.geometry import angle_degrees, minus

from .islands import drop_short_runs, island_ids, ordered

Names = Sequence[str]


def angular_speed(df: DataFrame, key: Names, order: Names, time: str, gaze: Names, head: Names | None = None, *, forward: bool = False, name: str = "angular_speed") -> DataFrame:
    """Degrees per unit of time between a sample's gaze direction and the one before (after, if `forward`)."""
    w, f = ordered(key, order), F.lead if forward else F.lag
    here = [F.col(c) for c in gaze] if head is None else minus([F.col(c) for c in gaze], [F.col(c) for c in head])
    df = df.withColumns({f"_d{i}": d for i, d in enumerate(here)})
    now, other = [F.col(f"_d{i}") for i in range(3)], [f(f"_d{i}").over(w) for i in range(3)]
    return df.withColumn(name, F.try_divide(angle_degrees(now, other), F.abs(f(time).over(w) - F.col(time)))).drop("_d0", "_d1", "_d2")


def by_speed(df: DataFrame, key: Names, order: Names, time: str, speed: str, label: str, *, most: float, least: float) -> DataFrame:
    """fixation (0 or 1): samples at most `most` fast (the first counts as slow), without runs of one label, and then runs, shorter than `least`."""
    df = df.withColumn("_slow", F.when(F.coalesce(F.col(speed), F.lit(0.0)) > most, 0).otherwise(1))
    df = island_ids(df, key, order, ["_slow", label], "_sub")
    sub = Window.partitionBy(*key, "_sub")
    df = df.withColumn("_lasts", F.max(time).over(sub) - F.min(time).over(sub)).withColumn("_slow", F.when(F.col("_lasts") >= least, F.col("_slow")).otherwise(0)).drop("_sub", "_lasts")
    return drop_short_runs(df, key, order, "_slow", time, least, "fixation").drop("_slow")


def by_speed_and_gap(df: DataFrame, key: Names, order: Names, time: str, speed: str, gaze: Names, *, most: float, least: float, gap: float, angle: float) -> DataFrame:
    """fixation: samples slower than `most` toward the next; fast runs shorter than `gap` between points closer than `angle` are bridged; runs of at least `least` stay."""
    w = ordered(key, order)
    df = df.withColumn("_slow", (F.coalesce(F.col(speed), F.lit(0.0)) < most).cast("int"))
    df = df.withColumns({f"_b{i}": F.lag(c).over(w) for i, c in enumerate(gaze)}).withColumn("_bt", F.lag(time).over(w))
    df = df.withColumns({f"_a{i}": F.lead(c).over(w) for i, c in enumerate(gaze)}).withColumn("_at", F.lead(time).over(w))
    df = island_ids(df, key, order, ["_slow"], "_run")
    first, last = F.struct(*order), F.struct(*order)
    spans = df.groupBy(*key, "_run").agg(*[F.min_by(f"_b{i}", first).alias(f"_p{i}") for i in range(3)], *[F.max_by(f"_a{i}", last).alias(f"_q{i}") for i in range(3)], F.min_by("_bt", first).alias("_from"), F.max_by("_at", last).alias("_to"))
    turn = angle_degrees([F.col(f"_p{i}") for i in range(3)], [F.col(f"_q{i}") for i in range(3)])
    spans = spans.withColumn("_bridge", F.coalesce((F.col("_to") - F.col("_from") < gap) & (turn < angle), F.lit(False))).select(*key, "_run", "_bridge")
    df = df.join(spans, [*key, "_run"]).withColumn("_slow", F.when(F.col("_bridge"), 1).otherwise(F.col("_slow")))
    df = df.drop("_run", "_bridge", "_bt", "_at", *[f"_{s}{i}" for s in "ab" for i in range(3)])
    return drop_short_runs(df, key, order, "_slow", time, least, "fixation").drop("_slow")


def segment_table(df: DataFrame, key: Names, order: Names, time: str, flag: str, label: str, axes: Names, *, missing: str | None = None) -> DataFrame:
    """One row per run of `flag`: kind, rows, start, end, duration, centroid, dispersion, speeds, and the label shares.

    A saccade is what lies between fixations and shares their border samples' times. Ties of the modal label go
    to the first in order.
    """
    df = island_ids(df, key, order, [flag], "segment")
    w = ordered(key, order)
    df = df.withColumn("_gap", F.col(time) - F.lag(time).over(w))
    moved = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.lag(axes[0]).over(w)) ** 2))
    df = df.withColumn("_speed", F.try_divide(moved, F.col("_gap"))).withColumns({"_before": F.lag(time).over(w), "_after": F.lead(time).over(w)})
    lost = F.sum(F.when(F.col(missing).cast("int") == 1, F.coalesce("_gap", F.lit(0))).otherwise(0)) if missing else F.lit(0)
    fix = F.col(flag) == 1
    per = df.groupBy(*key, "segment").agg(
        F.when(F.max(flag) == 1, "fixation").otherwise("saccade").alias("kind"), F.count("*").alias("rows"),
        F.min(F.when(fix, F.col(time)).otherwise(F.coalesce("_before", time))).alias("start"), F.max(F.when(fix, F.col(time)).otherwise(F.coalesce("_after", time))).alias("end"),
        *[F.avg(a).alias(f"centroid_{a}") for a in axes],
        F.when(F.count("*") > 1, F.sqrt(sum((F.var_samp(a) for a in axes[1:]), F.var_samp(axes[0])))).alias("dispersion"),
        F.avg("_speed").alias("mean_speed"), F.max("_speed").alias("max_speed"), lost.alias("invalid"),
    ).withColumn("duration", F.col("end") - F.col("start"))
    counts = df.groupBy(*key, "segment", F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    ranked = counts.groupBy(*key, "segment").agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_l").alias("l")))).alias("_s"), F.sum("_n").alias("_all"))
    share = lambda i: F.coalesce(-F.get("_s", F.lit(i))["n"], F.lit(0)) / F.col("_all")
    ranked = ranked.select(*key, "segment", F.get("_s", F.lit(0))["l"].alias("label"), share(0).alias("label_share"), F.get("_s", F.lit(1))["l"].alias("second_label"), share(1).alias("second_share"), (1 - share(0) - share(1)).alias("other_share"))
    return per.join(ranked, [*key, "segment"])


def _by_key(df: DataFrame, key: Names, order: Names, columns: dict[str, str], kernel) -> DataFrame:
    """`df` with new columns from a numpy kernel over each key's rows in order; one key is held in memory at a time."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        return pdf.assign(**kernel(pdf))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in df.columns), *(f"`{c}` {k}" for c, k in columns.items())])
    return df.groupBy(*key).applyInPandas(run, schema)


def viterbi(values: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Most likely states of a Gaussian hidden Markov chain."""
    emit = -0.5 * (np.log(2 * np.pi * var) + (values[:, None] - mean) ** 2 / var)
    best, back = np.log(start) + emit[0], np.zeros((len(values), len(start)), np.int64)
    for t in range(1, len(values)):
        ways = best[:, None] + np.log(move)
        back[t] = ways.argmax(0)
        best = ways.max(0) + emit[t]
    state = np.zeros(len(values), np.int64)
    state[-1] = best.argmax()
    for t in range(len(values) - 1, 0, -1):
        state[t - 1] = back[t, state[t]]
    return state


def by_hidden_states(df: DataFrame, key: Names, order: Names, speed: str, *, start=(0.5, 0.5), move=((0.95, 0.05), (0.05, 0.95)), mean=(10.0, 100.0), var=(100.0, 10_000.0)) -> DataFrame:
    """fixation: samples whose most likely state under a two-state speed model is the slow one; the last sample is none."""

    def kernel(pdf: pd.DataFrame) -> dict:
        v = pdf[speed].fillna(0.0).to_numpy(np.float64)
        if len(v) < 2:
            return {"fixation": np.zeros(len(v), np.int32)}
        s = viterbi(v[1:], np.array(start), np.array(move), np.array(mean), np.array(var))
        return {"fixation": np.append((s == int(np.argmin(mean))).astype(np.int32), 0)}

    return _by_key(df, key, order, {"fixation": "int"}, kernel)


def fit_hidden_states(values: np.ndarray, rounds: int = 25) -> dict[str, np.ndarray]:
    """Two-state Gaussian chain by expectation and maximisation; the start is the halves of the sorted values."""
    x = np.asarray(values, np.float64)
    low, high = np.array_split(np.sort(x), 2)
    mean, var = np.array([low.mean(), high.mean()]), np.array([low.var() + 1e-3, high.var() + 1e-3])
    start, move = np.full(2, 0.5), np.array([[0.9, 0.1], [0.1, 0.9]])
    for _ in range(rounds):
        e = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        a, b, c = np.zeros_like(e), np.ones_like(e), np.zeros(len(x))
        a[0] = start * e[0]
        c[0] = a[0].sum()
        a[0] /= c[0]
        for t in range(1, len(x)):
            a[t] = (a[t - 1] @ move) * e[t]
            c[t] = a[t].sum()
            a[t] /= c[t]
        for t in range(len(x) - 2, -1, -1):
            b[t] = (move @ (e[t + 1] * b[t + 1])) / c[t + 1]
        g = a * b
        g /= g.sum(1, keepdims=True)
        xi = a[:-1, :, None] * move[None] * (e[1:] * b[1:] / c[1:, None])[:, None, :]
        start, move = g[0], xi.sum(0) / xi.sum(0).sum(1, keepdims=True)
        mean = (g * x[:, None]).sum(0) / g.sum(0)
        var = (g * (x[:, None] - mean) ** 2).sum(0) / g.sum(0) + 1e-3
    return {"start": start, "move": move, "mean": mean, "var": var}


def by_dispersion(df: DataFrame, key: Names, order: Names, time: str, gaze: Names, head: Names, *, least: float = 75, most_angle: float = 1.0, most_gap: float = 1e18) -> DataFrame:
    """fixation by dispersion: windows of at least `least` in which no two gaze directions are farther apart than `most_angle` degrees, each grown as far as that holds."""

    def kernel(pdf: pd.DataFrame) -> dict:
        t = pdf[time].to_numpy(np.float64)
        d = pdf[list(gaze)].to_numpy(np.float64) - pdf[list(head)].to_numpy(np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = d / np.linalg.norm(d, axis=1, keepdims=True)
        n, i, out = len(t), 0, np.zeros(len(t), np.int32)
        limit = np.cos(np.radians(most_angle))

        def fits(a: int, b: int) -> bool:
            new = d[a:b] @ d[b]
            return bool(np.all(new >= limit)) and t[b] - t[b - 1] <= most_gap

        while i < n:
            j = i
            while j + 1 < n and fits(i, j + 1):
                j += 1
            if j > i and t[j] - t[i] >= least:
                out[i : j + 1] = 1
                i = j + 1
            else:
                i += 1
        return {"fixation": out}

    return _by_key(df, key, order, {"fixation": "int"}, kernel)


def k_means(x: np.ndarray, k: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from centres spread along the sorted first coordinate: no random start."""
    k = min(k, len(x))
    centre = x[np.argsort(x[:, 0], kind="stable")[np.linspace(0, len(x) - 1, k).astype(int)]].copy()
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = ((x[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for c in range(k):
            if (new == c).any():
                centre[c] = x[new == c].mean(0)
        if (new == label).all():
            break
        label = new
    return label, centre


def by_clusters(df: DataFrame, key: Names, order: Names, time: str, axes: Names, *, k: int = 10, least: float = 25) -> DataFrame:
    """fixation by clustering of speed, turn and acceleration: the cluster of the least mean centre, without short runs."""

    def kernel(pdf: pd.DataFrame) -> dict:
        n = len(pdf)
        if n < 4:
            return {"_cluster_fix": np.zeros(n, np.int32)}
        t, p = pdf[time].to_numpy(np.float64), pdf[list(axes)].to_numpy(np.float64)
        step, gap = np.diff(p, axis=0), np.maximum(np.diff(t), 1e-9)
        v = np.linalg.norm(step, axis=1) / gap
        with np.errstate(invalid="ignore", divide="ignore"):
            u = step / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-12)
        turn = np.degrees(np.arccos(np.clip((u[1:] * u[:-1]).sum(1), -1, 1)))
        x = np.column_stack([v, np.append(0, turn) / gap, np.abs(np.append(0, np.diff(v))) / gap])
        x = np.minimum(x, x.mean(0) + 3 * x.std(0))
        x = (x - x.min(0)) / np.maximum(x.max(0) - x.min(0), 1e-12)
        label, centre = k_means(x, k)
        return {"_cluster_fix": np.append((label == centre.sum(1).argmin()).astype(np.int32), 0)}

    found = _by_key(df, key, order, {"_cluster_fix": "int"}, kernel)
    return drop_short_runs(found, key, order, "_cluster_fix", time, least, "fixation").drop("_cluster_fix")


def agreement(df: DataFrame, by: Names, a: str, b: str) -> DataFrame:
    """(by, n, p_observed, p_expected, kappa) of two 0/1 flags."""
    from glintspan.functions.measures import kappa

    rate = lambda c: F.avg(F.col(c).cast("double"))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("p_observed"), (rate(a) * rate(b) + (1 - rate(a)) * (1 - rate(b))).alias("p_expected"))
    return out.withColumn("kappa", kappa(F.col("p_observed"), F.col("p_expected")))
