"""Comparison of paired sequences: edit distance, scan-path distance, point-set distance, differences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintspan.functions.geometry import distance
from glintspan.functions.measures import encode_labels, indel_ratio

from .islands import collapse_labels

Names = Sequence[str]


def paired(df: DataFrame, key: Names, side: str, values: Names, first: str = "enc", second: str = "ret") -> DataFrame:
    """One row per key: {v}_{first}, {v}_{second} and {v}_diff = second - first of each value."""
    aggs = [F.max(F.when(F.col(side) == s, F.col(v))).alias(f"{v}_{s}") for v in values for s in (first, second)]
    out = df.groupBy(*key).agg(*aggs)
    return out.withColumns({f"{v}_diff": F.col(f"{v}_{second}") - F.col(f"{v}_{first}") for v in values})


def label_strings(df: DataFrame, key: Names, order: Names, label: str, codes: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, labels): runs of a label as one character each, in order."""
    seq = collapse_labels(df, key, order, label).withColumn("_c", encode_labels(F.col(label), codes))
    return seq.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_c"))), lambda s: s["_c"]), "").alias("labels"))


def edit_distances(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """lev_dist and lev_ratio of two strings; lev_ratio is the indel similarity 2 LCS / (n + m)."""
    return pairs.withColumn("lev_dist", F.levenshtein(a, b).cast("long")).withColumn("lev_ratio", indel_ratio(F.col(a), F.col(b)))


def point_set_distance(a: DataFrame, b: DataFrame, key: Names, row: Names, axes: Names, name: str = "ea") -> DataFrame:
    """Double mapping: the sum of each point's distance to the nearest of the other side, both ways, over the larger number of points.

    Axes are scaled by the pooled mean and deviation of the key (an axis without deviation counts as 0). Points
    meet only those of their own key.
    """
    both = a.select(*key, *row, *axes, F.lit(0).alias("_side")).unionByName(b.select(*key, *row, *axes, F.lit(1).alias("_side")))
    w = Window.partitionBy(*key)
    both = both.select(*key, *row, "_side", *[F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)), F.lit(0.0)).alias(c) for c in axes])
    p, q = both.where("_side = 0").drop("_side"), both.where("_side = 1").drop("_side")
    q = q.select(*key, *[F.col(r).alias(f"_{r}") for r in row], *[F.col(c).alias(f"_{c}") for c in axes])
    cross = p.join(q, list(key)).withColumn("_d", distance([F.col(c) for c in axes], [F.col(f"_{c}") for c in axes]))
    left = cross.groupBy(*key, *row).agg(F.min("_d").alias("_d")).groupBy(*key).agg(F.sum("_d").alias("_s1"), F.count("*").alias("_n1"))
    right = cross.groupBy(*key, *[f"_{r}" for r in row]).agg(F.min("_d").alias("_d")).groupBy(*key).agg(F.sum("_d").alias("_s2"), F.count("*").alias("_n2"))
    return left.join(right, list(key)).select(*key, ((F.col("_s1") + F.col("_s2")) / F.greatest("_n1", "_n2")).alias(name))


def simplify(x: np.ndarray, y: np.ndarray, t: np.ndarray, length: float, angle: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A scan path without its small movements: short saccades that follow another short one, and bends below `angle`, are joined over short fixations."""
    x, y, t = list(x), list(y), list(t)
    while True:
        n = len(x)
        i = 0
        while i + 2 < len(x):
            a, b = np.array([x[i + 1] - x[i], y[i + 1] - y[i]]), np.array([x[i + 2] - x[i + 1], y[i + 2] - y[i + 1]])
            na, nb = np.hypot(*a), np.hypot(*b)
            bend = np.degrees(np.arccos(np.clip(a @ b / max(na * nb, 1e-12), -1, 1)))
            if t[i + 1] < least and (bend < angle or na < length and nb < length):
                t[i] += t[i + 1]
                del x[i + 1], y[i + 1], t[i + 1]
            else:
                i += 1
        if len(x) == n:
            return np.array(x), np.array(y), np.array(t)


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest path of vector pairs through the matrix of vector differences."""
    cost = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    total = np.full((len(a) + 1, len(b) + 1), np.inf)
    total[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            total[i, j] = cost[i - 1, j - 1] + min(total[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
    i, j, path = len(a), len(b), []
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: (total[p], p != (i - 1, j - 1)))
    return path[::-1]


def scan_path_similarity(p: tuple[np.ndarray, np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray, np.ndarray], screen: tuple[float, float], *, group_length: float = 0.0, group_angle: float = 0.0, group_duration: float = 0.0) -> dict[str, float] | None:
    """Vector, direction, length, position and duration similarity (0 to 1) of two scan paths of at least three fixations."""
    if len(p[0]) < 3 or len(q[0]) < 3:
        return None
    if group_length or group_angle:
        p, q = (simplify(*s, group_length, group_angle, group_duration) for s in (p, q))
        if len(p[0]) < 2 or len(q[0]) < 2:
            return None
    a, b = (np.column_stack([np.diff(s[0]), np.diff(s[1])]) for s in (p, q))
    path = align(a, b)
    i, j = np.array([x for x, _ in path]), np.array([x for _, x in path])
    diagonal = float(np.hypot(*screen))
    turn = np.abs((np.arctan2(a[i, 1], a[i, 0]) - np.arctan2(b[j, 1], b[j, 0]) + np.pi) % (2 * np.pi) - np.pi)
    size = lambda v: np.hypot(v[:, 0], v[:, 1])
    longest = np.maximum(np.maximum(p[2][i], q[2][j]), 1e-12)
    return {
        "vector": 1 - float(np.median(size(a[i] - b[j]))) / (2 * diagonal), "direction": 1 - float(np.median(turn)) / np.pi, "length": 1 - float(np.median(np.abs(size(a)[i] - size(b)[j]))) / diagonal,
        "position": 1 - float(np.median(np.hypot(p[0][i] - q[0][j], p[1][i] - q[1][j]))) / diagonal, "duration": 1 - float(np.median(np.abs(p[2][i] - q[2][j]) / longest)),
    }


def scan_paths(a: DataFrame, b: DataFrame, key: Names, order: Names, x: str, y: str, duration: str, screen: tuple[float, float]) -> DataFrame:
    """(key, vector, direction, length, position, duration) for the keys that both sides have; null for short paths."""
    kinds, keys = dict(a.dtypes), list(key)
    names = list(dict.fromkeys([*key, *order, x, y, duration]))
    a, b = a.select(*names), b.select(*[F.col(c).alias(c) for c in names])

    def run(_, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({c: [] for c in [*keys, "vector", "direction", "length", "position", "duration"]})
        sides = [tuple(s.sort_values(list(order), kind="stable")[c].to_numpy(np.float64) for c in (x, y, duration)) for s in (p, q)]
        found = scan_path_similarity(sides[0], sides[1], screen) or dict.fromkeys(["vector", "direction", "length", "position", "duration"])
        return pd.DataFrame([{**{k: p[k].iloc[0] for k in keys}, **found}])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} double" for c in ("vector", "direction", "length", "position", "duration"))])
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(run, schema)
