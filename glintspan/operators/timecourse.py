"""Time bins, sliding windows, grids of labels, and shares over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .islands import ordered

Names = Sequence[str]


def time_bins(df: DataFrame, key: Names, time: str, width: int, origin: int | None = 0, name: str = "bin") -> DataFrame:
    """`df` with the number of the bin of each row, from the origin or from each key's first time."""
    start = F.min(time).over(Window.partitionBy(*key)) if origin is None else F.lit(origin)
    return df.withColumn(name, F.floor((F.col(time) - start) / width).cast("long"))


def sliding_bins(df: DataFrame, time: str, size: int, step: int, name: str = "window_start") -> DataFrame:
    """Each row once for every window [start, start + size) that holds it; windows start at multiples of `step`."""
    last = F.floor(F.col(time) / step).cast("long")
    first = (F.floor((F.col(time) - size) / step) + 1).cast("long")
    return df.withColumn(name, F.explode(F.sequence(first, last))).withColumn(name, F.col(name) * step)


def label_grid(df: DataFrame, key: Names, order: Names, time: str, label: str, step: int, until: int | None = None) -> DataFrame:
    """(key, t, label) on a grid from each key's first time: a label holds until half way to the next sample."""
    w = ordered(key, order)
    half = F.ceil((F.col(time) + F.lead(time).over(w)) / 2)
    to = F.coalesce(half, F.col(time) + 1)
    start = F.coalesce(F.ceil((F.lag(time).over(w) + F.col(time)) / 2), F.col(time))
    t0 = F.min(time).over(Window.partitionBy(*key))
    spans = df.select(*key, F.col(label).alias("label"), (start - t0).alias("_a"), (to - 1 - t0).alias("_b"))
    first, last = F.ceil(F.col("_a") / step).cast("long"), F.floor(F.col("_b") / step).cast("long")
    if until is not None:
        last = F.least(last, F.lit(until // step - 1).cast("long"))
    on = spans.withColumns({"_f": first, "_l": last}).where("_f <= _l")
    return on.select(*key, F.explode(F.sequence("_f", "_l")).alias("_k"), "label").select(*key, (F.col("_k") * step).alias("t"), "label")


def label_shares(grid: DataFrame, group: Names, member: Names, name: str = "share") -> DataFrame:
    """(group, t, label, share): of the members that have a label at t, the share that has this one."""
    at = grid.groupBy(*group, "t").agg(F.count_distinct(*member).alias("_n"))
    per = grid.groupBy(*group, "t", "label").agg(F.count_distinct(*member).alias("_m"))
    return per.join(at, [*group, "t"]).withColumn(name, F.col("_m") / F.col("_n")).drop("_m", "_n")


def tokens(df: DataFrame, duration: str, width: float) -> DataFrame:
    """Each row once for every whole `width` of its duration, numbered from 0 in `token`."""
    return df.withColumn("token", F.explode(F.when(F.col(duration) >= width, F.sequence(F.lit(0), (F.floor(F.col(duration) / width) - 1).cast("int")))))


def mean_band(df: DataFrame, by: Names, value: str) -> DataFrame:
    """(by, n, mean, low, high): mean and one standard error (population deviation) each way."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("_se"))
    return out.withColumn("low", F.col("mean") - F.col("_se")).withColumn("high", F.col("mean") + F.col("_se")).drop("_se")
