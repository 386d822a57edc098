"""Ordered sequences by key: shifts, runs, gaps, merges. One sort by key serves all windows of a plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def ordered(key: Names, order: Names):
    return Window.partitionBy(*key).orderBy(*order)


def shift(df: DataFrame, key: Names, order: Names, col: str, by: int = 1, fill=None, name: str | None = None) -> DataFrame:
    """`col` of the row `by` places earlier (later, if negative)."""
    w, f = ordered(key, order), F.lag if by >= 0 else F.lead
    return df.withColumn(name or f"{col}_shift", f(col, abs(by), fill).over(w))


def run_edges(df: DataFrame, key: Names, order: Names, flag: str) -> DataFrame:
    """run_start and run_end (0 or 1) of the runs of 1 in `flag`."""
    w = ordered(key, order)
    on = F.coalesce(F.col(flag), F.lit(0)) == 1
    return df.withColumn("run_start", (on & (F.coalesce(F.lag(flag).over(w), F.lit(0)) != 1)).cast("int")).withColumn("run_end", (on & (F.coalesce(F.lead(flag).over(w), F.lit(0)) != 1)).cast("int"))


def island_ids(df: DataFrame, key: Names, order: Names, by: Names, name: str = "island") -> DataFrame:
    """Number, from 1, of each run of rows that agree in `by` (null equals null)."""
    w = ordered(key, order)
    here, before = F.struct(*by), F.lag(F.struct(*by)).over(w)
    fresh = F.when(before.isNotNull() & here.eqNullSafe(before), 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_fresh")


def drop_short_runs(df: DataFrame, key: Names, order: Names, flag: str, time: str, least: float, out: str = "kept") -> DataFrame:
    """`flag` with 0 for runs of 1 that are shorter than `least`.

    A run lasts from the sample before its first one (its first one, at the start of a sequence) to its last.
    """
    w = ordered(key, order)
    df = island_ids(df.withColumn("_before", F.lag(time).over(w)), key, order, [flag], "_run")
    run = Window.partitionBy(*key, "_run")
    start = F.min_by(F.coalesce("_before", time), F.struct(*order)).over(run)
    lasts = F.max(time).over(run) - start
    return df.withColumn(out, F.when((F.col(flag) == 1) & (lasts >= least), 1).otherwise(0)).drop("_before", "_run")


def split_by_gap(df: DataFrame, key: Names, order: Names, time: str, gap: float, name: str = "segment") -> DataFrame:
    """Number, from 0, of the segments between steps longer than `gap`."""
    w = ordered(key, order)
    df = df.withColumn("_new", F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(0)))
    return df.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def split_by_missing(df: DataFrame, key: Names, order: Names, missing: str, name: str = "segment") -> DataFrame:
    """Rows that aren't missing, with the number, from 0, of their unbroken segment; segments of one instant go."""
    w = ordered(key, order)
    df = df.withColumn("_cut", F.sum(F.coalesce(F.col(missing).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.where(~F.coalesce(F.col(missing).cast("boolean"), F.lit(False)))
    part = Window.partitionBy(*key, "_cut")
    df = df.withColumn("_span", F.max(order[0]).over(part) - F.min(order[0]).over(part)).where("_span > 0")
    return df.withColumn(name, (F.dense_rank().over(ordered(key, ["_cut"])) - 1).cast("long")).drop("_cut", "_span")


def visit_number(df: DataFrame, key: Names, order: Names, label: str, name: str = "visit") -> DataFrame:
    """How many rows of the sequence so far have this row's label, itself included."""
    return df.withColumn(name, F.row_number().over(ordered([*key, label], order)).cast("long"))


def merge_runs(df: DataFrame, key: Names, order: Names, label: str, start: str, end: str, means: Names = ()) -> DataFrame:
    """One row per run of a label: n, start, end, duration (gaps included) and means weighted by duration.

    Weighted means fall back to plain ones where all durations are 0.
    """
    df = island_ids(df, key, order, [label], "run")
    w = F.col(end) - F.col(start)
    aggs = [F.count("*").alias("n"), F.min(start).alias("start"), F.max(end).alias("end")]
    for c in means:
        aggs.append(F.coalesce(F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))), F.avg(c)).alias(c))
    out = df.groupBy(*key, "run", label).agg(*aggs)
    return out.withColumn("duration", F.col("end") - F.col("start"))


def collapse_labels(df: DataFrame, key: Names, order: Names, label: str) -> DataFrame:
    """The first row of each run of a label."""
    before = F.lag(label).over(ordered(key, order))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(label))).drop("_before")


def first_pair_after(df: DataFrame, key: Names, order: Names, label: str, start: str, end: str, *, each: bool = False) -> DataFrame:
    """(start_at, end_at) by the first order column: the key's first row labelled `start` and the first later one labelled `end`.

    With `each`, such a pair for every `end`: its start is the first since the `end` before.
    """
    later = ordered(key, order).rowsBetween(1, Window.unboundedFollowing)
    pairs = df.withColumn("_end", F.min(F.when(F.col(label) == end, F.col(order[0]))).over(later)).where((F.col(label) == start) & F.col("_end").isNotNull())
    pairs = pairs.groupBy(*key, F.col("_end").alias("end_at")).agg(F.min(order[0]).alias("start_at"))
    if not each:
        pairs = pairs.groupBy(*key).agg(F.min(F.struct("start_at", "end_at")).alias("_p")).select(*key, "_p.start_at", "_p.end_at")
    return pairs.select(*key, "start_at", "end_at")


def intervals_join(points: DataFrame, spans: DataFrame, key: Names, at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Points with the spans of their key that hold them, start included and end not: an equality join on time buckets."""
    tiles = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))
    return points.withColumn("_bucket", F.floor(F.col(at) / bucket)).join(tiles, [*key, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def steps(df: DataFrame, key: Names, order: Names, time: str, axes: Names) -> DataFrame:
    """speed and acceleration of each sample against the one before; a step of no time has none."""
    w = ordered(key, order)
    gap = F.col(time) - F.lag(time).over(w)
    moved = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.lag(axes[0]).over(w)) ** 2))
    df = df.withColumn("speed", F.try_divide(moved, gap))
    return df.withColumn("acceleration", F.try_divide(F.col("speed") - F.lag("speed").over(w), gap))


def moving_average(df: DataFrame, key: Names, order: Names, col: str, width: int, name: str = "smooth") -> DataFrame:
    """Centred mean over `width` rows (odd); the rows near the ends keep their own value."""
    half = width // 2
    w = ordered(key, order).rowsBetween(-half, half)
    return df.withColumn(name, F.when(F.count("*").over(w) == 2 * half + 1, F.avg(col).over(w)).otherwise(F.col(col)))


def time_share(df: DataFrame, key: Names, order: Names, time: str, flag: Column, name: str = "share") -> DataFrame:
    """Share of a sequence's time at flagged samples; each sample stands for the time since the one before."""
    df = df.withColumn("_step", F.col(time) - F.lag(time).over(ordered(key, order)))
    return df.groupBy(*key).agg(F.try_divide(F.sum(F.when(flag, F.col("_step")).otherwise(0)), F.sum("_step")).alias(name))


def first_of_duplicates(df: DataFrame, by: Names, order: Names) -> DataFrame:
    """One row for each value of `by`: the first in a total order."""
    return df.withColumn("_n", F.row_number().over(ordered(by, order))).where("_n = 1").drop("_n")
