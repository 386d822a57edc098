"""Group statistics: effect sizes, lines, clusters over time, resampling, regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .islands import island_ids

Names = Sequence[str]
#: A draw below is the fraction of this product; every dialect of SQL has it. Fixed values.
DRAW_A, DRAW_B, DRAW_MOD = 7919, 104_729, 1_000_003


def draw(*numbers: Column) -> Column:
    """A number in [0, DRAW_MOD) from whole numbers, the same in any engine."""
    out = F.lit(0).cast("long")
    for n in numbers:
        out = F.pmod((out + n.cast("long")) * DRAW_A + DRAW_B, F.lit(DRAW_MOD))
    return out


def cohens_d(df: DataFrame, by: Names, side: Column, value: str) -> DataFrame:
    """(by, d): difference of the means where `side` is true and not, over the pooled deviation (ddof 1)."""
    a, b = F.when(side, F.col(value)), F.when(~side, F.col(value))
    pooled = F.sqrt(((F.count(a) - 1) * F.var_samp(a) + (F.count(b) - 1) * F.var_samp(b)) / F.nullif(F.count(a) + F.count(b) - 2, F.lit(0)))
    return df.groupBy(*by).agg(F.try_divide(F.avg(a) - F.avg(b), pooled).alias("d"))


def lines(df: DataFrame, by: Names, x: str, y: str) -> DataFrame:
    """(by, n, slope, intercept, r2) by least squares."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def t_by_time(df: DataFrame, time: str, side: Column, value: str) -> DataFrame:
    """(time, t): Student's t of the two sides at each time."""
    a, b = F.when(side, F.col(value)), F.when(~side, F.col(value))
    n, m = F.count(a), F.count(b)
    pooled = ((n - 1) * F.var_samp(a) + (m - 1) * F.var_samp(b)) / F.nullif(n + m - 2, F.lit(0))
    return df.groupBy(time).agg(F.try_divide(F.avg(a) - F.avg(b), F.sqrt(pooled * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m)))).alias("t"))


def t_clusters(ts: DataFrame, by: Names, time: str, threshold: float) -> DataFrame:
    """(by, cluster, start, end, n, mass): runs of times whose t is beyond the threshold on one side."""
    side = F.when(F.col("t") > threshold, 1).when(F.col("t") < -threshold, -1).otherwise(0)
    runs = island_ids(ts.withColumn("_side", side), by, [time], ["_side"], "_run").where("_side <> 0")
    out = runs.groupBy(*by, "_run").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), F.sum("t").alias("mass"))
    return out.withColumn("cluster", F.row_number().over(Window.partitionBy(*by).orderBy("start")).cast("long")).drop("_run")


def bootstrap_lines(members: DataFrame, group: Names, member: str, *, repeats: int, seed: int = 1) -> DataFrame:
    """(group, repeat, slope, intercept): means over as many members as the group has, drawn with replacement.

    Members are numbered in order within their group; slot s of a repeat draws a number by hash, so that reruns
    agree. Repeats and slots are exploded where the members lie and joined on group and number.
    """
    w = Window.partitionBy(*group).orderBy(member)
    numbered = members.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*group)))
    slots = numbered.select(*group, F.col("_i").alias("_slot"), "_n").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    slots = slots.withColumn("_i", (draw(F.lit(seed), F.col("repeat"), F.col("_slot")) % F.col("_n")).cast("int")).drop("_n", "_slot")
    return slots.join(numbered.drop("_n"), [*group, "_i"]).groupBy(*group, "repeat").agg(F.avg("slope").alias("slope"), F.avg("intercept").alias("intercept"))


def permute_groups(members: DataFrame, member: str, group: str, *, repeats: int, seed: int = 1, ranges: int = 1024) -> DataFrame:
    """(repeat, member, group): the group labels dealt anew, sizes kept: the k-th label goes to the k-th member by hash.

    A member's rank is the number of members in the ranges of the hash before its own, which are counted, and its
    rank within its range, so that no task sorts a whole repeat. The groups, a handful, are one row of bounds.
    """
    width = -(-DRAW_MOD // ranges)
    grid = members.select(member).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    grid = grid.withColumn("_d", draw(F.lit(seed), F.col("repeat"), F.col(member))).withColumn("_r", F.floor(F.col("_d") / width).cast("int"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy("repeat").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = grid.groupBy("repeat", "_r").agg(F.count("*").alias("_m")).select("repeat", "_r", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("repeat", "_r").orderBy("_d", member))
    ranked = grid.withColumn("_k", place).join(starts, ["repeat", "_r"]).withColumn("_k", F.col("_k") + F.col("_before"))
    sizes = members.groupBy(group).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col(group).isNotNull().alias("known"), F.col(group).alias("g"), "n"))).alias("_sizes"))
    ends = F.transform("_sizes", lambda x, i: F.struct(F.aggregate(F.slice("_sizes", 1, i + 1), F.lit(0).cast("long"), lambda t, y: t + y["n"]).alias("end"), x["g"].alias("g")))
    dealt = ranked.join(F.broadcast(sizes.select(ends.alias("_ends"))))  # one row
    return dealt.select("repeat", member, F.get(F.filter("_ends", lambda x: F.col("_k") <= x["end"]), F.lit(0))["g"].alias(group))


def critical_bounds(df: DataFrame, by: Names, value: str, alpha: float = 0.05) -> DataFrame:
    """(by, low, high): two-tailed bounds of a distribution of repeats."""
    return df.groupBy(*by).agg(F.percentile(value, alpha / 2).alias("low"), F.percentile(value, 1 - alpha / 2).alias("high"))


def auto_regression(df: DataFrame, key: Names, order: Names, value: str) -> DataFrame:
    """(key, rho): slope of a series on itself one step before."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_before", before).where("_before is not null").groupBy(*key).agg(F.regr_slope(value, "_before").alias("rho"))


def cochrane_orcutt(df: DataFrame, key: Names, order: Names, x: str, y: str, *, tolerance: float = 1e-4, rounds: int = 100) -> DataFrame:
    """(key, slope, rho): least squares through the origin with first-order errors, repeated until rho settles."""
    kinds, keys = dict(df.dtypes), list(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        a, b = pdf[x].to_numpy(np.float64), pdf[y].to_numpy(np.float64)
        rho, slope = 0.0, float("nan")
        for _ in range(rounds if len(a) > 2 else 0):
            u, v = a[1:] - rho * a[:-1], b[1:] - rho * b[:-1]
            slope = float(u @ v / (u @ u)) if u @ u else float("nan")
            e = b - slope * a
            new = float(e[1:] @ e[:-1] / (e[:-1] @ e[:-1])) if e[:-1] @ e[:-1] else 0.0
            done, rho = abs(new - rho) < tolerance, new
            if done:
                break
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "slope": slope, "rho": rho}])

    return df.groupBy(*key).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "slope double", "rho double"]))


def f_statistic(df: DataFrame, group: str, values: Names) -> DataFrame:
    """(feature, f): one-way analysis of variance of each value over the groups."""
    long = df.select(group, F.explode(F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[F.col(v).cast("double") for v in values]))).alias("feature", "v")).where("v is not null")
    per = long.groupBy("feature", group).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("s"))
    tot = per.groupBy("feature").agg(F.sum("n").alias("total"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("whole"))
    both = per.join(tot, "feature").groupBy("feature", "total", "k").agg(F.sum(F.col("n") * (F.col("m") - F.col("whole")) ** 2).alias("b"), F.sum((F.col("n") - 1) * F.col("s")).alias("w"))
    return both.select("feature", F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("total") - F.col("k"))).alias("f"))


def z_scores(df: DataFrame, values: Names, by: Names = ()) -> DataFrame:
    """Values as deviations from the mean in deviations (ddof 0); nulls become 0, which is the mean."""
    stats = df.groupBy(*by).agg(*[e for v in values for e in (F.avg(v).alias(f"_m_{v}"), F.stddev_pop(v).alias(f"_s_{v}"))])
    joined = df.join(stats, list(by)) if by else df.join(F.broadcast(stats))  # one row
    return joined.withColumns({v: F.coalesce(F.try_divide(F.col(v) - F.col(f"_m_{v}"), F.col(f"_s_{v}")), F.lit(0.0)) for v in values}).drop(*[f"_{s}_{v}" for v in values for s in "ms"])


def correlations(df: DataFrame, values: Names, by: Names = ()) -> DataFrame:
    """(by, a, b, r) of all pairs of columns a < b, in one pass."""
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    wide = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(*by, F.inline(rows))


def with_bands(df: DataFrame, by: Names, x: str, y: str, z: float = 1.96) -> DataFrame:
    """(by, x, fit, low, high): the least-squares line at each x and z standard errors of it each way."""
    s = df.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(x).alias("_mx"), F.var_pop(x).alias("_vx"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.regr_syy(y, x).alias("_syy"), F.regr_sxx(y, x).alias("_sxx"))
    joined = df.join(s, list(by))
    fit = F.col("_a") + F.col("_b") * F.col(x)
    noise = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_syy") - F.col("_b") ** 2 * F.col("_sxx"), F.col("_n") - 2)))
    se = noise * F.sqrt(F.try_divide(F.lit(1.0), F.col("_n")) + F.try_divide((F.col(x) - F.col("_mx")) ** 2, F.col("_sxx")))
    return joined.select(*by, x, fit.alias("fit"), (fit - z * se).alias("low"), (fit + z * se).alias("high")).distinct()


def pair_stats(df: DataFrame, group: str, values: Names) -> DataFrame:
    """(first, second, value, t, d): Student's t and Cohen's d (pooled deviation) of each value between every two groups, which are few: only their counts, means and variances meet."""
    each = df.groupBy(F.col(group).alias("g")).agg(*[F.struct(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s")).alias(v) for v in values])
    long = each.select("g", F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).alias("q")) for v in values])))
    a, b = long.alias("a"), long.alias("b")
    pairs = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.g") < F.col("b.g")))
    n, m = F.col("a.q.n"), F.col("b.q.n")
    pooled = ((n - 1) * F.col("a.q.s") + (m - 1) * F.col("b.q.s")) / F.nullif(n + m - 2, F.lit(0))
    apart = F.col("a.q.m") - F.col("b.q.m")
    return pairs.select(F.col("a.g").alias("first"), F.col("b.g").alias("second"), F.col("a.value").alias("value"), F.try_divide(apart, F.sqrt(pooled * (F.lit(1.0) / n + F.lit(1.0) / m))).alias("t"), F.try_divide(apart, F.sqrt(pooled)).alias("d"))


def hypothesis_draws(spark: SparkSession, means: dict[str, float], n: int, deviation: float, seed: int = 1) -> DataFrame:
    """(group, draw, value): n normal draws about each group's mean, for figures of what a hypothesis would look like. Reruns agree for the same partitioning."""
    groups = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(float(m)).alias("mean")) for g, m in means.items()])
    rows = spark.range(n, numPartitions=1).select(F.col("id").alias("draw"), F.randn(seed).alias("z"), F.explode(groups).alias("g"))
    return rows.select("g.group", "draw", (F.col("g.mean") + deviation * F.col("z")).alias("value"))


def sampled_pairs(df: DataFrame, key: str, n: int, sides: Names = ("enc", "ret"), seed: int = 1) -> DataFrame:
    """(key, side) of n keys, those of the least MD5 of seed and key: pairs of scan paths to compare."""
    least = df.select(key).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
    return least.select(key, F.explode(F.array(*map(F.lit, sides))).alias("side"))
