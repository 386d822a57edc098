"""Joins, set operations and reshapes with the semantics of sequence studies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def semi_chain(df: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows with a match through a chain of tables: (table, column before, column of the table), the outermost first.

    Each step keeps the table's other columns for the next one only inside the semi-joined side, so the rows
    of `df` never multiply.
    """
    if not steps:
        return df
    (table, left, right), *more = steps
    inner = semi_chain(table, *more)
    return df.join(inner.select(F.col(right).alias("_k")), df[left] == F.col("_k"), "left_semi")


def lookup(df: DataFrame, table: DataFrame, on: str, value: str, *, default: str = "NA", name: str | None = None) -> DataFrame:
    """The table's value for each row's key: `default` if it has none, an error if it has several."""
    unique = table.groupBy(F.col(on).alias("_on")).agg(F.first(F.col(value).cast("string")).alias("_v"), F.count("*").alias("_n"))
    checked = unique.select("_on", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several rows for key "), F.col("_on").cast("string")))).otherwise(F.col("_v")).alias("_v"))
    return df.join(checked, df[on] == F.col("_on"), "left").withColumn(name or value, F.coalesce("_v", F.lit(default))).drop("_on", "_v")


def missing_from(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other.select(F.col(right).alias("_k")), df[left] == F.col("_k"), "left_anti")


def keep_conditions(df: DataFrame, column: str, wanted: Names | str) -> DataFrame:
    """`all` keeps every row; else rows whose value is one of `wanted`."""
    return df if wanted == "all" else df.where(F.col(column).isin(*([wanted] if isinstance(wanted, str) else wanted)))


def outside_range(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows whose value isn't from low to high; null stays."""
    return df.where(~F.col(column).between(low, high) | F.col(column).isNull())


def one_hot(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    return df.withColumns({name: F.coalesce(test, F.lit(False)).cast("int") for name, test in parts.items()})


def wide(df: DataFrame, by: Names, across: str, values: Sequence[str], measure: Column, prefix: str = "") -> DataFrame:
    """One column for each of `values` of `across`; stated values, so that no extra pass looks for them."""
    out = df.groupBy(*by).pivot(across, list(values)).agg(measure)
    return out.select(*by, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def long(df: DataFrame, by: Names, values: Names, name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(c) for c in by], [F.col(c).cast("double").alias(c) for c in values], name, value)


def json_columns(df: DataFrame, column: str, names: Names) -> DataFrame:
    """A JSON list of numbers as columns; null for all if it is no list or too short."""
    parsed = F.from_json(F.col(column), "array<double>")
    good = F.size(parsed) >= len(names)
    return df.withColumns({n: F.when(good, F.get(parsed, F.lit(i))) for i, n in enumerate(names)})


def pick_by_index(columns: Names, index: Column) -> Column:
    return F.element_at(F.array(*[F.col(c) for c in columns]), index)


def top_k(df: DataFrame, by: Names, order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def every_kth(df: DataFrame, by: Names, order: Names, k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where((F.col("_n") - 1) % k == 0).drop("_n")


def pairs_of_groups(groups: DataFrame, name: str) -> DataFrame:
    """(a, b) for all a < b of a list of groups: a handful of names, not of rows."""
    g = groups.select(name).distinct()
    return g.select(F.col(name).alias("a")).join(g.select(F.col(name).alias("b")), F.col("a") < F.col("b"))


def stitch(first: DataFrame, second: DataFrame, offsets: Names) -> DataFrame:
    """The second session after the first, its columns `offsets` moved on by the first one's last values: scalar subqueries, no collect."""
    last = first.agg(*[F.max(c).alias(f"_{c}") for c in offsets])
    moved = second.join(F.broadcast(last)).withColumns({c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in offsets}).drop(*[f"_{c}" for c in offsets])
    return first.unionByName(moved)


def nearest_of_group(vectors: DataFrame, row: str, group: str, vector: str, *, part: int = 2048) -> DataFrame:
    """(row, nearest, distance): the nearest other vector of each vector's group, by distance rounded to 6 places; ties to the smaller row.

    Exact, so the work is the square of a group's size, but no pair is a row: groups are dealt out as pairs of parts of
    about `part` vectors, each compared in numpy, and give one row a vector. Vectors of other lengths, or without a component, are no one's
    neighbours.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(row).cast("long").alias("a"), F.col(group).alias("g"), v.alias("v")).where(F.col("g").isNotNull() & F.col("a").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    rows = rows.withColumn("dim", F.size("v"))
    sizes = rows.groupBy("g", "dim").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    dealt = rows.join(sizes, ["g", "dim"]).withColumn("own", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    both = dealt.select("*", others.alias("q")).select("g", "dim", F.col("own").alias("p"), "q", F.lit(True).alias("asks"), "a", "v")
    both = both.unionByName(dealt.select("*", others.alias("p")).select("g", "dim", "p", F.col("own").alias("q"), F.lit(False).alias("asks"), "a", "v"))

    def run(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False), table.column("a").to_numpy()
        v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        theirs = theirs[np.argsort(ids[theirs], kind="stable")]
        out = []
        for i in mine:
            gap = v[theirs] - v[i]
            d = np.where(ids[theirs] == ids[i], np.inf, np.round(np.sqrt(np.einsum("ij,ij->i", gap, gap)), 6))
            if len(d) and np.isfinite(d[at := int(d.argmin())]):
                out.append((ids[i], ids[theirs[at]], d[at]))
        a, b, d = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "d": pa.array(d, pa.float64())})

    found = both.groupBy("g", "dim", "p", "q").applyInArrow(run, "a long, b long, d double")
    return found.groupBy(F.col("a").alias(row)).agg(F.min(F.struct("d", "b")).alias("m")).select(row, F.col("m.b").alias("nearest"), F.col("m.d").alias("distance"))


def referenced(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key no parent has: the check of a foreign key."""
    return missing_from(df.where(F.col(key).isNotNull()), parent, key, parent_key)


def rollup_groups(df: DataFrame, by: Names, sums: Names = (), means: Names = (), medians: Names = (), at_least: int = 1) -> DataFrame:
    """Sums, means and medians over groups; null from fewer than `at_least` rows. NaN counts as null."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in {*sums, *means, *medians}}
    enough = lambda e: F.when(F.count("*") >= at_least, e)
    return df.withColumns(clean).groupBy(*by).agg(
        F.count("*").alias("n_rows"), *[enough(F.sum(c)).alias(f"{c}_sum") for c in sums], *[enough(F.avg(c)).alias(f"{c}_mean") for c in means], *[enough(F.median(c)).alias(f"{c}_median") for c in medians]
    )
