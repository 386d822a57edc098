"""Areas of interest: hits, labels, greedy sub-areas, tilings, voxel maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintspan.functions.geometry import distance, hex_cell, radius_by_distance, ray_sphere

from .islands import ordered

Names = Sequence[str]


def nearest_hit(points: DataFrame, areas: DataFrame, key: Names, row: Names, start: Names, toward: Names, centre: Names = ("cx", "cy", "cz"), *, area: str = "area", reach: float = 2.0, radius: Column | None = None) -> DataFrame:
    """`points` with hit_area and hit_at: the first area that the line from `start` through `toward` meets within `reach` times its length.

    `areas` holds spheres by key, a handful each. Nearer hits win, ties go to the first name; no hit is null.
    """
    a, b, c = ([F.col(x) for x in cols] for cols in (start, toward, centre))
    size = radius if radius is not None else radius_by_distance(distance(a, c))
    at = points.select(*key, *row, *start, *toward).join(areas, list(key)).withColumn("_at", ray_sphere(a, b, c, size)).where(F.col("_at") <= reach)
    best = at.groupBy(*key, *row).agg(F.min(F.struct(F.col("_at").alias("at"), F.col(area).alias("area"))).alias("_h"))
    return points.join(best.select(*key, *row, F.col("_h.area").alias("hit_area"), F.col("_h.at").alias("hit_at")), [*key, *row], "left")


def relabel(x: Column, y: Column, z: Column, areas: Sequence[tuple[str, float, float, float, float]], *, table_y: float, table_half: float, dome_y: float = 1.0, floor_y: float = 0.01) -> Column:
    """First area (name, x, y, z, radius) that holds a point; else Table, Dome or Floor by its place."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, ax, ay, az, r in areas:
        out = out.when(distance([x, y, z], [F.lit(ax), F.lit(ay), F.lit(az)]) <= r, name)
    on_table = (F.abs(x) <= table_half) & (F.abs(z) <= table_half) & (F.abs(y - table_y) < 0.05)
    return out.when(on_table, "Table").when(y > dome_y, "Dome").when(y < floor_y, "Floor").otherwise("External")


def standard_labels(df: DataFrame, label: str, *, outside: Names, moved: str, invisible: str, ranks: DataFrame | None = None, key: Names = (), name: str = "standard") -> DataFrame:
    """Labels in one vocabulary: External, Table, Previous, Moved, and the others as Obj2.. by their rank (key, label, rank)."""
    c = F.col(label)
    known = F.when(c.isin(*outside), "External").when(c.contains("Table"), "Table").when(c == invisible, "Previous").when(c == moved, "Moved")
    if ranks is None:
        return df.withColumn(name, known.otherwise(c))
    joined = df.join(ranks.select(*key, label, F.col("rank").alias("_rank")), [*key, label], "left")
    return joined.withColumn(name, known.when(F.col("_rank").isNotNull(), F.concat(F.lit("Obj"), (F.col("_rank") + 1).cast("string"))).otherwise(c)).drop("_rank")


def distance_ranks(df: DataFrame, key: Names, label: str, axes: Names, origin: str) -> DataFrame:
    """(key, label, rank): other labels by the distance of their mean position from that of `origin`, from 1; ties by name."""
    means = df.groupBy(*key, label).agg(*[F.avg(a).alias(a) for a in axes])
    home = means.where(F.col(label) == origin).select(*key, *[F.col(a).alias(f"_{a}") for a in axes])
    far = means.where(F.col(label) != origin).join(home, list(key)).withColumn("_far", F.round(distance([F.col(a) for a in axes], [F.col(f"_{a}") for a in axes]), 9))
    return far.withColumn("rank", F.row_number().over(ordered(key, ["_far", label])).cast("long")).select(*key, label, "rank")


def leader_clusters(df: DataFrame, key: Names, order: Names, x: str, y: str, radius: float, prefix: str = "Table") -> DataFrame:
    """(key, order, sub_area): in order, each point joins the first leader within `radius`, or becomes one.

    A key's leaders alone are folded through its points, then each point takes the first of them all: one that came later
    is never first, as the point would have been its own leader before. Only one key's points are held together. A
    point without a place is in no sub-area.
    """
    w = ordered(key, order)
    rows = df.withColumn("_i", F.row_number().over(w)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *[F.col(o).alias(f"o_{o}") for o in order]))).alias("_p"))
    empty = F.expr("cast(array() as array<struct<x:double,y:double>>)")

    def reached(leader: Column, p: Column) -> Column:
        return F.hypot(leader["x"] - p["x"], leader["y"] - p["y"]) <= radius

    def fold(leaders: Column, p: Column) -> Column:
        known = p["x"].isNull() | p["y"].isNull() | F.exists(leaders, lambda q: reached(q, p))
        return F.when(known, leaders).otherwise(F.concat(leaders, F.array(F.struct(p["x"].alias("x"), p["y"].alias("y")))))

    def first(p: Column) -> Column:
        return F.get(F.filter(F.transform("_l", lambda q, i: F.when(reached(q, p), i + 1)), lambda v: v.isNotNull()), F.lit(0))

    folded = rows.withColumn("_l", F.aggregate("_p", empty, fold))
    points = F.transform("_p", lambda p: F.struct(*[p[f"o_{o}"].alias(o) for o in order], F.concat(F.lit(f"{prefix}_"), first(p).cast("string")).alias("sub_area")))
    return folded.select(*key, F.inline(points))


def hex_bins(df: DataFrame, key: Names, x: str, y: str, size: float) -> DataFrame:
    """(key, q, r, n): points by hexagon."""
    q, r = hex_cell(F.col(x), F.col(y), size)
    return df.groupBy(*key, q.alias("q"), r.alias("r")).agg(F.count("*").alias("n"))


def voxel_shares(df: DataFrame, group: Names, member: Names, axes: Names, size: float) -> DataFrame:
    """(group, voxel, p): mean over members of each one's share of points by voxel; members that have none there count as 0."""
    cells = [F.floor(F.col(a) / size).cast("long").alias(f"v{a}") for a in axes]
    own = df.groupBy(*group, *member, *cells).agg(F.count("*").alias("n"))
    own = own.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*group, *member)))
    many = df.groupBy(*group).agg(F.count_distinct(*member).alias("_m"))
    sums = own.groupBy(*group, *[f"v{a}" for a in axes]).agg(F.sum("p").alias("_p"))
    return sums.join(many, list(group)).withColumn("p", F.col("_p") / F.col("_m")).drop("_p", "_m")


def blur_voxels(voxels: DataFrame, group: Names, axes: Names, sigma: float, *, reach: int | None = None) -> DataFrame:
    """Voxel shares blurred by a Gaussian, one axis after the other, and scaled to sum to 1 again."""
    import math

    reach = math.ceil(3 * sigma) if reach is None else reach
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    kernel = F.array(*[F.struct(F.lit(d).cast("long").alias("d"), F.lit(w / sum(weights)).alias("w")) for d, w in zip(range(-reach, reach + 1), weights, strict=True)])
    out = voxels
    for a in axes:
        spread = out.withColumn("_k", F.explode(kernel)).withColumn(f"v{a}", F.col(f"v{a}") + F.col("_k.d")).withColumn("p", F.col("p") * F.col("_k.w"))
        out = spread.groupBy(*group, *[f"v{x}" for x in axes]).agg(F.sum("p").alias("p"))
    return out.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*group)))
