"""Projection of gaze points to the plane that a viewer faces, and distances on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintspan.functions.geometry import distance, minus, norm, project_to_plane

Names = Sequence[str]


def face_plane(df: DataFrame, key: Names, gaze: Names, head: Names, prefix: str = "p_") -> DataFrame:
    """`df` with the gaze points' feet on the plane through the mean head point, at right angles to the mean gaze.

    The mean gaze is that of points clipped to one deviation (population) about the mean, axis by axis. Means
    are windows over the key: no join back. A key whose mean gaze is its head has no plane: null.
    """
    w = Window.partitionBy(*key)
    low, high = ({g: F.avg(g).over(w) + s * F.stddev_pop(g).over(w) for g in gaze} for s in (-1, 1))
    df = df.withColumns({f"_c_{g}": F.least(F.greatest(F.col(g), low[g]), high[g]) for g in gaze} | {f"_h_{h}": F.avg(h).over(w) for h in head})
    df = df.withColumns({f"_n_{g}": F.avg(f"_c_{g}").over(w) - F.col(f"_h_{h}") for g, h in zip(gaze, head, strict=True)})
    normal, origin = [F.col(f"_n_{g}") for g in gaze], [F.col(f"_h_{h}") for h in head]
    feet = project_to_plane([F.col(g) for g in gaze], origin, normal)
    extra = [*(f"_c_{g}" for g in gaze), *(f"_n_{g}" for g in gaze), *(f"_h_{h}" for h in head)]
    return df.withColumns({f"{prefix}{g}": f for g, f in zip(gaze, feet, strict=True)}).drop(*extra)


def projected_distance(df: DataFrame, key: Names, gaze: Names, head: Names, point: Sequence[float], most: float, name: str = "distance_median") -> DataFrame:
    """(key, median): median distance, up to `most`, between gaze and a point when both are seen on the facing plane."""
    df = df.withColumns({f"_q{i}": F.lit(float(x)) for i, x in enumerate(point)})
    seen = face_plane(df, key, gaze, head)
    w = Window.partitionBy(*key)
    normal = minus([F.avg(g).over(w) for g in gaze], [F.avg(h).over(w) for h in head])
    seen = seen.withColumns({f"_m{i}": n for i, n in enumerate(normal)} | {f"_o{i}": F.avg(h).over(w) for i, h in enumerate(head)})
    target = project_to_plane([F.col(f"_q{i}") for i in range(3)], [F.col(f"_o{i}") for i in range(3)], [F.col(f"_m{i}") for i in range(3)])
    seen = seen.withColumn("_far", distance([F.col(f"p_{g}") for g in gaze], target))
    return seen.groupBy(*key).agg(F.median(F.when(F.col("_far") <= most, F.col("_far"))).alias(name))


def border_distance(x, z, inner: float, outer: float):
    """Distance of a ground point to an annulus about the origin: 0 inside it."""
    r = norm([x, z])
    return F.when(r < inner, inner - r).when(r > outer, r - outer).otherwise(0.0)
