"""Further members of the catalogue: projections, ratios, whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintspan.functions import geometry as geo
from glintspan.functions import measures
from glintspan.operators import aoi, cleaning, islands, projection, segments, transitions
from glintspan.plans import pipeline
from glintspan.plans.registry import fixation_features, saccade_features

from .base import HOUR, KEY, LABELS, ORDER, E, R, episodes, query, samples, table

AXES = ["x", "y", "z"]


def _headed(df):
    return df.withColumns({"hx": F.lit(40.0), "hy": F.lit(60.0), "hz": F.lit(-200.0)})


@query(E + """, m AS (SELECT *, least(greatest(x, avg(x) OVER w - stddev_pop(x) OVER w), avg(x) OVER w + stddev_pop(x) OVER w) AS cx, least(greatest(y, avg(y) OVER w - stddev_pop(y) OVER w), avg(y) OVER w + stddev_pop(y) OVER w) AS cy, least(greatest(z, avg(z) OVER w - stddev_pop(z) OVER w), avg(z) OVER w + stddev_pop(z) OVER w) AS cz FROM e WINDOW w AS (PARTITION BY user_id)),
n AS (SELECT *, avg(cx) OVER w - 40.0 AS nx, avg(cy) OVER w - 60.0 AS ny, avg(cz) OVER w + 200.0 AS nz FROM m WINDOW w AS (PARTITION BY user_id)), k AS (SELECT *, ((x - 40.0) * nx + (y - 60.0) * ny + (z + 200.0) * nz) / nullif(nx * nx + ny * ny + nz * nz, 0) AS share FROM n)
SELECT event_id, round(x - share * nx, 5) AS px, round(y - share * ny, 5) AS py, round(z - share * nz, 5) AS pz FROM k""")
def q_head_projection(spark, d):
    out = projection.face_plane(_headed(samples(spark, d)), KEY, AXES, ["hx", "hy", "hz"])
    return out.select("event_id", *[F.round(f"p_{a}", 5).alias(f"p{a}") for a in AXES])


@query()
def q_projected_distance(spark, d):
    return projection.projected_distance(_headed(samples(spark, d)), KEY, AXES, ["hx", "hy", "hz"], (50.0, 50.0, 0.0), 200.0).withColumn("distance_median", F.round("distance_median", 6))


@query(E + " SELECT event_id, round(CASE WHEN sqrt(x * x + z * z) < 43 THEN 43 - sqrt(x * x + z * z) WHEN sqrt(x * x + z * z) > 55 THEN sqrt(x * x + z * z) - 55 ELSE 0.0 END, 6) AS border FROM e")
def q_border_distance(spark, d):
    return samples(spark, d).select("event_id", F.round(projection.border_distance(F.col("x"), F.col("z"), 43.0, 55.0), 6).alias("border"))


@query(E + " SELECT user_id, event_id FROM (SELECT *, min(t) OVER (PARTITION BY user_id) AS t0 FROM e) WHERE NOT (label = 'signup' AND t - t0 < 86400000) AND label <> 'error'")
def q_drop_unwanted(spark, d):
    return cleaning.drop_unwanted(samples(spark, d), KEY, "t", "label", early="signup", within=24 * HOUR, always=["error"]).select("user_id", "event_id")


@query(E + " SELECT user_id, event_id, CASE WHEN missing = 0 THEN x END AS x FROM e")
def q_null_missing(spark, d):
    return cleaning.null_missing(samples(spark, d), "missing", ["x"]).select("user_id", "event_id", "x")


@query(E + """, p AS (SELECT user_id, count(*) FILTER (WHERE label = 'click') / count(*)::DOUBLE AS a, count(*) FILTER (WHERE label = 'view') / count(*)::DOUBLE AS b FROM e GROUP BY 1)
SELECT user_id, round(CASE WHEN a > 0 AND b > 0 THEN ln(a / b) END, 6) AS log_ratio, round(a / nullif(1 - a, 0), 6) AS odds FROM p""")
def q_ratios(spark, d):
    p = samples(spark, d).groupBy("user_id").agg((F.count_if(F.col("label") == "click") / F.count("*")).alias("a"), (F.count_if(F.col("label") == "view") / F.count("*")).alias("b"))
    return p.select("user_id", F.round(measures.log_ratio(F.col("a"), F.col("b")), 6).alias("log_ratio"), F.round(measures.odds(F.col("a")), 6).alias("odds"))


@query(E + " SELECT event_id, round(sqrt(x * x + y * y + z * z), 6) AS r, round(atan2(y, x), 6) AS azimuth FROM e")
def q_spherical(spark, d):
    r, _, azimuth = geo.to_spherical(F.col("x"), F.col("y"), F.col("z"))
    return samples(spark, d).select("event_id", F.round(r, 6).alias("r"), F.round(azimuth, 6).alias("azimuth"))


@query(E + " SELECT event_id, CASE WHEN sqrt((x - 20) ** 2 + (y - 30) ** 2 + (z - 5) ** 2) <= 15 THEN 'A' WHEN sqrt((x - 60) ** 2 + (y - 60) ** 2 + (z - 30) ** 2) <= 25 THEN 'B' WHEN abs(x) <= 40 AND abs(z) <= 40 AND abs(y - 10) < 0.05 THEN 'Table' WHEN y > 50 THEN 'Dome' WHEN y < 5 THEN 'Floor' ELSE 'External' END AS area FROM e")
def q_relabel(spark, d):
    area = aoi.relabel(F.col("x"), F.col("y"), F.col("z"), [("A", 20.0, 30.0, 5.0, 15.0), ("B", 60.0, 60.0, 30.0, 25.0)], table_y=10.0, table_half=40.0, dome_y=50.0, floor_y=5.0)
    return samples(spark, d).select("event_id", area.alias("area"))


@query(E + " SELECT user_id, label, first(x ORDER BY t, event_id) AS x, first(y ORDER BY t, event_id) AS y FROM e GROUP BY ALL")
def q_first_position(spark, d):
    return islands.first_of_duplicates(samples(spark, d), ["user_id", "label"], ORDER).select("user_id", "label", "x", "y")


@query(R + ", v AS (SELECT user_id, label, count(*) AS visits, sum(duration)::BIGINT AS total, min(\"start\") AS first_visit FROM r GROUP BY ALL) SELECT * FROM v")
def q_visits(spark, d):
    merged = islands.merge_runs(episodes(spark, d), KEY, ORDER, "label", "t", "t_end")
    return merged.groupBy("user_id", "label").agg(F.count("*").alias("visits"), F.sum("duration").alias("total"), F.min("start").alias("first_visit"))


@query()
def q_viewing_pipeline(spark, d):
    """Samples to segments to viewing features, in one lazy plan."""
    e = segments.angular_speed(samples(spark, d).withColumn("hours", F.col("t") / HOUR), KEY, ORDER, "hours", AXES)
    flagged = segments.by_speed(e, KEY, ORDER, "t", "angular_speed", "label", most=60, least=0)
    found = segments.segment_table(flagged, KEY, ORDER, "t", "fixation", "label", AXES, missing="missing")
    out = pipeline.viewing_features(found, KEY, "label", fixation_features(LABELS))
    moves = saccade_features().evaluate(found.where("kind = 'saccade'"), KEY, {"label": "kind", "mean_speed": "mean_speed"})
    out = out.join(moves, KEY, "left")
    return out.withColumns({c: F.round(c, 6) for c, k in out.dtypes if k == "double"})


@query()
def q_trial_to_condition(spark, d):
    """Viewing features of both halves to trial features to medians by group of users."""
    e = samples(spark, d)
    shares = transitions.transition_shares(transitions.transition_counts(e, ["user_id", "side"], ORDER, "label"), ["user_id", "side"])
    views = e.groupBy("user_id", "side").agg(F.count("*").alias("n_fix"), F.avg("x").alias("x_mean")).join(transitions.joint_entropy(shares, ["user_id", "side"]), ["user_id", "side"])
    trials = pipeline.trial_features(views, KEY, "side", ["n_fix", "x_mean", "ht"]).withColumn("cond", F.col("user_id") % 6)
    out = pipeline.condition_medians(trials, ["cond"], ["n_fix_diff", "x_mean_diff", "ht_diff"])
    return out.withColumns({c: F.round(c, 6) for c, k in out.dtypes if k == "double"})


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM orders WHERE o_orderstatus IS NULL) AS n_null FROM orders")
def q_table_probe(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_orderstatus").isNull()).alias("n_null"))
