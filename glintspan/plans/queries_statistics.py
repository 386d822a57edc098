"""Group statistics, resampling, learning helpers and the streaming plans run as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintspan.operators import statistics as st
from glintspan.operators import timecourse
from glintspan.streaming import sessions

from .base import HOUR, KEY, ORDER, E, query, samples, table

G = E + ", d AS (SELECT user_id, user_id % 3 AS grp, CAST(floor((t - 1704067200000) / 86400000.0) AS BIGINT) AS day, x FROM e)"


def _daily(spark, d):
    e = samples(spark, d).withColumn("t", F.col("t") - 1_704_067_200_000)
    return timecourse.time_bins(e, KEY, "t", 24 * HOUR, 0, "day").select("user_id", (F.col("user_id") % 3).alias("grp"), "day", "x")


@query(E + """, a AS (SELECT label, count(*) FILTER (WHERE side = 'enc') AS n, count(*) FILTER (WHERE side = 'ret') AS m, avg(x) FILTER (WHERE side = 'enc') AS ma, avg(x) FILTER (WHERE side = 'ret') AS mb, var_samp(x) FILTER (WHERE side = 'enc') AS va, var_samp(x) FILTER (WHERE side = 'ret') AS vb FROM e GROUP BY 1)
SELECT label, round((ma - mb) / sqrt(((n - 1) * va + (m - 1) * vb) / (n + m - 2)), 6) AS d FROM a""")
def q_cohens_d(spark, d):
    return st.cohens_d(samples(spark, d), ["label"], F.col("side") == "enc", "x").withColumn("d", F.round("d", 6))


@query(G + " SELECT user_id, count(*) AS n, round(regr_slope(x, day), 6) AS slope, round(regr_intercept(x, day), 6) AS intercept, round(regr_r2(x, day), 6) AS r2 FROM d GROUP BY 1")
def q_ols_lines(spark, d):
    out = st.lines(_daily(spark, d), ["user_id"], "day", "x")
    return out.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


TT = G + """, a AS (SELECT day, count(*) FILTER (WHERE grp = 0) AS n, count(*) FILTER (WHERE grp = 1) AS m, avg(x) FILTER (WHERE grp = 0) AS ma, avg(x) FILTER (WHERE grp = 1) AS mb, var_samp(x) FILTER (WHERE grp = 0) AS va, var_samp(x) FILTER (WHERE grp = 1) AS vb FROM d WHERE grp < 2 GROUP BY 1),
tt AS (SELECT day, (ma - mb) / sqrt(((n - 1) * va + (m - 1) * vb) / (n + m - 2) * (1.0 / n + 1.0 / m)) AS t FROM a)"""


@query(TT + " SELECT day, round(t, 6) AS t FROM tt")
def q_t_by_time(spark, d):
    return st.t_by_time(_daily(spark, d).where("grp < 2"), "day", F.col("grp") == 0, "x").withColumn("t", F.round("t", 6))


@query(TT + """, s AS (SELECT day, t, CASE WHEN t > 0.5 THEN 1 WHEN t < -0.5 THEN -1 ELSE 0 END AS side FROM tt), f AS (SELECT *, CASE WHEN lag(side) OVER (ORDER BY day) = side THEN 0 ELSE 1 END AS fresh FROM s), r AS (SELECT *, sum(fresh) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT row_number() OVER (ORDER BY "start") AS cluster, "start", "end", n, round(mass, 6) AS mass FROM (SELECT run, min(day) AS "start", max(day) AS "end", count(*) AS n, sum(t) AS mass FROM r WHERE side <> 0 GROUP BY run)""")
def q_t_clusters(spark, d):
    ts = st.t_by_time(_daily(spark, d).where("grp < 2"), "day", F.col("grp") == 0, "x").withColumn("pair", F.lit("0-1"))
    return st.t_clusters(ts, ["pair"], "day", 0.5).select("cluster", "start", "end", "n", F.round("mass", 6).alias("mass"))


def _draw_sql(*numbers: str) -> str:
    out = "0"
    for n in numbers:
        out = f"((({out} + {n}) * {st.DRAW_A} + {st.DRAW_B}) % {st.DRAW_MOD})"
    return out


LINES = G + ", l AS (SELECT user_id, any_value(grp) AS grp, regr_slope(x, day) AS slope, regr_intercept(x, day) AS intercept FROM d GROUP BY 1)"


def _members(spark, d):
    return st.lines(_daily(spark, d), ["user_id", "grp"], "day", "x")


@query(LINES + f""", m AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY user_id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM l), s AS (SELECT grp, i AS slot, n, unnest(range(20)) AS rep FROM m), p AS (SELECT grp, rep, {_draw_sql('1', 'rep', 'slot')} % n AS i FROM s)
SELECT p.grp, CAST(p.rep AS INTEGER) AS "repeat", round(avg(m.slope), 6) AS slope, round(avg(m.intercept), 6) AS intercept FROM p JOIN m ON m.grp = p.grp AND m.i = p.i GROUP BY ALL""")
def q_bootstrap_lines(spark, d):
    out = st.bootstrap_lines(_members(spark, d), ["grp"], "user_id", repeats=20)
    return out.select("grp", "repeat", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(LINES + f""", g AS (SELECT user_id, grp, slope, unnest(range(20)) AS rep FROM l), a AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY {_draw_sql('1', 'rep', 'user_id')}, user_id) AS k FROM g), b AS (SELECT rep, grp, row_number() OVER (PARTITION BY rep ORDER BY grp, user_id) AS k FROM g)
SELECT CAST(a.rep AS INTEGER) AS "repeat", b.grp, count(*) AS n, round(avg(a.slope), 6) AS slope FROM a JOIN b ON a.rep = b.rep AND a.k = b.k GROUP BY ALL""")
def q_permutation(spark, d):
    m = _members(spark, d)
    dealt = st.permute_groups(m, "user_id", "grp", repeats=20)
    return dealt.join(m.select("user_id", "slope"), "user_id").groupBy("repeat", "grp").agg(F.count("*").alias("n"), F.round(F.avg("slope"), 6).alias("slope"))


@query(LINES + " SELECT grp, round(quantile_cont(slope, 0.025), 6) AS low, round(quantile_cont(slope, 0.975), 6) AS high FROM l GROUP BY 1")
def q_critical_bounds(spark, d):
    return st.critical_bounds(_members(spark, d), ["grp"], "slope").select("grp", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(E + " SELECT user_id, round(regr_slope(x, px), 6) AS rho FROM (SELECT user_id, x, lag(x) OVER (PARTITION BY user_id ORDER BY t, event_id) AS px FROM e) WHERE px IS NOT NULL GROUP BY 1")
def q_auto_regression(spark, d):
    return st.auto_regression(samples(spark, d), KEY, ORDER, "x").withColumn("rho", F.round("rho", 6))


@query()
def q_cochrane_orcutt(spark, d):
    return st.cochrane_orcutt(_daily(spark, d).groupBy("user_id", "day").agg(F.avg("x").alias("x")).withColumn("day1", F.col("day") + 1.0), ["user_id"], ["day"], "day1", "x").select("user_id", F.round("slope", 6).alias("slope"), F.round("rho", 6).alias("rho"))


@query("""WITH v AS (SELECT l_returnflag AS g, 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem), p AS (SELECT feature, g, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM v GROUP BY ALL),
t AS (SELECT feature, sum(n) AS tn, count(*) AS k, sum(n * m) / sum(n) AS mm FROM p GROUP BY 1) SELECT feature, round((sum(n * (m - mm) ** 2) / (max(k) - 1)) / (sum((n - 1) * s) / (max(tn) - max(k))), 6) AS f FROM p JOIN t USING (feature) GROUP BY 1""")
def q_anova_f(spark, d):
    return st.f_statistic(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"]).withColumn("f", F.round("f", 6))


@query(G + """, q AS (SELECT grp, day, avg(x) AS x FROM d GROUP BY ALL), s AS (SELECT grp, count(*) AS n, avg(day) AS mx, regr_slope(x, day) AS b, regr_intercept(x, day) AS a, regr_syy(x, day) AS syy, regr_sxx(x, day) AS sxx FROM q GROUP BY 1)
SELECT grp, day, round(a + b * day, 5) AS fit, round(a + b * day - 1.96 * sqrt(greatest(0.0, (syy - b * b * sxx) / (n - 2))) * sqrt(1.0 / n + (day - mx) ** 2 / sxx), 5) AS low FROM q JOIN s USING (grp)""")
def q_prediction_bands(spark, d):
    daily = _daily(spark, d).groupBy("grp", "day").agg(F.avg("x").alias("x"))
    return st.with_bands(daily, ["grp"], "day", "x").select("grp", "day", F.round("fit", 5).alias("fit"), F.round("low", 5).alias("low"))


@query(G + """, q AS (SELECT grp, user_id, day, count(*) AS n FROM d GROUP BY ALL) SELECT grp, day, count(n) AS n, round(avg(n), 6) AS mean, round(avg(n) - stddev_pop(n) / sqrt(count(n)), 6) AS low, round(avg(n) + stddev_pop(n) / sqrt(count(n)), 6) AS high FROM q GROUP BY ALL""")
def q_mean_band(spark, d):
    per = _daily(spark, d).groupBy("grp", "user_id", "day").agg(F.count("*").alias("v"))
    return timecourse.mean_band(per, ["grp", "day"], "v").select("grp", "day", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS cut FROM events), b AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM b GROUP BY user_id, s""")
def q_session_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions.session_counts(e, "user_id", "ts", "12 hours").select("user_id", F.floor(F.unix_micros("session_start") / 1000).cast("long").alias("start_ms"), "n")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000 AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_window_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions.label_counts(e, "ts", "event_type", "1 day").select(F.floor(F.unix_micros("window_start") / 1000).cast("long").alias("start_ms"), "event_type", "n")


@query()
def q_logistic_l1(spark, d):
    """Coefficients of an L1 logistic model of half against value and k, on standardised features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    e = samples(spark, d).select("event_id", "user_id", (F.col("label") == "purchase").cast("double").alias("y"), "x", F.col("y").alias("k"))
    v = VectorAssembler(inputCols=["x", "k"], outputCol="raw").transform(e)
    v = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    model = LogisticRegression(labelCol="y", regParam=0.001, elasticNetParam=1.0, maxIter=50).fit(v)
    return model.transform(v).select("event_id", F.round(vector_to_array("probability")[1], 4).alias("p"))


@query()
def q_kmeans_silhouette(spark, d):
    """k from 2 to 4 by silhouette over mean points of users: (k, silhouette)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    means = samples(spark, d).groupBy("user_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    v = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(means).cache()
    try:
        rows = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=0, maxIter=20).fit(v).transform(v)))) for k in (2, 3, 4)]
    finally:
        v.unpersist()
    return spark.createDataFrame(rows, "k int, silhouette double").withColumn("silhouette", F.round("silhouette", 4))
