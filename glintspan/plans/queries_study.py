"""A study's fetches, trial rules, group statistics and whole preparation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glintspan.operators import aoi, cleaning, islands, segments, statistics, transitions
from glintspan.plans import pipeline
from glintspan.plans.registry import pupil_features, saccade_features
from glintspan.sources import fetch, ingest

from .base import HOUR, KEY, LABELS, ORDER, E, R, episodes, query, samples, table
from .oracles import _segments

W = "OVER (PARTITION BY user_id ORDER BY t, event_id)"
EPOCH = "CASE WHEN event_type = 'view' THEN 'view' WHEN event_type = 'click' THEN 'na' ELSE 'full' END"


@query(f"SELECT event_id, user_id FROM (SELECT *, {EPOCH} AS epoch FROM events) WHERE epoch IN ('na', 'view') AND user_id % 25 BETWEEN 0 AND 17 AND user_id % 5 BETWEEN 1 AND 3 AND 'u_' || user_id IN ('u_1', 'u_2', 'u_3', 'u_26', 'u_27')")
def q_fetch_defaults(spark, d):
    ids = fetch.study_ids([1, "u_2", 3, 26, "27"], "u")

    def read(name):
        e = table(spark, d, "events").withColumns({"epoch": F.expr(EPOCH), "ppt_id": F.concat(F.lit("u_"), "user_id"), "trial": F.col("user_id") % 25, "block": F.col("user_id") % 5, "practice": F.lit(None).cast("boolean"), "extra_notable": F.lit(0)})
        return fetch.drop_like(e, "notable")

    return fetch.level("timepoint", read, ids=ids, epoch="epoch", trial="trial", block="block", practice="practice").select("event_id", "user_id")


@query("""SELECT c_custkey, CASE c_nationkey % 7 WHEN 0 THEN 'Younger' WHEN 1 THEN 'Older' WHEN 2 THEN 'MCI+' WHEN 3 THEN 'MCI-' ELSE 'MCIu' END AS "group" FROM customer WHERE c_nationkey % 7 < 6 AND c_acctbal > 0""")
def q_groups_by_label(spark, d):
    label = F.element_at(F.array(*map(F.lit, ["Y", "O", "MCI+", "MCI-", "P", "MCI", "none"])), (F.col("c_nationkey") % 7 + 1).cast("int"))
    return fetch.groups_by_label(table(spark, d, "customer").withColumn("label", label), "c_custkey", "label", valid=F.col("c_acctbal") > 0)


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS m FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice)) WHERE NOT (l_linenumber = 1 AND m > 1 AND n = 1)""")
def q_without_first_repeat(spark, d):
    return ingest.without_first_repeat(table(spark, d, "lineitem"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_extendedprice"], "l_linenumber", 1).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_custkey, -1, min_by(o_totalprice, o_orderkey) FROM orders GROUP BY 1")
def q_with_baseline(spark, d):
    return ingest.with_baseline(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "o_orderkey")


@query("SELECT n_nationkey AS trial, 'info' AS origin FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_nationkey, 'config' FROM nation WHERE n_regionkey >= 3")
def q_missing_trials(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("trial"), "n_regionkey")
    return ingest.with_missing_trials(n.where("n_regionkey < 3").select("trial", F.lit("info").alias("origin")), n.select("trial", F.lit("config").alias("origin")), "trial")


@query(E + ", s AS (SELECT user_id, min(t) AS start_at FROM e WHERE label = 'purchase' GROUP BY 1) SELECT e.user_id, event_id FROM e LEFT JOIN s USING (user_id) WHERE start_at IS NULL OR t >= start_at")
def q_trim_before(spark, d):
    e = samples(spark, d)
    return ingest.trim_before(e, KEY, "t", e.where("label = 'purchase'").groupBy(*KEY).agg(F.min("t").alias("start_at"))).select("user_id", "event_id")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS name, CASE WHEN p_size > 25 THEN p_name END AS fifth FROM part")
def q_resolved_layout(spark, d):
    p = table(spark, d, "part").withColumn("probe", F.when(F.col("p_size") > 25, F.col("p_size").cast("double")).when(F.col("p_size") > 10, F.lit(float("nan"))))
    return ingest.resolved_layout(p, {"name": "p_type"}, {"name": "p_brand", "fifth": "p_name"}, "probe").select("p_partkey", "name", "fifth")


@query(E + " SELECT event_id, CASE WHEN (x = -1 OR y < 20) AND (z = -1 OR x < 40) THEN 1 ELSE 0 END AS track_loss FROM e")
def q_track_loss(spark, d):
    eyes = samples(spark, d).withColumns({"left_open": F.col("y") - 20, "right_open": F.col("x") - 40})
    return cleaning.track_loss(eyes, ("x", "left_open"), ("z", "right_open"), shut=0.0).select("event_id", "track_loss")


@query(E + ", s AS (SELECT user_id, event_id, t - 1705300000000 AS t FROM e) SELECT user_id, event_id, CAST(CASE WHEN min(t) OVER (PARTITION BY user_id) < 0 THEN t + abs(min(t) OVER (PARTITION BY user_id)) + 1 ELSE t END AS BIGINT) AS t FROM s")
def q_shift_to_zero(spark, d):
    return cleaning.shift_to_zero(samples(spark, d).withColumn("t", F.col("t") - 1705300000000), KEY, "t").select("user_id", "event_id", "t")


@query(E + f""", a AS (SELECT user_id, event_id, t, x, missing, CASE WHEN label IN ('click', 'view', 'signup') THEN 'A' ELSE 'B' END AS label FROM e), n AS (SELECT *, lag(label, 2) {W} AS a2, lag(label) {W} AS a1, lead(label) {W} AS b1, lead(label, 2) {W} AS b2, lag(x) {W} AS xa, lead(x) {W} AS xb FROM a),
s AS (SELECT *, CASE WHEN coalesce(a2 = a1 AND a1 = b1 AND b1 = b2 AND label <> a1, false) THEN (xa + xb) / 2 ELSE x END AS x_sandwich, lag(t) {W} AS before, CASE WHEN lag(missing) {W} = missing THEN 0 ELSE 1 END AS fresh FROM n), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s),
b AS (SELECT *, CASE WHEN missing = 1 AND max(t) OVER (PARTITION BY user_id, run) - first_value(coalesce(before, t)) OVER (PARTITION BY user_id, run ORDER BY t, event_id) >= 86400000 THEN 1 ELSE 0 END AS blink FROM r)
SELECT user_id, event_id, round(x, 6) AS x, round(x_sandwich, 6) AS x_sandwich, round(CASE WHEN blink = 0 THEN x_sandwich END, 6) AS x_blink FROM b""")
def q_staged_cleaning(spark, d):
    e = samples(spark, d).withColumn("label", F.when(F.col("label").isin("click", "view", "signup"), "A").otherwise("B"))
    return cleaning.staged(e, KEY, ORDER, "label", ["x"], "missing", least=24 * HOUR).select("user_id", "event_id", *[F.round(c, 6).alias(c) for c in ("x", "x_sandwich", "x_blink")])


@query("""WITH c AS (SELECT o_orderstatus AS g, o_custkey, sum(o_totalprice) AS total, count(*)::DOUBLE AS n_orders FROM orders GROUP BY ALL), l AS (UNPIVOT c ON total, n_orders INTO NAME value VALUE v), s AS (SELECT g, value, count(v) AS n, avg(v) AS m, var_samp(v) AS s FROM l GROUP BY ALL),
p AS (SELECT a.g AS first, b.g AS second, a.value, a.m - b.m AS apart, ((a.n - 1) * a.s + (b.n - 1) * b.s) / nullif(a.n + b.n - 2, 0) AS pooled, 1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n AS inv FROM s a JOIN s b ON a.value = b.value AND a.g < b.g)
SELECT first, second, value, round(apart / nullif(sqrt(pooled * inv), 0), 6) AS t, round(apart / nullif(sqrt(pooled), 0), 6) AS d FROM p""")
def q_pair_stats(spark, d):
    per = table(spark, d, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("n_orders"))
    return statistics.pair_stats(per, "o_orderstatus", ["total", "n_orders"]).withColumns({c: F.round(c, 6) for c in ("t", "d")})


@query("SELECT user_id, unnest(['enc', 'ret']) AS side FROM (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('1:' || user_id), user_id LIMIT 20)")
def q_scanpath_sample(spark, d):
    return statistics.sampled_pairs(table(spark, d, "events"), "user_id", 20)


@query()
def q_hypothesis_draws(spark, d):
    return statistics.hypothesis_draws(spark, {"Y": 3.0, "O": 2.0, "MCI": 1.0}, 100, 0.5)


@query(E + ", q AS (SELECT user_id, median(x) AS cx, median(y) AS cy, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS sx, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS sy FROM e GROUP BY 1) SELECT user_id, round((coalesce(cx, cy) + coalesce(cy, cx)) / 2, 6) AS pupil_diam_centre, round((coalesce(sx, sy) + coalesce(sy, sx)) / 2, 6) AS pupil_diam_spread FROM q")
def q_pupil_features(spark, d):
    out = pupil_features("x", "y").evaluate(samples(spark, d), KEY, {})
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("pupil_diam_centre", "pupil_diam_spread")])


@query(_segments(60) + " SELECT user_id, count(*) AS n_sacc_total, " + ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS n_sacc_{x}" for x in LABELS) + ", round(CASE WHEN count(mean_speed) > 2 THEN avg(mean_speed) END, 6) AS velocity_mean_total, round(CASE WHEN count(mean_speed) > 2 THEN stddev_pop(mean_speed) END, 6) AS velocity_std_total FROM seg WHERE kind = 'saccade' GROUP BY 1")
def q_saccade_features(spark, d):
    e = segments.angular_speed(samples(spark, d).withColumn("hours", F.col("t") / HOUR), KEY, ORDER, "hours", ["x", "y", "z"])
    found = segments.segment_table(segments.by_speed(e, KEY, ORDER, "t", "angular_speed", "label", most=60, least=0), KEY, ORDER, "t", "fixation", "label", ["x", "y", "z"], missing="missing")
    out = saccade_features(LABELS).evaluate(found.where("kind = 'saccade'"), KEY, {"label": "label", "mean_speed": "mean_speed"})
    return out.withColumns({c: F.round(c, 6) for c, k in out.dtypes if k == "double"})


def _gini(weight: str, name: str) -> str:
    """Gini over 5 slots of the shares of a label's revisits."""
    return R + f""", v AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY run) AS visit FROM r), w AS (SELECT user_id, label, {weight} AS w FROM v WHERE visit > 1 GROUP BY ALL), p AS (SELECT user_id, w / nullif(sum(w) OVER (PARTITION BY user_id), 0) AS p FROM w),
a AS (SELECT user_id, list(p ORDER BY p) AS ps, count(*) AS n FROM p GROUP BY 1), s AS (SELECT user_id, list_concat(list_transform(range(5 - n), lambda i: 0.0::DOUBLE), ps) AS xs FROM a)
SELECT user_id, round(list_sum(list_transform(range(5), lambda i: (2 * (i + 1) - 6) * xs[i + 1])) / nullif(5 * list_sum(xs), 0), 6) AS {name} FROM s"""


def _revisits(spark, d):
    merged = islands.merge_runs(episodes(spark, d), KEY, ORDER, "label", "t", "t_end")
    return islands.visit_number(merged, KEY, ["start"], "label").where("visit > 1")


@query(_gini("count(*)::DOUBLE", "gini_refix"))
def q_gini_refix(spark, d):
    return transitions.label_gini(transitions.label_weights(_revisits(spark, d), KEY, "label"), KEY, 5, "gini_refix").withColumn("gini_refix", F.round("gini_refix", 6))


@query(_gini("sum(duration)::DOUBLE", "gini_redwell"))
def q_gini_redwell(spark, d):
    return transitions.label_gini(transitions.label_weights(_revisits(spark, d), KEY, "label", "duration"), KEY, 5, "gini_redwell").withColumn("gini_redwell", F.round("gini_redwell", 6))


#: Runs of the standard labels, and the entropies of their steps, weighed in three ways.
_STANDARD = E + f""", l AS (SELECT user_id, event_id, t, t_end, CASE WHEN label = 'error' THEN 'External' WHEN label = 'signup' THEN 'Previous' WHEN label = 'purchase' THEN 'Moved' ELSE label END AS label FROM e), f AS (SELECT *, CASE WHEN lag(label) {W} = label THEN 0 ELSE 1 END AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f), m AS (SELECT user_id, run, label, max(t_end) - min(t) AS duration FROM g GROUP BY ALL), s0 AS (SELECT user_id, label AS a, lead(label) OVER (PARTITION BY user_id ORDER BY run) AS b FROM m),
s1 AS (SELECT user_id, a, b, count(*) AS n FROM s0 WHERE b IS NOT NULL GROUP BY ALL), s2 AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS pj, n / sum(n) OVER (PARTITION BY user_id, a)::DOUBLE AS pc FROM s1), ht AS (SELECT user_id, -sum(pj * log2(pc)) AS ht_s FROM s2 GROUP BY 1),
sh AS (SELECT user_id, a AS label, sum(pc * log2(pc)) AS h FROM s2 GROUP BY ALL), lw AS (SELECT user_id, label, count(*)::DOUBLE AS c, sum(duration)::DOUBLE AS d FROM m GROUP BY ALL), lx AS (SELECT user_id, label, c / sum(c) OVER (PARTITION BY user_id) AS wc, d / nullif(sum(d) OVER (PARTITION BY user_id), 0) AS wd FROM lw),
hx AS (SELECT user_id, -sum(wc * h) AS hn_s, -sum(wd * h) AS hd_s FROM sh JOIN lx USING (user_id, label) GROUP BY 1) SELECT user_id, round(hn_s, 6) AS hn_s, round(hd_s, 6) AS hd_s, round(ht_s, 6) AS ht_s FROM ht JOIN hx USING (user_id)"""


@query(_STANDARD)
def q_standardised_entropies(spark, d):
    e = aoi.standard_labels(episodes(spark, d), "label", outside=["error"], moved="purchase", invisible="signup")
    merged = islands.merge_runs(e, KEY, ORDER, "standard", "t", "t_end")
    shares = transitions.transition_shares(transitions.transition_counts(merged, KEY, ["start", "run"], "standard"), KEY)
    ht = transitions.joint_entropy(shares, KEY, "ht_s")
    hn = transitions.weighted_entropy(shares, transitions.label_weights(merged, KEY, "standard"), KEY, "hn_s")
    hd = transitions.weighted_entropy(shares, transitions.label_weights(merged, KEY, "standard", "duration"), KEY, "hd_s")
    out = ht.join(hn, KEY).join(hd, KEY)
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("hn_s", "hd_s", "ht_s")])


@query(E + """, v AS (SELECT user_id, side, count(*) AS n_fix, avg(x) AS x_mean FROM e GROUP BY ALL), d AS (SELECT user_id, """ + ", ".join(f"max({c}) FILTER (WHERE side = 'ret') - max({c}) FILTER (WHERE side = 'enc') AS {c}" for c in ("n_fix", "x_mean")) + """ FROM v GROUP BY 1)
SELECT user_id % 6 AS cond, count(*) AS n_trials, """ + ", ".join(f"round(CASE WHEN count(*) >= 5 THEN median({c}) END, 6) AS {c}_diff_median" for c in ("n_fix", "x_mean")) + " FROM d GROUP BY 1")
def q_level_driver(spark, d):
    """All levels, with viewings of two thirds of the users already there."""
    e = samples(spark, d).withColumn("cond", F.col("user_id") % 6)
    compute = lambda s: s.groupBy("user_id", "side").agg(F.count("*").alias("n_fix"), F.avg("x").alias("x_mean"))
    done = compute(e.where("user_id % 3 > 0"))
    out = pipeline.levels(e, ["user_id", "side"], ["user_id"], "side", ["cond"], compute, done=done)["condition"]
    return out.withColumns({c: F.round(c, 6) for c, k in out.dtypes if k == "double"})


@query()
def q_preprocess(spark, d):
    """Raw samples to clean ones: every step of the preparation as one plan, with hours as the unit of time."""
    e = samples(spark, d).withColumn("t", F.floor((F.col("t") - F.min("t").over(Window.partitionBy("user_id"))) / HOUR).cast("long"))
    e = e.withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    spec = {"cutoff": 100.0, "median": 5, "mean": 5}
    out = cleaning.preprocessed(e, KEY, ["t", "event_id"], "frame", "label", "missing", {"x": spec, "y": spec}, blink=24, most_missing=0.5)
    return out.select("user_id", "event_id", "t", "blink", "technical", *[F.round(c, 6).alias(c) for c in ("x", "y")])
