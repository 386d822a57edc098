"""Ordered sequences: runs, segments, transitions, features, cleaning, detectors, areas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glintspan.functions import geometry as geo
from glintspan.operators import aoi, cleaning, compare, islands, segments, signal, timecourse, transitions
from glintspan.plans.registry import fixation_features

from .base import HOUR, KEY, LABELS, ORDER, E, R, T, episodes, query, samples, table

W = "OVER (PARTITION BY user_id ORDER BY t, event_id)"
CODES = [("click", "c"), ("error", "e"), ("purchase", "p"), ("signup", "s"), ("view", "v")]


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(R + """, v AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY run) AS visit FROM r),
f AS (SELECT user_id, count(*) AS n_fix_total, round(sum(duration) / 3600000.0, 6) AS dwell_hours, round(coalesce(min(CASE WHEN label = 'purchase' THEN "start" END) - min("start"), 13000.0) / 3600000.0, 6) AS t_first_purchase, count(*) FILTER (WHERE visit > 1) AS n_refix_total FROM v GROUP BY 1),
st AS (SELECT user_id, label AS a, lead(label) OVER (PARTITION BY user_id ORDER BY run) AS b FROM r), tc AS (SELECT user_id, a, b, count(*) AS n FROM st WHERE b IS NOT NULL GROUP BY ALL),
tp AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS pj, n / sum(n) OVER (PARTITION BY user_id, a)::DOUBLE AS pc FROM tc), h AS (SELECT user_id, round(-sum(pj * log2(pc)), 6) AS ht FROM tp GROUP BY 1)
SELECT f.*, h.ht FROM f LEFT JOIN h USING (user_id)""")
def q_sequence_features(spark, d):
    merged = islands.visit_number(islands.merge_runs(episodes(spark, d), KEY, ORDER, "label", "t", "t_end"), KEY, ["start"], "label")
    roles = {"label": "label", "start": "start", "duration": "duration", "visit": "visit"}
    out = fixation_features(["purchase"]).evaluate(merged, KEY, roles, ["n_fix_total", "dwell_total", "t_first_purchase", "n_refix_total"])
    ht = transitions.joint_entropy(transitions.transition_shares(transitions.transition_counts(merged, KEY, ["start", "run"], "label"), KEY), KEY)
    out = out.join(ht, "user_id", "left")
    return out.select("user_id", "n_fix_total", F.round(F.col("dwell_total") / HOUR, 6).alias("dwell_hours"), F.round(F.col("t_first_purchase") / HOUR, 6).alias("t_first_purchase"), "n_refix_total", F.round("ht", 6).alias("ht"))


@query(E + ", " + "b AS (SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS n_fix_{x}" for x in LABELS) + ", count(*) AS n_fix_total FROM e GROUP BY 1) SELECT * FROM b")
def q_fix_counts(spark, d):
    names = [f"n_fix_{x}" for x in LABELS] + ["n_fix_total"]
    return fixation_features(LABELS).evaluate(samples(spark, d), KEY, {"label": "label"}, names).select("user_id", *names)


@query(E + ", " + "b AS (SELECT user_id, " + ", ".join(f"round(coalesce(sum(CASE WHEN label = '{x}' THEN dur END), 0), 6) AS dwell_{x}" for x in LABELS) + " FROM e GROUP BY 1) SELECT * FROM b")
def q_dwell(spark, d):
    names = [f"dwell_{x}" for x in LABELS]
    return fixation_features(LABELS).evaluate(episodes(spark, d), KEY, {"label": "label", "duration": "dur"}, names).select("user_id", *r6(*names))


@query(E + " SELECT user_id, CAST(coalesce(min(CASE WHEN label = 'purchase' THEN t END) - min(t), 13000) AS DOUBLE) AS t_first_purchase, CAST(coalesce(min(CASE WHEN label IN ('click', 'view') THEN t END) - min(t), 13000) AS DOUBLE) AS t_first_array FROM e GROUP BY 1")
def q_t_first(spark, d):
    r = fixation_features(["click", "view"])
    r.register("t_first_purchase", fixation_features(["purchase"])["t_first_purchase"].build)
    return r.evaluate(samples(spark, d), KEY, {"label": "label", "start": "t"}, ["t_first_purchase", "t_first_array"])


def _merged(spark, d):
    return islands.visit_number(islands.merge_runs(episodes(spark, d), KEY, ORDER, "label", "t", "t_end", ["x"]), KEY, ["run"], "label")


V = R + ", v AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY run) AS visit FROM r)"


@query(V + " SELECT user_id, count(*) FILTER (WHERE visit > 1) AS n_refix_total, count(*) FILTER (WHERE visit > 1 AND label = 'click') AS n_refix_click FROM v GROUP BY 1")
def q_refix_counts(spark, d):
    roles = {"label": "label", "visit": "visit", "duration": "duration", "start": "start"}
    return fixation_features(LABELS).evaluate(_merged(spark, d), KEY, roles, ["n_refix_total", "n_refix_click"])


@query(V + " SELECT user_id, round(coalesce(sum(CASE WHEN visit > 1 THEN duration END), 0) / 3600000.0, 6) AS redwell_total, round(coalesce(avg(CASE WHEN visit > 1 THEN duration END), 0) / 3600000.0, 6) AS refix_mean FROM v GROUP BY 1")
def q_redwell(spark, d):
    roles = {"label": "label", "visit": "visit", "duration": "duration", "start": "start"}
    out = fixation_features(LABELS).evaluate(_merged(spark, d), KEY, roles, ["redwell_total", "refix_duration_mean"])
    return out.select("user_id", F.round(F.col("redwell_total") / HOUR, 6).alias("redwell_total"), F.round(F.col("refix_duration_mean") / HOUR, 6).alias("refix_mean"))


@query(R + " SELECT user_id, run, label, n, \"start\", \"end\", duration, round(coalesce(wx, ax), 6) AS x FROM r")
def q_merge_consecutive(spark, d):
    return islands.merge_runs(episodes(spark, d), KEY, ORDER, "label", "t", "t_end", ["x"]).select("user_id", "run", "label", "n", "start", "end", "duration", F.round("x", 6).alias("x"))


@query(E + f", q AS (SELECT user_id, event_id, missing, CASE WHEN missing = 1 AND coalesce(lag(missing) {W}, 0) <> 1 THEN 1 ELSE 0 END AS run_start, CASE WHEN missing = 1 AND coalesce(lead(missing) {W}, 0) <> 1 THEN 1 ELSE 0 END AS run_end FROM e) SELECT * FROM q")
def q_runs_start_end(spark, d):
    return islands.run_edges(samples(spark, d), KEY, ORDER, "missing").select("user_id", "event_id", "missing", "run_start", "run_end")


@query(E + f""", q0 AS (SELECT *, lag(t) {W} AS before, CASE WHEN lag(busy) {W} = busy THEN 0 ELSE 1 END AS fresh FROM (SELECT *, CASE WHEN label IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END AS busy FROM e)),
q1 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM q0),
q2 AS (SELECT user_id, run, min_by(coalesce(before, t), t * 1000000 + event_id) AS a, max(t) AS b FROM q1 GROUP BY ALL)
SELECT q1.user_id, q1.event_id, CASE WHEN busy = 1 AND b - a >= 172800000 THEN 1 ELSE 0 END AS kept FROM q1 JOIN q2 USING (user_id, run)""")
def q_min_duration_runs(spark, d):
    e = samples(spark, d).withColumn("busy", F.col("label").isin("click", "view", "purchase").cast("int"))
    return islands.drop_short_runs(e, KEY, ORDER, "busy", "t", 48 * HOUR).select("user_id", "event_id", "kept")


@query(E + f", q AS (SELECT *, CASE WHEN t - lag(t) {W} > 43200000 THEN 1 ELSE 0 END AS cut FROM e), p AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM q) SELECT user_id, segment, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM p GROUP BY ALL")
def q_gap_split_segments(spark, d):
    return islands.split_by_gap(samples(spark, d), KEY, ORDER, "t", 12 * HOUR).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


@query(E + """, q AS (SELECT *, sum(missing) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e), p AS (SELECT *, max(t) OVER (PARTITION BY user_id, g) - min(t) OVER (PARTITION BY user_id, g) AS span FROM q WHERE missing = 0)
SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY g) - 1 AS segment FROM p WHERE span > 0""")
def q_missing_split(spark, d):
    return islands.split_by_missing(samples(spark, d), KEY, ORDER, "missing").select("user_id", "event_id", "segment")


@query(E + f""", n AS (SELECT *, lag(label, 2) {W} AS a2, lag(label) {W} AS a1, lead(label) {W} AS b1, lead(label, 2) {W} AS b2, lag(x) {W} AS xa, lead(x) {W} AS xb FROM (SELECT user_id, event_id, t, x, CASE WHEN label IN ('click', 'view', 'signup') THEN 'A' ELSE 'B' END AS label FROM e))
SELECT user_id, event_id, CASE WHEN coalesce(a2 = a1 AND a1 = b1 AND b1 = b2 AND label <> a1, false) THEN a1 ELSE label END AS label, round(CASE WHEN coalesce(a2 = a1 AND a1 = b1 AND b1 = b2 AND label <> a1, false) THEN (xa + xb) / 2 ELSE x END, 6) AS x FROM n""")
def q_sandwich_repair(spark, d):
    e = samples(spark, d).withColumn("label", F.when(F.col("label").isin("click", "view", "signup"), "A").otherwise("B"))
    return cleaning.repair_sandwiches(e, KEY, ORDER, "label", ["x"]).select("user_id", "event_id", "label", F.round("x", 6).alias("x"))


@query(E + f""", p AS (SELECT *, sqrt((x - lag(x) {W}) ** 2 + (y - lag(y) {W}) ** 2) / nullif((t - lag(t) {W}) / 3600000.0, 0) AS speed FROM e)
SELECT user_id, event_id, round(speed, 3) AS speed, round((speed - lag(speed) {W}) / nullif((t - lag(t) {W}) / 3600000.0, 0), 1) AS acceleration FROM p""")
def q_speed_accel(spark, d):
    e = islands.steps(samples(spark, d), KEY, ORDER, "t", ["x", "y"])
    return e.select("user_id", "event_id", F.round(F.col("speed") * HOUR, 3).alias("speed"), F.round(F.col("acceleration") * HOUR * HOUR, 1).alias("acceleration"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def q_dedup_first(spark, d):
    return islands.first_of_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(E + " SELECT user_id, CAST(floor((t - t0) / 86400000.0) AS BIGINT) AS bin, count(*) AS n, round(avg(x), 6) AS mean_x FROM (SELECT *, min(t) OVER (PARTITION BY user_id) AS t0 FROM e) GROUP BY ALL")
def q_time_bins(spark, d):
    return timecourse.time_bins(samples(spark, d), KEY, "t", 24 * HOUR, None).groupBy("user_id", "bin").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean_x"))


@query(E + " SELECT label, w * 43200000 AS window_start, count(*) AS n FROM (SELECT label, unnest(range(CAST(floor((t - 86400000) / 43200000.0) AS BIGINT) + 1, CAST(floor(t / 43200000.0) AS BIGINT) + 1)) AS w FROM e) GROUP BY ALL")
def q_sliding_bins(spark, d):
    return timecourse.sliding_bins(samples(spark, d), "t", 24 * HOUR, 12 * HOUR).groupBy("label", "window_start").agg(F.count("*").alias("n"))


@query(E + """, q AS (SELECT label, CAST(floor(t / 86400000.0) AS BIGINT) AS day, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY ALL)
SELECT label, day, round(CASE WHEN count(*) OVER w = 5 THEN avg(n) OVER w ELSE n END, 6) AS smooth FROM q WINDOW w AS (PARTITION BY label ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def q_moving_average(spark, d):
    days = timecourse.time_bins(samples(spark, d), KEY, "t", 24 * HOUR, 0, "day").groupBy("label", "day").agg(F.count("*").cast("double").alias("n"))
    return islands.moving_average(days, ["label"], ["day"], "n", 5).select("label", "day", F.round("smooth", 6).alias("smooth"))


@query(E + f""", q AS (SELECT user_id, label, coalesce(ceil((lag(t) {W} + t) / 2.0)::BIGINT, t) - min(t) OVER (PARTITION BY user_id) AS a, coalesce(ceil((t + lead(t) {W}) / 2.0)::BIGINT, t + 1) - 1 - min(t) OVER (PARTITION BY user_id) AS b FROM e),
g AS (SELECT user_id, label, unnest(range(ceil(a / 43200000.0)::BIGINT, least(floor(b / 43200000.0)::BIGINT, 39) + 1)) * 43200000 AS t FROM q), n AS (SELECT t, count(DISTINCT user_id) AS m FROM g GROUP BY 1)
SELECT t, label, round(count(DISTINCT user_id) / m::DOUBLE, 6) AS share FROM g JOIN n USING (t) GROUP BY t, label, m""")
def q_aoi_share_timecourse(spark, d):
    grid = timecourse.label_grid(samples(spark, d), KEY, ORDER, "t", "label", 12 * HOUR, until=40 * 12 * HOUR)
    return timecourse.label_shares(grid, [], KEY).select("t", "label", F.round("share", 6).alias("share"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(unnest(range(CAST(floor(l_quantity / 10) AS BIGINT))) AS INTEGER) AS token FROM lineitem WHERE l_quantity >= 10")
def q_token_split(spark, d):
    return timecourse.tokens(table(spark, d, "lineitem"), "l_quantity", 10).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "token")


@query(E + """, c AS (SELECT user_id, label, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label) AS i, sum(n) OVER (PARTITION BY user_id) AS m FROM c)
SELECT user_id, max(CASE WHEN i = 1 THEN label END) AS label, round(max(CASE WHEN i = 1 THEN n END) / max(m)::DOUBLE, 6) AS label_share, max(CASE WHEN i = 2 THEN label END) AS second_label, round(max(CASE WHEN i = 2 THEN n END) / max(m)::DOUBLE, 6) AS second_share FROM k GROUP BY 1""")
def q_mode_share(spark, d):
    e = samples(spark, d).withColumn("one", F.lit(1))
    return segments.segment_table(e, KEY, ORDER, "t", "one", "label", ["x", "y", "z"]).select("user_id", "label", F.round("label_share", 6).alias("label_share"), "second_label", F.round("second_share", 6).alias("second_share"))


@query(E + " SELECT user_id, side, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, round(sqrt(var_samp(x) + var_samp(y) + var_samp(z)), 6) AS dispersion FROM e GROUP BY ALL HAVING count(*) > 1")
def q_centroid_dispersion(spark, d):
    e = samples(spark, d).withColumn("one", F.lit(1))
    out = segments.segment_table(e, ["user_id", "side"], ORDER, "t", "one", "label", ["x", "y", "z"]).where("rows > 1")
    return out.select("user_id", "side", F.col("rows").alias("n"), *[F.round(f"centroid_{a}", 6).alias(f"c{a}") for a in "xyz"], F.round("dispersion", 6).alias("dispersion"))


@query(E + f" SELECT user_id, round(sum(CASE WHEN missing = 1 THEN step ELSE 0 END) / nullif(sum(step), 0)::DOUBLE, 6) AS share FROM (SELECT *, t - lag(t) {W} AS step FROM e) GROUP BY 1")
def q_time_weighted_share(spark, d):
    return islands.time_share(samples(spark, d), KEY, ORDER, "t", F.col("missing") == 1).withColumn("share", F.round("share", 6))


@query(E + """, a AS (SELECT user_id, t, label, min(CASE WHEN label = 'purchase' THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_at FROM e), i AS (SELECT user_id, end_at, min(t) AS start_at FROM a WHERE label = 'view' AND end_at IS NOT NULL GROUP BY ALL)
SELECT i.user_id, i.start_at, count(*) AS n FROM i JOIN (SELECT o.user_id, o.t FROM e o) p ON p.user_id = i.user_id AND p.t >= i.start_at AND p.t < i.end_at GROUP BY ALL""")
def q_interval_range_join(spark, d):
    e = samples(spark, d)
    spans = islands.first_pair_after(e, KEY, ORDER, "label", "view", "purchase", each=True)
    return islands.intervals_join(e.select("user_id", "t"), spans, KEY, "t", "start_at", "end_at", 24 * HOUR).groupBy("user_id", "start_at").agg(F.count("*").alias("n"))


def _shares(spark, d):
    return transitions.transition_shares(transitions.transition_counts(samples(spark, d), KEY, ORDER, "label"), KEY)


@query(T + " SELECT user_id, from_label, to_label, n FROM tc")
def q_transition_counts(spark, d):
    return transitions.transition_counts(samples(spark, d), KEY, ORDER, "label")


@query(T + " SELECT user_id, from_label, to_label, round(p_joint, 6) AS p_joint FROM tp")
def q_joint_p(spark, d):
    return _shares(spark, d).select("user_id", "from_label", "to_label", F.round("p_joint", 6).alias("p_joint"))


@query(T + " SELECT user_id, from_label, to_label, round(p_cond, 6) AS p_cond FROM tp")
def q_cond_p(spark, d):
    return _shares(spark, d).select("user_id", "from_label", "to_label", F.round("p_cond", 6).alias("p_cond"))


@query(T + " SELECT user_id, sum(n)::BIGINT AS n_transitions FROM tc GROUP BY 1")
def q_n_transitions(spark, d):
    return _shares(spark, d).groupBy("user_id").agg(F.sum("n").alias("n_transitions"))


@query(T + " SELECT user_id, round(-sum(p_joint * log2(p_cond)), 6) AS ht FROM tp GROUP BY 1")
def q_entropy_ht(spark, d):
    return transitions.joint_entropy(_shares(spark, d), KEY).withColumn("ht", F.round("ht", 6))


def _entropy_sql(weight: str, name: str) -> str:
    return T + f", w AS (SELECT user_id, label, {weight} / sum({weight}) OVER (PARTITION BY user_id)::DOUBLE AS w FROM e GROUP BY user_id, label), f AS (SELECT user_id, from_label AS label, sum(p_cond * log2(p_cond)) AS h FROM tp GROUP BY ALL) SELECT user_id, round(-sum(w * h), 6) AS {name} FROM f JOIN w USING (user_id, label) GROUP BY 1"


@query(_entropy_sql("count(*)", "hn"))
def q_entropy_hn(spark, d):
    return transitions.weighted_entropy(_shares(spark, d), transitions.label_weights(samples(spark, d), KEY, "label"), KEY, "hn").withColumn("hn", F.round("hn", 6))


@query(_entropy_sql("sum(dur)", "hd"))
def q_entropy_hd(spark, d):
    return transitions.weighted_entropy(_shares(spark, d), transitions.label_weights(episodes(spark, d), KEY, "label", "dur"), KEY, "hd").withColumn("hd", F.round("hd", 6))


def _gini_sql(weight: str, name: str) -> str:
    return E + f""", w AS (SELECT user_id, label, {weight} AS v FROM e GROUP BY ALL), p AS (SELECT user_id, v FROM w UNION ALL SELECT user_id, 0 FROM (SELECT user_id, count(*) AS k FROM w GROUP BY 1), range(11) g(i) WHERE i < 11 - k),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v) AS i FROM p) SELECT user_id, round(sum((2.0 * i - 12) * v) / (11 * sum(v)), 6) AS {name} FROM o GROUP BY 1"""


@query(_gini_sql("count(*)::DOUBLE", "gini_fix"))
def q_gini_fix(spark, d):
    return transitions.label_gini(transitions.label_weights(samples(spark, d), KEY, "label"), KEY, 11, "gini_fix").withColumn("gini_fix", F.round("gini_fix", 6))


@query(_gini_sql("sum(dur)", "gini_dwell"))
def q_gini_dwell(spark, d):
    return transitions.label_gini(transitions.label_weights(episodes(spark, d), KEY, "label", "dur"), KEY, 11, "gini_dwell").withColumn("gini_dwell", F.round("gini_dwell", 6))


@query(E + """, s0 AS (SELECT *, lag(label) OVER (PARTITION BY user_id, side ORDER BY t, event_id) AS pl FROM e), s1 AS (SELECT * FROM s0 WHERE pl IS NULL OR pl <> label), s2 AS (SELECT user_id, side, label AS a, lead(label) OVER (PARTITION BY user_id, side ORDER BY t, event_id) AS b FROM s1),
c AS (SELECT user_id, side, a, b, count(*) AS n FROM s2 WHERE b IS NOT NULL GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, side)::DOUBLE AS p FROM c),
j AS (SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(x.p, 0) + 1e-5 AS p, coalesce(y.p, 0) + 1e-5 AS q FROM (SELECT * FROM p WHERE side = 'enc') x FULL JOIN (SELECT * FROM p WHERE side = 'ret') y ON x.user_id = y.user_id AND x.a = y.a AND x.b = y.b)
SELECT user_id, round((sum(p * ln(p / q)) + sum(q * ln(q / p))) / 2, 6) AS d_kl FROM j GROUP BY 1""")
def q_sym_kl(spark, d):
    s = transitions.transition_shares(transitions.transition_counts(samples(spark, d), ["user_id", "side"], ORDER, "label"), ["user_id", "side"])
    return transitions.symmetric_divergence(s.where("side = 'enc'"), s.where("side = 'ret'"), KEY).withColumn("d_kl", F.round("d_kl", 6))


@query()
def q_matrix_json(spark, d):
    return transitions.matrix_json(_shares(spark, d), KEY)


@query()
def q_stationary(spark, d):
    return transitions.stationary(_shares(spark, d), KEY).withColumn("pi", F.round("pi", 6))


CASE = "CASE label WHEN 'click' THEN 'c' WHEN 'error' THEN 'e' WHEN 'purchase' THEN 'p' WHEN 'signup' THEN 's' ELSE 'v' END"
S = E + f""", s0 AS (SELECT *, lag(label) OVER (PARTITION BY user_id, side ORDER BY t, event_id) AS pl FROM e), s1 AS (SELECT user_id, side, string_agg({CASE}, '' ORDER BY t, event_id) AS labels FROM s0 WHERE pl IS NULL OR pl <> label GROUP BY ALL),
s2 AS (SELECT a.user_id, a.labels AS enc, b.labels AS ret FROM s1 a JOIN s1 b ON a.user_id = b.user_id AND a.side = 'enc' AND b.side = 'ret')"""


def _strings(spark, d):
    s = compare.label_strings(samples(spark, d), ["user_id", "side"], ORDER, "label", CODES)
    return s.groupBy("user_id").agg(F.max(F.when(F.col("side") == "enc", F.col("labels"))).alias("enc"), F.max(F.when(F.col("side") == "ret", F.col("labels"))).alias("ret")).where("enc IS NOT NULL AND ret IS NOT NULL")


@query(S + " SELECT user_id, enc, ret, levenshtein(enc, ret) AS lev_dist FROM s2")
def q_levenshtein(spark, d):
    return _strings(spark, d).select("user_id", "enc", "ret", F.levenshtein("enc", "ret").cast("long").alias("lev_dist"))


@query()
def q_lev_ratio(spark, d):
    return compare.edit_distances(_strings(spark, d), "enc", "ret").select("user_id", "lev_dist", F.round("lev_ratio", 6).alias("lev_ratio"))


@query(E + """, z AS (SELECT user_id, event_id, side, coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0) AS x, coalesce((y - avg(y) OVER w) / nullif(stddev_pop(y) OVER w, 0), 0) AS y FROM e WINDOW w AS (PARTITION BY user_id)),
c AS (SELECT a.user_id, a.event_id AS i, b.event_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM z a JOIN z b ON a.user_id = b.user_id AND a.side = 'enc' AND b.side = 'ret'),
l AS (SELECT user_id, sum(d) AS s, count(*) AS n FROM (SELECT user_id, i, min(d) AS d FROM c GROUP BY ALL) GROUP BY 1), r AS (SELECT user_id, sum(d) AS s, count(*) AS n FROM (SELECT user_id, j, min(d) AS d FROM c GROUP BY ALL) GROUP BY 1)
SELECT user_id, round((l.s + r.s) / greatest(l.n, r.n), 6) AS ea FROM l JOIN r USING (user_id)""")
def q_eyenalysis(spark, d):
    e = samples(spark, d)
    return compare.point_set_distance(e.where("side = 'enc'"), e.where("side = 'ret'"), KEY, ["event_id"], ["x", "y"]).withColumn("ea", F.round("ea", 6))


@query()
def q_multimatch(spark, d):
    e = episodes(spark, d)
    out = compare.scan_paths(e.where("side = 'enc'"), e.where("side = 'ret'"), KEY, ORDER, "x", "y", "dur", (500.0, 100.0))
    return out.select("user_id", *r6("vector", "direction", "length", "position", "duration"))


DOT, NA, NB = "(x * px + y * py + z * pz)", "sqrt(x * x + y * y + z * z)", "sqrt(px * px + py * py + pz * pz)"


@query(E + f", a AS (SELECT *, lag(x) {W} AS px, lag(y) {W} AS py, lag(z) {W} AS pz FROM e) SELECT user_id, event_id, CASE WHEN {DOT} / nullif({NA} * {NB}, 0) IS NOT NULL THEN round(degrees(acos(greatest(-1.0, least(1.0, {DOT} / nullif({NA} * {NB}, 0))))), 4) END AS turn FROM a")
def q_angles(spark, d):
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    here = [F.col(c) for c in "xyz"]
    return samples(spark, d).select("user_id", "event_id", F.round(geo.angle_degrees(here, [F.lag(c).over(w) for c in "xyz"]), 4).alias("turn"))


@query(E + ", p AS (SELECT *, (x * 1 + y * 2 + z * 2 - 10.0) / 9 AS k FROM e) SELECT event_id, round(x - k, 6) AS px, round(y - 2 * k, 6) AS py, round(z - 2 * k, 6) AS pz FROM p")
def q_plane_projection(spark, d):
    p = geo.project_to_plane([F.col(c) for c in "xyz"], [F.lit(10.0), F.lit(0.0), F.lit(0.0)], [F.lit(1.0), F.lit(2.0), F.lit(2.0)])
    return samples(spark, d).select("event_id", *[F.round(v, 6).alias(f"p{c}") for v, c in zip(p, "xyz", strict=True)])


@query(E + """, q AS (SELECT event_id, x * x + y * y + z * z AS a, -2 * (x * 40.0 + y * 30.0 + z * 20.0) AS b, 40.0 * 40 + 30.0 * 30 + 20.0 * 20 - 25.0 * 25 AS c FROM e), r AS (SELECT *, b * b - 4 * a * c AS disc FROM q)
SELECT event_id, round(CASE WHEN disc < 0 THEN NULL WHEN (-b - sqrt(greatest(disc, 0.0))) / nullif(2 * a, 0) >= 0 THEN (-b - sqrt(greatest(disc, 0.0))) / nullif(2 * a, 0) WHEN (-b + sqrt(greatest(disc, 0.0))) / nullif(2 * a, 0) >= 0 THEN (-b + sqrt(greatest(disc, 0.0))) / nullif(2 * a, 0) END, 6) AS hit FROM r""")
def q_ray_sphere(spark, d):
    zero, centre = [F.lit(0.0)] * 3, [F.lit(40.0), F.lit(30.0), F.lit(20.0)]
    return samples(spark, d).select("event_id", F.round(geo.ray_sphere(zero, [F.col(c) for c in "xyz"], centre, F.lit(25.0)), 6).alias("hit"))


@query(E + " SELECT event_id, round(50.0 + cos(radians(30.0)) * (x - 50.0) - sin(radians(30.0)) * (z - 20.0), 6) AS rx, round(20.0 + sin(radians(30.0)) * (x - 50.0) + cos(radians(30.0)) * (z - 20.0), 6) AS rz FROM e")
def q_rotate(spark, d):
    rx, rz = geo.rotate_about(F.col("x"), F.col("z"), F.lit(50.0), F.lit(20.0), F.lit(30.0))
    return samples(spark, d).select("event_id", F.round(rx, 6).alias("rx"), F.round(rz, 6).alias("rz"))


@query(E + f""", a AS (SELECT *, lag(x) {W} AS px, lag(y) {W} AS py, lag(z) {W} AS pz, lag(t) {W} AS pt FROM e), v AS (SELECT *, CASE WHEN {DOT} / nullif({NA} * {NB}, 0) IS NOT NULL THEN degrees(acos(greatest(-1.0, least(1.0, {DOT} / nullif({NA} * {NB}, 0))))) END / nullif(abs((pt - t) / 3600000.0), 0) AS speed FROM a),
f AS (SELECT *, CASE WHEN coalesce(speed, 0) > 3 THEN 0 ELSE 1 END AS slow FROM v), g AS (SELECT *, CASE WHEN lag(slow) {W} = slow AND lag(label) {W} = label THEN 0 ELSE 1 END AS fresh FROM f), h AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sub FROM g),
i AS (SELECT *, CASE WHEN max(t) OVER (PARTITION BY user_id, sub) - min(t) OVER (PARTITION BY user_id, sub) >= 3600000 THEN slow ELSE 0 END AS s2 FROM h), j AS (SELECT *, lag(t) {W} AS before, CASE WHEN lag(s2) {W} = s2 THEN 0 ELSE 1 END AS fresh2 FROM i),
k AS (SELECT *, sum(fresh2) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM j), l AS (SELECT user_id, run, min_by(coalesce(before, t), t * 1000000 + event_id) AS a, max(t) AS b FROM k GROUP BY ALL)
SELECT k.user_id, k.event_id, CASE WHEN s2 = 1 AND b - a >= 3600000 THEN 1 ELSE 0 END AS fixation FROM k JOIN l USING (user_id, run)""")
def q_velocity_threshold_segments(spark, d):
    e = samples(spark, d).withColumn("hours", F.col("t") / HOUR)
    e = segments.angular_speed(e, KEY, ORDER, "hours", ["x", "y", "z"])
    return segments.by_speed(e, KEY, ORDER, "t", "angular_speed", "label", most=3, least=HOUR).select("user_id", "event_id", "fixation")


@query()
def q_ivdt(spark, d):
    e = segments.angular_speed(samples(spark, d).withColumn("hours", F.col("t") / HOUR), KEY, ORDER, "hours", ["x", "y", "z"], forward=True)
    return segments.by_speed_and_gap(e, KEY, ORDER, "t", "angular_speed", ["x", "y", "z"], most=2, least=HOUR, gap=24 * HOUR, angle=20).select("user_id", "event_id", "fixation")


@query()
def q_dispersion_threshold(spark, d):
    e = samples(spark, d).withColumns({f"h{c}": F.lit(0.0) for c in "xyz"})
    return segments.by_dispersion(e, KEY, ORDER, "t", ["x", "y", "z"], ["hx", "hy", "hz"], least=HOUR, most_angle=40.0).select("user_id", "event_id", "fixation")


@query()
def q_hmm_viterbi(spark, d):
    e = segments.angular_speed(samples(spark, d).withColumn("hours", F.col("t") / HOUR), KEY, ORDER, "hours", ["x", "y", "z"])
    return segments.by_hidden_states(e, KEY, ORDER, "angular_speed", mean=(1.0, 20.0), var=(4.0, 400.0)).select("user_id", "event_id", "fixation")


@query()
def q_cluster_fix(spark, d):
    return segments.by_clusters(samples(spark, d), KEY, ORDER, "t", ["x", "y", "z"], least=HOUR).select("user_id", "event_id", "fixation")


@query()
def q_segment_table(spark, d):
    e = segments.angular_speed(samples(spark, d).withColumn("hours", F.col("t") / HOUR), KEY, ORDER, "hours", ["x", "y", "z"])
    f = segments.by_speed(e, KEY, ORDER, "t", "angular_speed", "label", most=30, least=0)
    out = segments.segment_table(f, KEY, ORDER, "t", "fixation", "label", ["x", "y", "z"], missing="missing")
    return out.withColumns({c: F.round(c, 6) for c, k in out.dtypes if k == "double"})


@query(E + f""", f AS (SELECT user_id, CASE WHEN coalesce(x, 0) < 50 THEN 1 ELSE 0 END AS a, CASE WHEN y < 50 THEN 1 ELSE 0 END AS b FROM e), g AS (SELECT user_id, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM f GROUP BY 1)
SELECT user_id, n, round(po, 6) AS p_observed, round(pe, 6) AS p_expected, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM g""")
def q_kappa(spark, d):
    e = samples(spark, d).select("user_id", (F.coalesce("x", F.lit(0.0)) < 50).cast("int").alias("a"), (F.col("y") < 50).cast("int").alias("b"))
    return segments.agreement(e, KEY, "a", "b").select("user_id", "n", *r6("p_observed", "p_expected", "kappa"))


@query(E + """, m AS (SELECT user_id, label, avg(x) AS x, avg(y) AS y FROM e GROUP BY ALL), h AS (SELECT user_id, x AS hx, y AS hy FROM m WHERE label = 'click'), k AS (SELECT user_id, label, row_number() OVER (PARTITION BY user_id ORDER BY round(sqrt((x - hx) ** 2 + (y - hy) ** 2), 9), label) AS rank FROM m JOIN h USING (user_id) WHERE label <> 'click')
SELECT e.user_id, event_id, CASE WHEN label = 'error' THEN 'External' WHEN label = 'click' THEN 'Moved' WHEN rank IS NOT NULL THEN 'Obj' || (rank + 1) ELSE label END AS standard FROM e LEFT JOIN k USING (user_id, label)""")
def q_standardise_labels(spark, d):
    e = samples(spark, d)
    ranks = aoi.distance_ranks(e, KEY, "label", ["x", "y"], "click")
    return aoi.standard_labels(e, "label", outside=["error"], moved="click", invisible="none", ranks=ranks, key=KEY).select("user_id", "event_id", "standard")


@query()
def q_greedy_subaoi(spark, d):
    return aoi.leader_clusters(samples(spark, d), KEY, ORDER, "x", "y", 60.0).select("user_id", "event_id", "sub_area")


@query()
def q_aoi_hits(spark, d):
    e = samples(spark, d).withColumns({"sx": F.lit(0.0), "sy": F.lit(0.0), "sz": F.lit(0.0)})
    means = e.groupBy("user_id", F.col("label").alias("area")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    out = aoi.nearest_hit(e, means, KEY, ["event_id"], ["sx", "sy", "sz"], ["x", "y", "z"], radius=F.lit(20.0))
    return out.select("user_id", "event_id", "hit_area", F.round("hit_at", 6).alias("hit_at"))


HEX = E + """, a AS (SELECT label, (sqrt(3.0) / 3 * x - y / 3) / 25.0 AS q, (2.0 / 3 * y) / 25.0 AS r FROM e), b AS (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM a), c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM b)
SELECT label, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r, count(*) AS n FROM c GROUP BY ALL"""


@query(HEX)
def q_hex_bins(spark, d):
    return aoi.hex_bins(samples(spark, d), ["label"], "x", "y", 25.0)


@query(E + """, o AS (SELECT label, user_id, CAST(floor(x / 50.0) AS BIGINT) AS vx, CAST(floor(y / 25.0) AS BIGINT) AS vy, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY label, user_id)::DOUBLE AS p FROM o), m AS (SELECT label, count(DISTINCT user_id) AS m FROM e GROUP BY 1)
SELECT label, vx, vy, round(sum(p) / m, 6) AS p FROM (SELECT label, vx * 1 AS vx, vy, p FROM (SELECT label, user_id, CAST(vx AS BIGINT) AS vx, vy, p FROM p)) JOIN m USING (label) GROUP BY label, vx, vy, m""")
def q_voxel_hist(spark, d):
    e = samples(spark, d).withColumn("y", F.col("y") * 2)
    return aoi.voxel_shares(e, ["label"], KEY, ["x", "y"], 50.0).select("label", "vx", "vy", F.round("p", 6).alias("p"))


@query()
def q_voxel_blur(spark, d):
    v = aoi.voxel_shares(samples(spark, d), ["label"], KEY, ["x", "y"], 50.0)
    return aoi.blur_voxels(v, ["label"], ["x", "y"], 1.0).withColumn("p", F.round("p", 6))


@query(E + " SELECT user_id, round(sum(dur * exp(-((x - 50) * (x - 50) + (y - 50) * (y - 50)) / (2 * 30.0 * 30.0))), 6) AS gauss_dwell, round(median(CASE WHEN sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)) <= 100 THEN sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)) END), 6) AS distance_median FROM e GROUP BY 1")
def q_gaze_distance(spark, d):
    far = geo.distance([F.col("x"), F.col("y")], [F.lit(50.0), F.lit(50.0)])
    return episodes(spark, d).groupBy("user_id").agg(F.round(F.sum(F.col("dur") * geo.gaussian_score(far, 30.0)), 6).alias("gauss_dwell"), F.round(F.median(F.when(far <= 100, far)), 6).alias("distance_median"))


@query(E + f""", q0 AS (SELECT *, lag(t) {W} AS before, CASE WHEN lag(missing) {W} = missing THEN 0 ELSE 1 END AS fresh FROM e), q1 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM q0), q2 AS (SELECT user_id, run, min_by(coalesce(before, t), t * 1000000 + event_id) AS a, max(t) AS b FROM q1 GROUP BY ALL),
b AS (SELECT q1.user_id, q1.event_id, q1.t, q1.missing, CASE WHEN missing = 1 AND b - a >= 86400000 THEN 1 ELSE 0 END AS blink FROM q1 JOIN q2 USING (user_id, run)), s AS (SELECT *, CASE WHEN blink = 1 AND coalesce(lag(blink) {W}, 0) <> 1 THEN 1 ELSE 0 END AS st FROM b)
SELECT user_id, sum(st)::BIGINT AS n_blinks, sum(blink)::BIGINT AS blink_rows, sum(CASE WHEN missing = 1 AND blink = 0 THEN 1 ELSE 0 END)::BIGINT AS technical_rows FROM s GROUP BY 1""")
def q_blinks(spark, d):
    b = cleaning.blinks(samples(spark, d), KEY, ORDER, "missing", least=24 * HOUR)
    b = islands.run_edges(b, KEY, ORDER, "blink")
    return b.groupBy("user_id").agg(F.sum("run_start").cast("long").alias("n_blinks"), F.sum("blink").cast("long").alias("blink_rows"), F.sum("technical").cast("long").alias("technical_rows"))


@query(E + f", c AS (SELECT user_id, count(*) AS n, sum(CASE WHEN missing = 1 THEN step ELSE 0 END) / nullif(sum(step), 0)::DOUBLE AS share FROM (SELECT *, t - lag(t) {W} AS step FROM e) GROUP BY 1) SELECT user_id, event_id FROM e WHERE user_id IN (SELECT user_id FROM c WHERE n >= 10 AND coalesce(share, 0) <= 0.2)")
def q_usable_sequences(spark, d):
    return cleaning.usable_sequences(samples(spark, d), KEY, ORDER, "missing", most_missing=0.2).select("user_id", "event_id")


@query()
def q_impute_blinks(spark, d):
    b = cleaning.blinks(samples(spark, d), KEY, ORDER, "missing", least=HOUR).withColumns({f"h{c}": F.lit(0.0) for c in "xyz"})
    out = signal.impute_blinks(b.drop("missing"), KEY, ORDER, "t", "blink", ["x", "y", "z"], ["hx", "hy", "hz"], "label", most=200 * HOUR, near=40 * HOUR, moved=0.5)
    return out.select("user_id", "event_id", "imputed", "missing", *r6("x", "y", "z"))


@query()
def q_butter_filter(spark, d):
    e = timecourse.time_bins(samples(spark, d), KEY, "t", HOUR, None, "hour")
    e = islands.first_of_duplicates(e, ["user_id", "hour"], ["event_id"])
    out = signal.filter_channels(e, KEY, ["hour"], "hour", {"x": {"cutoff": 40, "median": 41, "mean": 41}})
    return out.select("user_id", "event_id", F.round("x", 6).alias("x"))


@query()
def q_upsample_grid(spark, d):
    e = timecourse.time_bins(samples(spark, d), KEY, "t", HOUR, None, "hour")
    e = islands.first_of_duplicates(e, ["user_id", "hour"], ["event_id"]).select("user_id", "hour", "x")
    return signal.upsample_rows(e, KEY, ["hour"], "hour", ["x"]).withColumn("x", F.round("x", 6))


@query()
def q_time_split_repair(spark, d):
    e = samples(spark, d).withColumn("frame", F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER)))
    broken = e.withColumn("t", F.when(F.col("frame") > 20, F.col("t") - 10_000 * HOUR).otherwise(F.col("t")))
    return cleaning.repair_time_splits(broken, KEY, "frame", "t", jump=1000 * HOUR).select("user_id", "event_id", "t")


