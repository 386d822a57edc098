"""Scans, filters, joins, reshapes and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintspan.operators import relational as rel
from glintspan.sources.files import add_columns, delete_keys, upsert

from .base import E, KEY, query, samples, table

ORDER_STATUS = ("F", "O", "P")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag IN ('A', 'R')")
def q_scan_filter_project(spark, d):
    return rel.keep_conditions(table(spark, d, "lineitem").where("l_quantity > 45"), "l_returnflag", ["A", "R"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT DISTINCT c_mktsegment FROM customer")
def q_single_column(spark, d):
    return table(spark, d, "customer").select("c_mktsegment").distinct()


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))) GROUP BY 1")
def q_semi_chain(spark, d):
    nation = table(spark, d, "nation").where("n_regionkey = 1")
    lines = rel.semi_chain(table(spark, d, "lineitem"), (table(spark, d, "orders"), "l_orderkey", "o_orderkey"), (table(spark, d, "customer"), "o_custkey", "c_custkey"), (nation, "c_nationkey", "n_nationkey"))
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q_anti_missing(spark, d):
    return rel.missing_from(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def q_orphans(spark, d):
    return rel.referenced(table(spark, d, "lineitem"), table(spark, d, "orders"), "l_orderkey", "o_orderkey").agg(F.count("*").alias("orphans"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IS NULL OR NOT (o_orderkey BETWEEN 55 AND 63)")
def q_outside_range(spark, d):
    return rel.outside_range(table(spark, d, "orders"), "o_orderkey", 55, 63).select("o_orderkey")


@query("SELECT c_custkey, coalesce(CAST(n_name AS VARCHAR), 'NA') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def q_lookup_join(spark, d):
    nation = table(spark, d, "nation").where("n_nationkey < 20")
    return rel.lookup(table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), nation, "n_nationkey", "n_name").select("c_custkey", "n_name")


@query("""SELECT coalesce(k1, k2) AS custkey, n_orders, n_lines FROM (SELECT o_custkey AS k1, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
FULL JOIN (SELECT o_custkey AS k2, count(*) AS n_lines FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b ON k1 = k2""")
def q_full_outer_rollup(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n_orders"))
    b = o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n_lines"))
    return a.join(b, "custkey", "full")


@query(E + """, g AS (SELECT user_id, side, count(*) AS n, round(avg(x), 6) AS m FROM e GROUP BY ALL)
SELECT user_id, max(CASE WHEN side = 'enc' THEN n END) AS n_enc, max(CASE WHEN side = 'ret' THEN n END) AS n_ret, max(CASE WHEN side = 'enc' THEN m END) AS m_enc, max(CASE WHEN side = 'ret' THEN m END) AS m_ret,
 max(CASE WHEN side = 'ret' THEN n END) - max(CASE WHEN side = 'enc' THEN n END) AS n_diff, round(max(CASE WHEN side = 'ret' THEN m END) - max(CASE WHEN side = 'enc' THEN m END), 6) AS m_diff FROM g GROUP BY user_id""")
def q_enc_ret_diff(spark, d):
    from glintspan.operators.compare import paired

    g = samples(spark, d).groupBy("user_id", "side").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("m"))
    return paired(g, KEY, "side", ["n", "m"]).withColumn("m_diff", F.round("m_diff", 6))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n_rows, round(sum(l_quantity), 4) AS l_quantity_sum, round(avg(l_discount), 6) AS l_discount_mean, round(median(l_extendedprice), 6) AS l_extendedprice_median FROM lineitem GROUP BY ALL")
def q_group_rollup(spark, d):
    out = rel.rollup_groups(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"], ["l_discount"], ["l_extendedprice"], at_least=2)
    return out.withColumns({"l_quantity_sum": F.round("l_quantity_sum", 4), "l_discount_mean": F.round("l_discount_mean", 6), "l_extendedprice_median": F.round("l_extendedprice_median", 6)})


@query("SELECT o_custkey AS custkey, o_orderstatus AS cond, count(*) AS n_trials, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_correct, round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*)::DOUBLE, 6) AS p_correct, round(avg(nullif(o_totalprice, -999.0)), 6) AS mean_confidence FROM orders GROUP BY ALL")
def q_condition_rollup(spark, d):
    from .registry import group_features

    o = table(spark, d, "orders").withColumn("urgent", F.lit("1-URGENT"))
    out = group_features().evaluate(o, ["o_custkey", "o_orderstatus"], {"truth": "o_orderpriority", "answer": "urgent", "confidence": "o_totalprice"})
    return out.select(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("cond"), "n_trials", "n_correct", F.round("p_correct", 6).alias("p_correct"), F.round("mean_confidence", 6).alias("mean_confidence"))


@query("SELECT o_custkey, CASE WHEN count(*) >= 5 THEN round(median(o_totalprice), 6) END AS price_median, count(*) AS n_trials FROM orders GROUP BY 1")
def q_condition_median(spark, d):
    from .pipeline import condition_medians

    out = condition_medians(table(spark, d, "orders").withColumnRenamed("o_totalprice", "price"), ["o_custkey"], ["price"], at_least=5)
    return out.withColumn("price_median", F.round("price_median", 6))


@query("SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS price_F, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS price_O, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS price_P FROM orders GROUP BY 1")
def q_pivot_wide(spark, d):
    out = rel.wide(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ORDER_STATUS, F.sum("o_totalprice"), "price_")
    return out.select("o_custkey", *[F.round(f"price_{s}", 2).alias(f"price_{s}") for s in ORDER_STATUS])


@query("SELECT l_orderkey, l_partkey, feature, value FROM (UNPIVOT (SELECT l_orderkey, l_partkey, l_quantity AS quantity, l_tax AS tax FROM lineitem) ON quantity, tax INTO NAME feature VALUE value)")
def q_unpivot_long(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return rel.long(rows, ["l_orderkey", "l_partkey"], ["quantity", "tax"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS f_urgent, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS o_low FROM orders")
def q_onehot_conditions(spark, d):
    o = rel.one_hot(table(spark, d, "orders"), {"f_urgent": (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), "o_low": (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW")})
    return o.select("o_orderkey", "f_urgent", "o_low")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v1, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 2 AS v2 FROM events")
def q_from_json_split(spark, d):
    k = F.get_json_object("props", "$.k")
    rows = table(spark, d, "events").withColumn("list", F.concat(F.lit("["), k, F.lit(", "), (k.cast("int") * 2).cast("string"), F.lit("]")))
    return rel.json_columns(rows, "list", ["v1", "v2"]).select("event_id", "v1", "v2")


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS priority, CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) AS code FROM orders")
def q_split_label(spark, d):
    p = F.split("o_orderpriority", "-", 2)
    return table(spark, d, "orders").select("o_orderkey", F.get(p, F.lit(1)).alias("priority"), F.get(p, F.lit(0)).cast("long").alias("code"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN l_quantity WHEN 1 THEN l_tax ELSE l_discount END AS picked FROM lineitem")
def q_pick_by_index(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rel.pick_by_index(["l_quantity", "l_tax", "l_discount"], (F.col("l_linenumber") % 3 + 1).cast("int")).alias("picked"))


@query("SELECT o_custkey, o_orderkey, CAST(rank AS BIGINT) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def q_top_k(spark, d):
    return rel.top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE (n - 1) % 4 = 0")
def q_every_kth(spark, d):
    return rel.every_kth(table(spark, d, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query("SELECT a.c_mktsegment AS a, b.c_mktsegment AS b FROM (SELECT DISTINCT c_mktsegment FROM customer) a JOIN (SELECT DISTINCT c_mktsegment FROM customer) b ON a.c_mktsegment < b.c_mktsegment")
def q_all_pairs_groups(spark, d):
    return rel.pairs_of_groups(table(spark, d, "customer"), "c_mktsegment")


@query("""WITH p AS (SELECT a.vec_id, b.vec_id AS nearest, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT vec_id, nearest, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS n FROM p) WHERE n = 1""")
def q_nearest_neighbour(spark, d):
    return rel.nearest_of_group(table(spark, d, "embeddings"), "vec_id", "label", "embedding")


@query("SELECT c_mktsegment AS \"group\", count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END), 6) AS p_negative, round(avg(c_acctbal), 6) AS mean, round(avg(c_acctbal) - stddev_pop(c_acctbal) / sqrt(count(c_acctbal)), 6) AS low, round(avg(c_acctbal) + stddev_pop(c_acctbal) / sqrt(count(c_acctbal)), 6) AS high FROM customer GROUP BY 1")
def q_descriptives(spark, d):
    from glintspan.operators.timecourse import mean_band

    c = table(spark, d, "customer").withColumnRenamed("c_mktsegment", "group")
    own = c.groupBy("group").agg(F.count_distinct("c_nationkey").alias("nations"), F.round(F.avg((F.col("c_acctbal") < 0).cast("double")), 6).alias("p_negative"))
    band = mean_band(c, ["group"], "c_acctbal")
    return band.join(own, "group").select("group", "n", "nations", "p_negative", *[F.round(x, 6).alias(x) for x in ("mean", "low", "high")])


@query("SELECT l_linenumber::BIGINT AS k, count(*) AS n, any_value(l_linenumber)::BIGINT AS first_k FROM lineitem GROUP BY 1")
def q_value_counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("k")).agg(F.count("*").alias("n"), F.min("l_linenumber").cast("long").alias("first_k"))


@query("SELECT l_returnflag, a, b, round(r, 6) AS r FROM (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r, 'l_quantity' AS a, 'l_extendedprice' AS b FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, corr(l_quantity, l_discount), 'l_quantity', 'l_discount' FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, corr(l_extendedprice, l_discount), 'l_extendedprice', 'l_discount' FROM lineitem GROUP BY 1)")
def q_corr_matrix_long(spark, d):
    from glintspan.operators.statistics import correlations

    return correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"]).withColumn("r", F.round("r", 6))


@query("SELECT l_returnflag, round(median(l_quantity), 6) AS centre, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) AS spread, round((median(l_quantity) + median(l_tax)) / 2, 6) AS both_centre FROM lineitem GROUP BY 1")
def q_median_iqr(spark, d):
    from .registry import pupil_features

    out = pupil_features("l_quantity", "l_tax").evaluate(table(spark, d, "lineitem"), ["l_returnflag"], {}, ["pupil_diam_centre"])
    own = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.median("l_quantity"), 6).alias("centre"), F.round(F.percentile("l_quantity", 0.75) - F.percentile("l_quantity", 0.25), 6).alias("spread"))
    return own.join(out, "l_returnflag").select("l_returnflag", "centre", "spread", F.round("pupil_diam_centre", 6).alias("both_centre"))


@query("SELECT c_custkey, c_acctbal AS value, CASE WHEN c_acctbal IS NULL THEN 'null' WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal > 5000 THEN 'high' ELSE 'ok' END AS status, CASE WHEN c_acctbal < 0 THEN -999.0 WHEN c_acctbal > 5000 THEN 999.0 ELSE c_acctbal END AS bounded FROM customer")
def q_feature_bounds_status(spark, d):
    from .registry import Registry

    r = Registry()
    r.register("balance", lambda c: F.max(c["balance"]), "double", 0, 5000)
    c = r.evaluate(table(spark, d, "customer"), ["c_custkey"], {"balance": "c_acctbal"})
    return r.status(c, ["c_custkey"]).join(r.bounded(c).withColumnRenamed("balance", "bounded"), "c_custkey").select("c_custkey", "value", "status", "bounded")


@query(E + """, w AS (SELECT user_id, max(CASE WHEN label = 'click' AND x > 480 THEN x END) AS f_click, max(CASE WHEN label = 'view' AND x > 400 THEN x END) AS f_view FROM e GROUP BY 1)
SELECT needs, count(*) AS n, min(user_id) AS first_key FROM (SELECT user_id, concat_ws(',', CASE WHEN f_click IS NULL THEN 'f_click' END, CASE WHEN f_view IS NULL THEN 'f_view' END) AS needs FROM w) WHERE needs <> '' GROUP BY 1""")
def q_need_matrix(spark, d):
    from .pipeline import batches, needs

    big = lambda name, least: F.max(F.when((F.col("label") == name) & (F.col("x") > least), F.col("x")))
    w = samples(spark, d).groupBy("user_id").agg(big("click", 480).alias("f_click"), big("view", 400).alias("f_view"))
    return batches(needs(w, "user_id", ["f_click", "f_view"]), "user_id")


@query(E + " SELECT user_id, count(*) AS n, round(sum(x), 4) AS total FROM e GROUP BY 1")
def q_incremental_antijoin(spark, d):
    from .pipeline import recompute

    e = samples(spark, d)
    compute = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))
    return recompute(compute(e.where("user_id % 3 = 0")), e, ["user_id"], compute)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS status, CAST(NULL AS DOUBLE) AS score FROM orders WHERE o_orderkey % 10 <> 1")
def q_upsert_delete(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = o.where("o_orderkey % 10 = 0").withColumn("status", F.lit("new"))
    return add_columns(delete_keys(upsert(o, new, ["o_orderkey"]), o.where("o_orderkey % 10 = 1"), "o_orderkey"), {"score": "double"})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey + (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F'), o_custkey FROM orders WHERE o_orderstatus = 'P'")
def q_session_stitch(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return rel.stitch(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'P'").drop("o_orderstatus"), ["o_orderkey"])


@query("SELECT c_custkey, m.\"move\" AS \"move\", r.rotated AS rotated FROM customer, (VALUES ('Stay'), ('Walk'), ('Teleport')) m(\"move\"), (VALUES (false), (true)) r(rotated)")
def q_condition_rows(spark, d):
    from glintspan.sources.ingest import conditions_of

    return conditions_of(table(spark, d, "customer"), "c_custkey").select("c_custkey", "move", "rotated")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'bc' ELSE v.view END AS view FROM orders, (VALUES ('enc'), ('ret')) v(view) WHERE o_orderkey % 7 <> 0 OR v.view = 'enc'")
def q_viewing_rows(spark, d):
    from glintspan.sources.ingest import viewings_of_trials

    return viewings_of_trials(table(spark, d, "orders"), "o_orderkey", F.col("o_orderkey") % 7 == 0).select("o_orderkey", "view")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'na' WHEN 1 THEN 'na' WHEN 2 THEN 'view' ELSE 'full' END AS epoch, CASE l_linenumber % 3 WHEN 0 THEN 'Walk' WHEN 1 THEN 'Teleport' ELSE 'Stay' END AS \"move\" FROM lineitem")
def q_code_decode(spark, d):
    from glintspan.sources import ingest

    no = lambda: F.lit(0)
    view = ingest.view_class((F.col("l_linenumber") % 4).cast("int"), no(), F.lit(False), no(), no())
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ingest.epoch(view).alias("epoch"), ingest.move_type((F.col("l_linenumber") % 3 + 1).cast("int")).alias("move"))


@query("SELECT label, count(*) AS n, round(avg((x - m) / s), 6) + 0.0 AS z_mean, round(stddev_pop((x - m) / s), 6) AS z_sd FROM (SELECT event_type AS label, value AS x, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS s FROM events) GROUP BY 1")
def q_z_scores(spark, d):
    from glintspan.operators.statistics import z_scores

    z = z_scores(samples(spark, d).select("label", "x"), ["x"], ["label"])
    return z.groupBy("label").agg(F.count("*").alias("n"), (F.round(F.avg("x"), 6) + 0.0).alias("z_mean"), F.round(F.stddev_pop("x"), 6).alias("z_sd"))

