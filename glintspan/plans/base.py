"""Tables of the catalogue, and the register of its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEY, ORDER = ["user_id"], ["t", "event_id"]
HOUR = 3_600_000
LABELS = ["click", "error", "purchase", "signup", "view"]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of one sequence a user: t in ms, a label, a point, a missing flag, and the half of the period."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("t"), F.col("event_type").alias("label"), F.col("value").alias("x"), k.alias("y"), (F.col("value") * k / 100).alias("z"),
        (F.col("event_type") == "error").cast("int").alias("missing"), F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "enc").otherwise("ret").alias("side"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that last until the next one of their sequence: t_end, and dur in hours."""
    from pyspark.sql import Window

    nxt = F.lead("t").over(Window.partitionBy(*KEY).orderBy(*ORDER))
    return samples(spark, sf_dir).withColumn("t_end", F.coalesce(nxt, F.col("t"))).withColumn("dur", (F.col("t_end") - F.col("t")) / HOUR)


#: The same tables in SQL.
E = """WITH ev0 AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, event_type AS label, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, value * CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS z,
 CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS missing, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'enc' ELSE 'ret' END AS side FROM events),
e AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t) AS t_end, (coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t) - t) / 3600000.0::DOUBLE AS dur FROM ev0)"""
#: Runs of a label of each user: first and last time, rows.
R = E + """, r0 AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY user_id ORDER BY t, event_id) = label THEN 0 ELSE 1 END AS fresh FROM e),
r1 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r0),
r AS (SELECT user_id, CAST(run AS BIGINT) AS run, label, count(*) AS n, min(t) AS "start", max(t_end) AS "end", (max(t_end) - min(t)) AS duration, sum(x * (t_end - t)) / nullif(sum(t_end - t), 0) AS wx, avg(x) AS ax FROM r1 GROUP BY user_id, run, label)"""
#: Steps between runs, with joint and conditional shares.
T = R + """, st AS (SELECT user_id, label AS from_label, lead(label) OVER (PARTITION BY user_id ORDER BY run) AS to_label FROM r),
tc AS (SELECT user_id, from_label, to_label, count(*) AS n FROM st WHERE to_label IS NOT NULL GROUP BY ALL),
tp AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS p_joint, n / sum(n) OVER (PARTITION BY user_id, from_label)::DOUBLE AS p_cond FROM tc)"""
