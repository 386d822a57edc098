"""Mixing sources to target weights. Built-in functions only: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import hint_small, stage, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Sources of a table that is broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
_UNIT = 1 << 52
#: The columns that mix_sources adds.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def _draw(seed: int, *cols: str) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the columns' text."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(_UNIT))


def source_targets(sizes: DataFrame, *, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A
    target is at most `most` times its source's size; what is cut goes to the others by weight, until none is
    above. That is a level: each target is the smaller of its cap and level times weight, and the sources
    that are cut are those of the smallest cap a weight. Sources of size 0 have target 0. The order is one of
    all sources, in one task: some million sources at most, of which each is one narrow row. No rows in, none out.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # One row per source from here: a single ordered list of sources is the feature, not of documents.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("cut", F.col("cap") <= F.col("weight") * F.col("level")).withColumn("pos", F.row_number().over(by_cap))
    # From the first source that isn't cut on, none is: its level is the level of all of them.
    final = F.min(F.when(~F.col("cut"), F.struct("pos", "level"))).over(whole)["level"]
    return leveled.withColumn("target", F.when(F.col("cut"), F.col("cap")).otherwise(F.col("weight") * final)).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The rows of `docs` with four more columns: mix_size, mix_source_size, mix_target and mix_copies.

    Size is the number of words `[^\\x20\\x09-\\x0D]+` (null text: 0). A row's rate is its source's target over its
    source's size; it is emitted floor(rate) times plus once more with probability rate - floor(rate), drawn
    from a hash of the seed, source and id, so that reruns agree and no row is taken more than ceil(most)
    times. Null sources are a source. Rows that repeat an id share its draw; null ids share one draw a source. No
    rows in, none out. A column of `docs` that is named like one of the four is replaced; others stay.
    """
    docs = docs.drop(*ADDED)
    key = unused(docs, "mix_key")
    # No text's count leaves the scan; sums are formed before the shuffle, so a hot source sends a row a task.
    sized = docs.withColumn("mix_size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
    targets = stage(source_targets(sized.select(F.col(source_col).cast("string").alias("source"), F.col("mix_size").alias("size")), weights=weights, most=most), "targets")
    targets = targets.select(F.col("source").alias(key), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    out = sized.join(hint_small(targets, BROADCAST_SOURCES), F.col(source_col).cast("string").eqNullSafe(F.col(key)), "left").drop(key)
    rate = F.least(F.lit(float(most)), F.coalesce(F.col("mix_target") / F.expr("nullif(mix_source_size, 0)"), F.lit(0.0)))
    copies = F.floor(rate) + F.when(_draw(seed, source_col, id_col) < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn("mix_copies", copies.cast("long"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of mix_sources as often as mix_copies says, without the four columns that it added; rows of no or null copies go. Nulls, empty texts and repeated rows are rows like others. No rows in, none out."""
    own = [c for c in mixed.columns if c not in ADDED]
    copy = unused(mixed, "mix_copy")
    return mixed.where("mix_copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*own)


#: The query's result by SQL: the same level by the same ordered sums.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM p
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM r
), f AS (
  SELECT *, cap <= weight * level AS cut, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS pos FROM l
), t AS (
  SELECT source, source_size, CASE WHEN cut THEN cap ELSE weight * (SELECT min_by(level, pos) FROM f WHERE NOT cut) END AS target FROM f
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(3.0::DOUBLE, coalesce(t.target / nullif(t.source_size, 0), 0.0)) AS rate,
    ('0x' || substr(md5(concat_ws(chr(31), '17', coalesce(d.source, chr(0)), coalesce(CAST(d.doc_id AS VARCHAR), chr(0)))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""
