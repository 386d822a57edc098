"""Files in and out: manifests of recordings, positional CSV, event logs, score texts, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of recording in file names. Fixed values of the format.
KINDS = ("AllGazeData", "TrialGazeData", "TrialInfo", "ObjectPositions", "EventLog")


def manifest(spark: SparkSession, folder: str, *, kinds: Sequence[str] = KINDS, pattern: str = r"^([0-9]+)_?([rp])([0-9])") -> DataFrame:
    """(path, name, pid, phase, block, kind, appendix) of a folder's CSV files; a file of no known kind is left out.

    Only names are read: `binaryFile` lists without opening when its content isn't selected.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.csv$", "")
    kind = F.coalesce(*[F.when(F.col("name").contains(k), k) for k in kinds])
    out = files.withColumn("name", name).withColumns({"pid": F.regexp_extract("name", pattern, 1), "phase": F.regexp_extract("name", pattern, 2), "block": F.regexp_extract("name", pattern, 3).try_cast("int")})
    return out.withColumn("kind", kind).where("kind is not null").withColumn("appendix", F.regexp_extract("name", r"[-_ (]([0-9]+)\)?$", 1))


def resolve_versions(files: DataFrame, on_conflict: str = "first") -> DataFrame:
    """One file for each participant, phase, block and kind.

    `first` keeps the least appendix, `last` the greatest, `skip_block` drops blocks and `skip_participant`
    participants that have versions.
    """
    files = files.dropDuplicates(["name"])
    key = ["pid", "phase", "block", "kind"]
    number = F.coalesce(F.col("appendix").try_cast("int"), F.lit(0))
    if on_conflict in ("first", "last"):
        order = number.asc() if on_conflict == "first" else number.desc()
        return files.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order, "name"))).where("_n = 1").drop("_n")
    scope = ["pid", "phase", "block"] if on_conflict == "skip_block" else ["pid"]
    several = files.groupBy(*key).count().where("count > 1").select(*scope).distinct()
    return files.join(several, scope, "left_anti")


def positional_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, **options) -> DataFrame:
    """CSV read by position: the header's names are ignored, missing files of a list are an error."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def gaze_schema(channels: Sequence[str]) -> T.StructType:
    """Positional schema of a gaze file: time stamps, frames and labels by name, all other channels doubles."""
    kinds = {"EyeTimestamp": T.LongType(), "EyeFrameSequence": T.IntegerType(), "FrameCount": T.IntegerType(), "Object": T.StringType(), "Trial": T.IntegerType(), "ViewNo": T.IntegerType(), "Object_notable": T.StringType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in channels])


def gaze_rows(raw: DataFrame, ids: dict[str, object], keep: Sequence[str], epoch: Column | str = "na") -> DataFrame:
    """The columns of a gaze table from a positional read: the ids as constants or columns, the epoch, and the channels to keep, in this order."""
    fixed = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in ids.items()]
    return raw.select(*fixed, (epoch if isinstance(epoch, Column) else F.lit(epoch)).alias("epoch"), *keep)


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """`df` with an increasing number by file and place in it, for files whose rows have no key; unique, and in order within a file."""
    return df.withColumn(name, F.monotonically_increasing_id())


def truncated(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int = 8_000) -> DataFrame:
    """The first rows of each of `by` (a file, a block): samples for tests."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= rows).drop("_n")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """(time, frame, event): the first three columns of a log."""
    raw = spark.read.option("header", True).csv(path)
    a, b, c = raw.columns[:3]
    return raw.select(F.col(f"`{a}`").try_cast("double").alias("time"), F.col(f"`{b}`").try_cast("long").alias("frame"), F.col(f"`{c}`").alias("event"))


def score_text(spark: SparkSession, path: str, *, header_lines: int = 14) -> DataFrame:
    """(file, item, selection, rt, score) of tab-separated score files; a row of three fields is timed out."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value"), F.col("_metadata.file_block_start").alias("_at"))
    numbered = lines.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(F.monotonically_increasing_id())))
    parts = numbered.where(F.col("_n") > header_lines).withColumn("p", F.split(F.trim("value"), r"\t+")).where(F.size("p") >= 2)
    full = F.size("p") >= 4
    return parts.select("file", F.get("p", F.lit(0)).alias("item"), F.when(full, F.get("p", F.lit(1))).otherwise("TIMED").alias("selection"), F.when(full, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(1))).try_cast("double").alias("rt"), F.when(full, F.get("p", F.lit(3))).otherwise("INCORRECT").alias("score"))


def participants(spark: SparkSession, path: str, study: str, key: str = "pid") -> DataFrame:
    """A participant table whose key is led by the study's name."""
    return spark.read.option("header", True).csv(path).withColumn(key, F.concat(F.lit(f"{study}_"), F.col(key)))


def database_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of an external database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_table(df: DataFrame, path: str, *, by: Sequence[str] = (), mode: str = "append") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Append the rows whose key the table at `path` doesn't have yet; the rows that were appended."""
    try:
        old = spark.read.parquet(path).select(key)
        new = df.join(old, key, "left_anti")
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        new = df
    write_table(new, path, by=by)
    return new


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose key it doesn't have; columns that one side lacks are null there."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def add_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """`df` with null columns of the given types where it has none of the name."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})
