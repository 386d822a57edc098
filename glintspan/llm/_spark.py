"""Session helpers: tables in the shared folder, bitmaps of bounded size, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a membership bitmap: about SPARSE for each key, and from the least to the most (32 MB). A fuller one only lets more rows through to the exact join.
LEAST_BITS, MOST_BITS, SPARSE = 16, 28, 16

#: Bytes of an Arrow batch, and Spark's setting of that with the default that is lowered.
BATCH_BYTES, _BATCH, _DEFAULT_BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, a folder of the warehouse, which executors share as they share managed tables; a session of several machines must name one of the two."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return base.rstrip("/")


def stage(df: DataFrame, name: str, heavy: bool = False) -> DataFrame:
    """Write `df` as a table in the shared folder and read it: lineage ends there, and a lost executor loses nothing. heavy: its shuffles are large, so their files are let go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glintspan-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # Executors drop shuffle files when the driver's handles of them are collected, else some time later: only a hint, and none without a JVM at hand.
    if heavy and (jvm := getattr(getattr(spark, "sparkContext", None), "_jvm", None)) is not None:
        jvm.System.gc()
    staged = spark.read.schema(df.schema).parquet(path)
    staged.glintspan_path = path
    return staged


def discard(*tables: DataFrame) -> None:
    """Put an empty table in the place of each staged table: what nothing will read again takes no room."""
    for t in tables:
        none = t.sparkSession.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema])
        none.write.mode("overwrite").parquet(t.glintspan_path)


def _release() -> None:
    """Give the memory that a task has freed back to the system: workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _small_batches(spark: SparkSession) -> None:
    """Let batches that go to Python hold BATCH_BYTES, unless the session has a limit of its own: ten thousand texts can be a hundred MB, in the JVM and in Python at once."""
    if spark.conf.get(_BATCH, None) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema), whose tasks give back their memory. One kind of Python task for all operators lets executors keep one set of workers."""

    def task(it):
        yield from run(it)
        _release()

    _small_batches(df.sparkSession)
    return df.mapInArrow(task, schema)


def with_arrow(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], read: Sequence[Column], added: str) -> DataFrame:
    """`df` with the columns `added` (a schema), which `make` gives for batches of the columns `read`, there named r0, r1 and so on. A column of `df` of an added name is replaced."""
    new = T.StructType.fromDDL(added)
    df = df.drop(*new.names)
    n = len(df.columns)
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], *[c.alias(f"r{i}") for i, c in enumerate(read)])
    kept = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)])

    def run(it):
        for batch in it:
            made = make(pa.RecordBatch.from_arrays(batch.columns[n:], names=batch.schema.names[n:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*batch.schema.names[:n], *new.names])

    out = in_arrow(rows, run, T.StructType([*kept, *new]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], *new.names)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or as many underscores behind it as make it differ from every column of `df` (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hint_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of at most `rows` narrow rows; a larger one is left to the planner's shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Bitmap(NamedTuple):
    """A broadcast bitmap of 2**bits bits."""

    raw: Broadcast
    bits: int

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key (64-bit) has its bit set: so have all that it was made from, and some others."""
        at = keys.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (np.frombuffer(self.raw.value, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(df: DataFrame, key: str) -> Bitmap:
    """A bitmap of the low bits of the long column `key`, of the size that the number of rows asks for, within limits."""
    bits = int(min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(SPARSE * max(df.count(), 1))))))
    bit = F.col(key).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1)
    rows = (
        df.where(F.col(key).isNotNull()).select(bit.alias("p"))
        .groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("map"))
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["map"]), np.uint8)[: out.size - at]
    return Bitmap(df.sparkSession.sparkContext.broadcast(out.tobytes()), bits)
