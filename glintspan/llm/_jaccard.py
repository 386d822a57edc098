"""Exact Jaccard similarity of sets of 64-bit hashes that are kept as sorted bytes: by pairs, and among the members of a key in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import in_arrow

#: Members and hashes of a block, about.
BLOCK_SETS, BLOCK_HASHES = 256, 65_536
_COLUMNS = 4_096


def linked_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets (u, s) have a similarity of num / den or more."""

    def run(it):
        for batch in it:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True)) if den * min(len(p), len(q)) >= num * max(len(p), len(q)) else 0
                keep.append(both > 0 and den * both >= num * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("u").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("u").alias("b"), F.col("s").alias("sb")), "b")
    return in_arrow(both.select("a", "b", "sa", "sb"), run, "a long, b long")


def _block(column: pa.ListArray, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, components, sizes and sets of a block."""
    rows = column[g].values
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.field("s")]
    return rows.field("u").to_numpy(), rows.field("c").to_numpy(), np.array([len(s) for s in sets], np.int64), sets


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share, by products of some columns at a time."""
    value = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, at, often = np.unique(value, return_inverse=True, return_counts=True)
    keep = often[at] > 1
    column = (np.cumsum(often > 1) - 1)[at[keep]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[keep][order]
    both = np.zeros((len(left), len(right)), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, last, _COLUMNS):
        x = slice(*np.searchsorted(column, [lo, lo + _COLUMNS]))
        m = np.zeros((len(left) + len(right), min(_COLUMNS, last - lo)), np.float32)
        m[owner[x], column[x] - lo] = 1
        both += m[: len(left)] @ m[len(left) :].T
    return both


def _ties(num: int, den: int):
    """Links that tie the members of two blocks which are in different components; a block may be paired with itself."""

    def run(it):
        for batch in it:
            ties: list[tuple[int, int]] = []
            for g in range(len(batch)):
                (ia, ca, na, sa), (ib, cb, nb, sb) = (_block(batch.column(c), g) for c in ("x", "y"))
                both = _shared(sa, sb)
                i, j = np.nonzero((both > 0) & (den * both >= num * (na[:, None] + nb[None, :] - both)) & (ca[:, None] != cb[None, :]))
                tie: dict[int, int] = {}

                def root(x: int) -> int:
                    while tie.setdefault(x, x) != x:
                        tie[x] = tie[tie[x]]
                        x = tie[x]
                    return x

                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = root(int(ca[a])), root(int(cb[b]))
                    if x != y:
                        tie[x] = y
                        ties.append((int(ia[a]), int(ib[b])))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in ties], pa.int64()), pa.array([b for _, b in ties], pa.int64())], names=["a", "b"])

    return run


def links_within(posts: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that tie the members of each key as far as they link: posts (key, u, c: component so far), sets (u, s).

    A key's members are dealt into blocks, each with its sets once; each pair of blocks is a row that any task can
    judge. No pair of members is a row.
    """
    sized = posts.join(sets.select("u", "s"), "u").withColumn("size", F.octet_length("s") / 8)
    many = sized.groupBy("key").agg(F.count("*").alias("m"), F.sum("size").alias("size")).where("m > 1")
    many = many.select("key", F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("size") / BLOCK_HASHES)).cast("int").alias("parts"))
    dealt = sized.join(many, "key").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
    blocks = dealt.groupBy("key", "part").agg(F.collect_list(F.struct("u", "c", "s")).alias("members"))
    pairs = many.select("key", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")).select("key", "p", F.explode(F.sequence("p", F.col("parts") - 1)).alias("q"))
    x = blocks.select("key", F.col("part").alias("p"), F.col("members").alias("x"))
    y = blocks.select("key", F.col("part").alias("q"), F.col("members").alias("y"))
    return in_arrow(pairs.join(x, ["key", "p"]).join(y, ["key", "q"]).select("x", "y"), _ties(num, den), "a long, b long")
