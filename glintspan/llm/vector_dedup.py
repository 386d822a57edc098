"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine c are at squared distance 2 - 2c. Vectors are rotated at random and split into blocks; if
the whole squared distance is within the budget, that of some block is within the block's share of it, in
proportion to its dimensions. Each block is range-joined: vectors are put in cells of the block's
first coordinates, of twice the radius, and in those neighbour cells that their radius reaches. The more
vectors there are, the more coordinates (two to four) keep the cells about as full. Cells get the block's
coordinates alone, as single floats; whole vectors go only to cells where they have a partner within the
block's share. There a pair is judged exactly, on the original vectors, in the first block that lets it
through, so that it is counted once, and no pair is a row.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._spark import hint_small, in_arrow, stage

#: Dimensions of a block, about.
BLOCK = 8
#: Members of a cell that are compared in one task; a fuller cell is dealt out as pairs of parts of it.
PART = 4096
#: Rows of a cell that are compared at a time, with those within the radius of them in one coordinate.
RUN = 256
#: Coordinates that make a cell: from the least on, one more for each factor of SPREAD in the number of vectors.
LEAST_AXES, MOST_AXES, SPREAD = 2, 4, 6
#: Widest table of full cells that is broadcast; a larger one is joined by a shuffle.
BROADCAST_CELLS = 50_000
#: Absolute slack of the distances, far above rounding and far below any distance that decides.
_SLACK = 1e-9
#: The same for coordinates in single precision.
_COARSE = 1e-6
#: Parts into which the copies of one vector are dealt when they get its result.
SALTS = 62


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(6).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _blocks(dim: int) -> list[slice]:
    n = max(1, round(dim / BLOCK))
    cuts = np.linspace(0, dim, n + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    v = flat.reshape(-1, dim).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


_AT = [f"c{i}" for i in range(MOST_AXES)]


def _axes(n: int) -> int:
    return int(min(MOST_AXES, max(LEAST_AXES, math.ceil(math.log(max(n, 1) / (4 * PART), SPREAD)))))


def _cells(budget: float, axes: int):
    """(dim, label, block, c0.., home, id, h, x) for the cells of each vector, home and visited; x: its coordinates in the block."""

    def run(it):
        for batch in it:
            dims = np.array([len(x) for x in batch.column("v")], np.int64) if batch.num_rows else np.zeros(0, np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                z = _unit(np.asarray(part.column("v").flatten()), int(dim)) @ _rotation(int(dim))
                for b, cut in enumerate(_blocks(int(dim))):
                    radius = float(np.sqrt(budget * (cut.stop - cut.start) / dim)) + _SLACK
                    first = z[:, cut][:, :axes] / (2 * radius)
                    flat, wide = z[:, cut].astype(np.float32), cut.stop - cut.start
                    cell = np.floor(first).astype(np.int64)
                    side = np.where(first - cell >= 0.5, 1, -1)
                    for chosen in product((0, 1), repeat=first.shape[1]):
                        # One cell of a pair visits the other: of two opposite steps the one whose first part is up.
                        lead = next((i for i, c in enumerate(chosen) if c), None)
                        at = np.arange(len(z)) if lead is None else np.flatnonzero(side[:, lead] > 0)
                        if not len(at):
                            continue
                        to = cell[at] + side[at] * np.array(chosen)
                        to = np.column_stack([to, np.zeros((len(at), MOST_AXES - to.shape[1]), np.int64)])
                        got = part.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), dim, np.int32)), got.column("label"), pa.array(np.full(len(at), b, np.int32)), *(pa.array(to[:, i]) for i in range(MOST_AXES)), pa.array(np.full(len(at), lead is None)), got.column("id"), got.column("h"), pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * wide, flat[at].ravel())],
                            names=["dim", "label", "block", *_AT, "home", "id", "h", "x"],
                        )

    return run


def _near(budget: float):
    """Of one cell or two parts of one: the rows that have a partner within the block's share of the budget."""

    def run(table: pa.Table) -> pa.Table:
        ids, home = table.column("id").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        x = np.asarray(table.column("x").combine_chunks().flatten()).reshape(len(ids), -1).astype(np.float64)
        share = budget * x.shape[1] / table.column("dim")[0].as_py() + _COARSE
        radius, axis = math.sqrt(share), x.shape[1] - 1  # the last coordinate is none of the cell's, if there are enough
        side = table.column("side").to_numpy()
        order = np.argsort(x[:, axis], kind="stable")
        left, right = order[side[order] == 0], order[side[order] == 1]
        if table.column("p")[0] == table.column("q")[0]:
            right = left
        at, squares, hit = x[right, axis], (x**2).sum(1), np.zeros(len(ids), bool)
        for lo in range(0, len(left), RUN):
            a = left[lo : lo + RUN]
            b = right[np.searchsorted(at, x[a[0], axis] - radius, "left") : np.searchsorted(at, x[a[-1], axis] + radius, "right")]
            ok = squares[a][:, None] + squares[b][None, :] - 2 * x[a] @ x[b].T <= share
            ok &= (home[a][:, None] | home[b][None, :]) & (ids[a][:, None] != ids[b][None, :])
            hit[a] |= ok.any(1)
            hit[b] |= ok.any(0)
        return table.drop_columns(["x"]).filter(pa.array(hit))

    return run


def _judge(cosine: float, budget: float):
    """Of one cell or two parts of one: how many vectors each links to, and the smallest id it is tied to here."""

    def run(table: pa.Table) -> pa.Table:
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        side = table.column("side").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        ids, weight = table.column("id").to_numpy(), table.column("n").to_numpy()
        raw = np.asarray(table.column("v").combine_chunks().flatten())
        unit = _unit(raw, dim)
        turned = unit @ _rotation(dim)
        cuts = _blocks(dim)
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        same = table.column("p")[0] == table.column("q")[0]
        right = left if same else right
        links, tie = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def root(i: int) -> int:
            while tie[i] != i:
                tie[i] = tie[tie[i]]
                i = tie[i]
            return i

        for lo in range(0, len(left), 256):
            a = left[lo : lo + 256]
            ok = home[a][:, None] | home[right][None, :]
            if same:
                ok &= a[:, None] < right[None, :]
            ok &= ids[a][:, None] != ids[right][None, :]
            for b, cut in enumerate(cuts[: block + 1]):
                share = budget * (cut.stop - cut.start) / dim + _SLACK
                p, q = turned[a, cut], turned[right, cut]
                near = (p**2).sum(1)[:, None] + (q**2).sum(1)[None, :] - 2 * p @ q.T <= share
                ok &= near if b == block else ~near  # an earlier block has judged the pair
            i, j = np.nonzero(ok)
            i, j = a[i], right[j]
            good = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            i, j = i[good], j[good]
            links += np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
            for x, y in zip(i, j, strict=True):
                x, y = root(x), root(y)
                if x != y:
                    tie[max(x, y)] = min(x, y)
        if not links.any():
            return table.select(["id"]).slice(0, 0).append_column("links", pa.array([], pa.int64())).append_column("tied", pa.array([], pa.int64()))
        roots = np.array([root(x) for x in range(len(ids))])
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, ids)
        keep = links > 0
        return pa.table({"id": ids[keep], "links": links[keep], "tied": least[roots][keep]})

    return run


def vector_classes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = 0.98) -> DataFrame:
    """One row per row of `vectors`: its id, n_links, component_id and kept.

    Vectors of equal, not null labels and equal dimension link when their cosine, in double precision, is at
    least `cosine`. Null and zero vectors, and those that hold null or non-finite components, link with
    nothing. Equal vectors are joined before the search, each counted with its copies. n_links: other rows
    linked directly. component_id: the smallest id that links reach. A repeated id counts as rows of their own
    in n_links; a null id is 0 links and no class. kept: id = component_id. No rows in, none out.
    """
    budget = 2 - 2 * cosine
    v = F.col(vector_col).cast("array<double>")
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    good = F.coalesce((F.size(v) > 0) & size.isNotNull() & ~F.isnan(size) & (size > 0) & (size < float("inf")), F.lit(False))
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), v.alias("v"), good.alias("good"))
    live = rows.where("good and label is not null and id is not null").select("id", "label", "v", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    firsts = stage(live.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), "salt")).alias("salts")).withColumn("h", F.xxhash64("v")), "vectors")
    at = f"dim int, label string, block int, {', '.join(f'{c} long' for c in _AT)}"
    cells = in_arrow(firsts.select("label", "id", "h", "v"), _cells(budget, _axes(firsts.count())), f"{at}, home boolean, id long, h long, x array<float>")
    key = ["dim", "label", "block", *_AT]
    full = stage(cells.groupBy(*key).agg(F.count("*").alias("m"), F.count_if("home").alias("h")).where("h > 0 and m > 1").select(*key, F.ceil(F.col("m") / PART).cast("int").alias("parts")), "cells")
    dealt = cells.join(hint_small(full, BROADCAST_CELLS), key)
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = dealt.withColumn("own", own).withColumn("to", F.explode(other))
    dealt = dealt.select(*key, "home", "id", "h", "x", F.least("own", "to").alias("p"), F.greatest("own", "to").alias("q"), F.when(F.col("own") <= F.col("to"), 0).otherwise(1).alias("side"))
    part = [*key, "p", "q"]
    partnered = stage(dealt.groupBy(*part).applyInArrow(_near(budget), f"{at}, home boolean, id long, h long, p int, q int, side int"), "partnered")
    judged = stage(partnered.join(firsts.select("label", "id", "h", "n", "v"), ["label", "id", "h"]).groupBy(*part).applyInArrow(_judge(cosine, budget), "id long, links long, tied long"), "judged")
    counts = judged.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(judged.select(F.col("id").alias("a"), F.col("tied").alias("b")))
    by_first = firsts.join(counts, "id", "left").join(parts.select(F.col("id").alias("id"), "component"), "id", "left")
    salt = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1))  # those that the copies have
    by_first = by_first.select(F.col("label").alias("l"), F.col("v").alias("w"), salt.alias("s"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    live_out = live.join(by_first, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")) & (F.col("salt") == F.col("s"))).select("id", "n_links", "component")
    rest = rows.where("not good or label is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = live_out.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
