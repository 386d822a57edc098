"""N-gram Jaccard join: token-combination prefixes, then exact verification.

A document is the set of its distinct k-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased). Shingles
are put in one global order, rare before frequent. Two sets that reach the threshold share at least o of
their shingles, so the first one they share lies among each one's first n - o + 1, and the first two
among the first n - o + 2. If the first shared shingle is rare, it alone is the key of a posting. If it
is frequent, so are all later ones, and pairs of frequent shingles of the extended prefix are the keys,
which are far rarer than the shingles. Sets of more than PAIRS_UPTO shingles would have too many pairs:
they post frequent shingles alone, as do smaller sets that could link with them.

A posting also carries how many shingles its two sets can still share if its key is their first: the pair
is compared only if that is enough. Among the sets of a key the one that can share most is compared with
all others first: in a group of near copies that is the text that the others were made from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chars import gathered, packed
from ._graph import clusters
from ._spark import bitmap, discard, in_arrow, stage
from ._words import Words, mix, runs, set_hash, text_bytes

#: The counts of shingles that order them are kept in this many counters (16 MB), each shared by all shingles of one hash value. Only speed depends on how well they tell rare from frequent.
COUNTERS = 1 << 22
#: A shingle is frequent if its counter is above this many times the mean, and above this.
FREQUENT_TIMES, FREQUENT_LEAST = 8, 64
#: Sets of up to so many shingles post pairs of frequent shingles.
PAIRS_UPTO = 256
_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, Words]]:
    for batch in it:
        data, at = text_bytes(batch.column("text"))
        for i, j in runs(at):
            yield batch, i, j, Words(data, at, i, j)


def _sizes(k: int):
    """Per partition: a row for each document, and the partition's counters in compressed segments."""

    def run(it):
        counters = np.zeros(COUNTERS, np.int32)
        for batch, i, j, words in _batches(it):
            text, value = words.shingle_sets(k)
            np.add.at(counters, (value & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            n, u = set_hash(text, value, j - i)
            yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(i, j - i), batch.column("tid").slice(i, j - i), pa.array(n), pa.array(u.view(np.int64), mask=n == 0), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names=["row_id", "tid", "n", "u", "seg", "counts"])
        if (parts := packed(counters)) is not None:
            none = [pa.nulls(len(parts), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, *parts.columns], names=["row_id", "tid", "n", "u", "seg", "counts"])

    return run


def _prefix_keys(text, value, n, counters, frequent, num, den):
    """(set number, key, shingles that can be shared) of all postings of sets; rows ordered by set and hash."""
    count = counters[(value & np.uint64(COUNTERS - 1)).astype(np.int64)]
    order = np.lexsort((count, text))  # stable: the hash decides among equals
    value, count = value[order], count[order]
    need = -(-n * num // den)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = rank < np.repeat(n - need + 1, n)
    often = count > frequent
    alone = first & (~often | np.repeat(n * den >= PAIRS_UPTO * num, n))
    left = np.repeat(n, n) - rank
    sets, keys, rem = [text[alone]], [mix(value[alone] ^ _A)], [left[alone]]
    pool = np.flatnonzero(often & (rank < np.repeat(n - need + 2, n)) & np.repeat((n <= PAIRS_UPTO) & (need >= 2), n))
    if len(pool):
        owner = text[pool]
        cut = np.flatnonzero(np.diff(owner)) + 1
        for part in np.split(pool, cut):
            if len(part) > 1:
                a, b = np.triu_indices(len(part), 1)
                sets.append(np.full(len(a), text[part[0]]))
                keys.append(mix(value[part[a]] * _A + mix(value[part[b]]) * _B))
                rem.append(left[part[b]] + 1)
    return np.concatenate(sets), np.concatenate(keys), np.concatenate(rem)


def _posts(k, num, den, counts, frequent, wanted=None):
    """Per document: its keys, with the hash and size of its set; with `wanted`, only keys of that bitmap."""

    def run(it):
        counters = np.frombuffer(counts.value, np.int32)
        for _, i, j, words in _batches(it):
            text, value = words.shingle_sets(k)
            n, u = set_hash(text, value, j - i)
            sets, keys, rem = _prefix_keys(text, value, n, counters, frequent, num, den)
            if wanted is not None:
                keep = wanted.has(keys)
                sets, keys, rem = sets[keep], keys[keep], rem[keep]
            for s in range(0, len(keys), 200_000):
                x = slice(s, s + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[x].view(np.int64)), pa.array(u[sets[x]].view(np.int64)), pa.array(n[sets[x]].astype(np.int32)), pa.array(rem[x].astype(np.int32))], names=["key", "u", "n", "rem"])

    return run


def _sets(k, wanted):
    """The shingle sets of documents whose text is in the bitmap."""

    def run(it):
        for batch in it:
            tid = batch.column("tid").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(wanted.has(tid)))
            for _, i, j, words in _batches([batch]):
                text, value = words.shingle_sets(k)
                n, u = set_hash(text, value, j - i)
                end = np.cumsum(n)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(u[some].view(np.int64)), pa.array([value[end[t] - n[t] : end[t]].tobytes() for t in some], pa.binary())], names=["u", "s"])

    return run


def shingle_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per row of `docs`: its id, n_shingles and component_id, the smallest id that links reach.

    Sets link when their Jaccard similarity is at least threshold[0] / threshold[1], by exact counts of
    64-bit shingle hashes. A null, empty or blank text has no shingles and links with nothing: its own id
    is its component_id. Equal texts are one class; a repeated row gives a repeated row; a null id is
    never a component_id unless the class has no other. No rows in, none out. Other columns are not read.
    """
    spark, (num, den) = docs.sparkSession, threshold
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("tid"))
    first = stage(in_arrow(rows, _sizes(k), "row_id long, tid long, n long, u long, seg int, counts binary"), "sizes")
    table = first.where("seg is null").select("row_id", "tid", "n", "u")
    counters = np.minimum(gathered(first.where("seg is not null").select("seg", "counts"), COUNTERS), 2**31 - 1).astype(np.int32)
    frequent = int(max(FREQUENT_LEAST, FREQUENT_TIMES * counters.mean()))
    counts = spark.sparkContext.broadcast(counters.tobytes())

    texts, shape = rows.select("text"), "key long, u long, n int, rem int"
    shared = in_arrow(texts, _posts(k, num, den, counts, frequent), shape).groupBy("key").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo != hi").select("key")
    shared = stage(shared, "keys", heavy=True)
    posts = in_arrow(texts, _posts(k, num, den, counts, frequent, bitmap(shared, "key")), shape)
    posts = stage(posts.groupBy("key", "u").agg(F.first(F.struct("rem", "n")).alias("w")).join(shared, "key", "left_semi"), "posts", heavy=True)

    used = [shared, posts]

    def sets_of(nodes: DataFrame) -> DataFrame:
        nodes = stage(nodes, "nodes")
        wanted = bitmap(table.join(nodes, "u", "left_semi").select("tid").distinct(), "tid")
        sets = in_arrow(rows.select("text", "tid"), _sets(k, wanted), "u long, s binary").groupBy("u").agg(F.first("s").alias("s"))
        used.extend([nodes, stage(sets.join(nodes, "u", "left_semi"), "sets", heavy=True)])
        return used[-1]

    def may(x, y):
        least, most, both = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"]), F.least(x["rem"], y["rem"])
        return (den * least >= num * most) & ((num + den) * both.cast("long") >= num * (least.cast("long") + most))

    parts = clusters(posts, sets_of, may, num, den)
    discard(*used)
    table = table.join(parts, table["u"] == parts["id"], "left").select("row_id", "n", F.coalesce("component", "u").alias("c"))
    least = stage(table.where("c is not null").groupBy("c").agg(F.min("row_id").alias("least")), "least")
    return table.join(least, "c", "left").select(F.col("row_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("row_id")).otherwise(F.col("least")).alias("component_id"))
