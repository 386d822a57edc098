"""Connected components, and clusters of nodes that share keys. No list of links leaves the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._jaccard import linked_pairs, links_within
from ._spark import discard, stage


#: Members of a key outside of its top's component that are paired in rows, at most so many rows a post. Keys of more are compared in blocks.
PAIRED = 256


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of `edges` (a, b: long) that isn't the smallest of its component.

    Alternating large-star and small-star steps: each keeps the components, is a grouped minimum joined
    to the edges, and is done after about log(n) rounds. A hub's edges are pre-aggregated for the minimum,
    and its join can be split. Each round's table takes the place of the one before.
    """
    e = stage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        after = stage(small.select("x.u", "x.v").where("u != v").distinct(), "edges")
        discard(e)
        e = after


def clusters(posts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], may: Callable[[Column, Column], Column], num: int, den: int) -> DataFrame:
    """(id, component) over the nodes of `posts` (key, u: long, and a struct w that orders the nodes of a key).

    `posts` holds each (key, u) once. Two nodes are candidates if they share a key under which `may` holds for
    their w, and link if their sets, which `sets_of` gives as (u, s) for a table of nodes u, have a similarity of
    num / den or more. First each node is compared with the node of largest w under its keys, which settles dense
    groups in a number of pairs that is linear in the posts; then those members of a key that are still in
    different components: where up to PAIRED are outside of the top's component, those with all others, each pair once
    whatever keys it shares; else all in blocks, once for all keys of the same members. So every link joins its
    nodes' components.
    """
    top = stage(posts.groupBy("key").agg(F.max(F.struct("w", "u")).alias("h")), "top")
    star = posts.join(top, "key").where(F.col("u") != F.col("h.u")).where(may(F.col("w"), F.col("h.w")))
    tried = stage(star.select(F.least("u", "h.u").alias("a"), F.greatest("u", "h.u").alias("b")).distinct(), "pairs", heavy=True)
    sets = sets_of(tried.select(F.explode(F.array("a", "b")).alias("u")).distinct())
    links = stage(linked_pairs(tried, sets, num, den), "links", heavy=True)
    discard(top)
    found = components(links)
    in_parts = posts.join(found, posts["u"] == found["id"], "left").select("key", "u", "w", F.coalesce("component", "u").alias("c"))
    # Of two members one is the top, with which the other has been compared, or may not link.
    each = in_parts.groupBy("key", "c").agg(F.count("*").alias("n"), F.max(F.struct("w", "u")).alias("h"), F.bit_xor(F.xxhash64("u")).alias("x"), F.bit_xor(F.xxhash64("u", F.lit(1))).alias("y"))
    mixed = each.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("h", "c", "n")).alias("main"), F.count("*").alias("parts"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("parts > 1 and m > 2")
    mixed = stage(mixed.select("key", "m", F.col("main.c").alias("main"), (F.col("m") - F.col("main.n")).alias("others"), "x", "y"), "mixed", heavy=True)
    few = mixed.where(F.col("others") <= PAIRED).select("key", "main")
    many = mixed.where(F.col("others") > PAIRED).groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", F.lit(None).cast("long").alias("main"))  # keys of the same members once
    open_ = stage(in_parts.join(few.unionByName(many), "key"), "open", heavy=True)
    p, q = (open_.where("main is not null").alias(x) for x in "pq")
    other = (F.col("p.c") != F.col("p.main")) & ((F.col("q.c") == F.col("q.main")) | (F.col("p.c") < F.col("q.c")))
    pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & other & may(F.col("p.w"), F.col("q.w"))).select(F.least("p.u", "q.u").alias("a"), F.greatest("p.u", "q.u").alias("b")).distinct()
    pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs", heavy=True)
    crowds = open_.where("main is null")
    more = None
    if pairs.limit(1).count():
        more = linked_pairs(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct()), num, den)
    if crowds.limit(1).count():
        tied = links_within(crowds, sets_of(crowds.select("u").distinct()), num, den)
        more = tied if more is None else more.unionByName(tied)
    if more is not None:
        more = stage(more, "links", heavy=True)
        if more.limit(1).count():
            found = components(links.union(more))
        discard(more)
    discard(mixed, open_, pairs, tried, links)
    return found
