"""Transition features of label sequences: counts, probabilities, entropies, divergence, inequality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintspan.functions.measures import gini, plogp

from .islands import collapse_labels, ordered

Names = Sequence[str]


def transition_counts(df: DataFrame, key: Names, order: Names, label: str, *, within: Names = ()) -> DataFrame:
    """(key, from_label, to_label, n) of steps between unlike labels; `within` keeps steps inside its segments."""
    seq = collapse_labels(df, [*key, *within], order, label)
    seq = seq.withColumn("_next", F.lead(label).over(ordered([*key, *within], order))).where("_next is not null")
    return seq.groupBy(*key, F.col(label).alias("from_label"), F.col("_next").alias("to_label")).agg(F.count("*").alias("n"))


def transition_shares(counts: DataFrame, key: Names) -> DataFrame:
    """counts with p_joint, of all steps of the key, and p_cond, of those from the label."""
    whole, origin = Window.partitionBy(*key), Window.partitionBy(*key, "from_label")
    return counts.withColumn("p_joint", F.col("n") / F.sum("n").over(whole)).withColumn("p_cond", F.col("n") / F.sum("n").over(origin))


def joint_entropy(shares: DataFrame, key: Names, name: str = "ht") -> DataFrame:
    """-sum p(i, j) log2 p(j | i): 0 if every label has one successor."""
    return shares.groupBy(*key).agg((-F.sum(F.col("p_joint") * F.log2("p_cond"))).alias(name))


def weighted_entropy(shares: DataFrame, weights: DataFrame, key: Names, name: str) -> DataFrame:
    """-sum w(i) p(j | i) log2 p(j | i) with weights (key, label, w): a label's share of visits or of time."""
    from_rows = shares.groupBy(*key, F.col("from_label").alias("label")).agg(F.sum(plogp(F.col("p_cond"))).alias("_h"))
    return from_rows.join(weights, [*key, "label"]).groupBy(*key).agg((-F.sum(F.col("w") * F.col("_h"))).alias(name))


def label_weights(df: DataFrame, key: Names, label: str, measure: str | None = None) -> DataFrame:
    """(key, label, w): shares of rows, or of a measure, by label."""
    total = F.count("*") if measure is None else F.sum(measure)
    per = df.groupBy(*key, F.col(label).alias("label")).agg(total.cast("double").alias("_t"))
    return per.withColumn("w", F.try_divide(F.col("_t"), F.sum("_t").over(Window.partitionBy(*key)))).drop("_t")


def label_gini(weights: DataFrame, key: Names, slots: int | None, name: str) -> DataFrame:
    """Gini of the shares of labels, padded with zeros to `slots`."""
    return weights.groupBy(*key).agg(gini(F.collect_list("w"), slots).alias(name))


def matrix_json(shares: DataFrame, key: Names, value: str = "p_joint", digits: int = 4) -> DataFrame:
    """(key, labels, matrix): dense matrices over the labels of each key, in order, as JSON."""
    labels = shares.select(*key, F.explode(F.array("from_label", "to_label")).alias("l")).groupBy(*key).agg(F.array_sort(F.collect_set("l")).alias("_labels"))
    cells = shares.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "from_label", "to_label"), F.round(value, digits)))).alias("cells"))
    both = labels.join(cells, list(key))
    matrix = F.transform("_labels", lambda a: F.transform("_labels", lambda b: F.coalesce(F.element_at(F.col("cells"), F.concat_ws("\x1f", a, b)), F.lit(0.0))))
    return both.select(*key, F.to_json("_labels").alias("labels"), F.to_json(matrix).alias("matrix"))


def symmetric_divergence(p: DataFrame, q: DataFrame, key: Names, value: str = "p_joint", *, eps: float = 1e-5, name: str = "d_kl") -> DataFrame:
    """Symmetric Kullback-Leibler divergence in nats of two sets of off-diagonal cells; a cell that only one has counts as eps in the other."""
    a = p.select(*key, "from_label", "to_label", F.col(value).alias("_p"))
    b = q.select(*key, "from_label", "to_label", F.col(value).alias("_q"))
    cells = a.join(b, [*key, "from_label", "to_label"], "full").where("from_label != to_label")
    x, y = F.coalesce("_p", F.lit(0.0)) + eps, F.coalesce("_q", F.lit(0.0)) + eps
    return cells.groupBy(*key).agg(((F.sum(x * F.log(x / y)) + F.sum(y * F.log(y / x))) / 2).alias(name))


def stationary(shares: DataFrame, key: Names, *, rounds: int = 50) -> DataFrame:
    """(key, label, pi): the distribution that the conditional matrix keeps, by power iteration on each key's dense matrix."""
    import numpy as np
    import pandas as pd

    keys = list(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = sorted(set(pdf.from_label) | set(pdf.to_label))
        at = {x: i for i, x in enumerate(labels)}
        m = np.zeros((len(labels), len(labels)))
        for a, b, p in zip(pdf.from_label, pdf.to_label, pdf.p_cond, strict=True):
            m[at[a], at[b]] = p
        m[m.sum(1) == 0] = 1 / len(labels)
        pi = np.full(len(labels), 1 / len(labels))
        for _ in range(rounds):
            pi = 0.5 * pi + 0.5 * pi @ m
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "label": labels, "pi": pi})

    kinds = dict(shares.dtypes)
    return shares.groupBy(*key).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "label string", "pi double"]))
