"""From samples to conditions: segments, viewing features, trial features, condition rollups, and what to recompute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintspan.operators import compare, islands, segments, transitions
from glintspan.plans.registry import Registry

Names = Sequence[str]


def needs(df: DataFrame, key: str, features: Names, *, rerun_all: bool = False, rerun: Names = ()) -> DataFrame:
    """(key, need_{feature}...): whether each feature of each key is to be computed: asked for, or null."""
    return df.select(key, *[(F.lit(True) if rerun_all or f in rerun else F.col(f).isNull()).alias(f"need_{f}") for f in features])


def batches(needed: DataFrame, key: str) -> DataFrame:
    """(needs, n, keys): keys by equal need vectors; vectors without needs are left out."""
    flags = [c for c in needed.columns if c.startswith("need_")]
    vector = F.concat_ws(",", *[F.when(F.col(c), c[5:]) for c in flags])
    return needed.withColumn("needs", vector).where("needs <> ''").groupBy("needs").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def recompute(done: DataFrame, inputs: DataFrame, key: Names, compute) -> DataFrame:
    """`done` and what `compute` makes of the inputs whose keys it doesn't have: an anti-join, then a union."""
    return done.unionByName(compute(inputs.join(done.select(*key), list(key), "left_anti")), allowMissingColumns=True)


def viewing_features(segment_rows: DataFrame, key: Names, label: str, registry: Registry) -> DataFrame:
    """The registry's features and the transition features of each key's fixations, from one merged sequence."""
    fixed = segment_rows.where("kind = 'fixation'")
    merged = islands.merge_runs(fixed, key, ["start"], label, "start", "end", ["dispersion", "invalid"])
    merged = islands.visit_number(merged, key, ["start"], label)
    roles = {"label": label, "start": "start", "duration": "duration", "visit": "visit", "dispersion": "dispersion", "invalid": "invalid"}
    features = registry.evaluate(merged, key, roles)
    shares = transitions.transition_shares(transitions.transition_counts(merged, key, ["start"], label), key)
    ht = transitions.joint_entropy(shares, key)
    hn = transitions.weighted_entropy(shares, transitions.label_weights(merged, key, label), key, "hn")
    hd = transitions.weighted_entropy(shares, transitions.label_weights(merged, key, label, "duration"), key, "hd")
    return features.join(ht, list(key), "left").join(hn, list(key), "left").join(hd, list(key), "left")


def trial_features(viewings: DataFrame, trial: Names, side: str, values: Names) -> DataFrame:
    return compare.paired(viewings, trial, side, values)


def condition_medians(trials: DataFrame, condition: Names, values: Names, *, at_least: int = 5) -> DataFrame:
    """Medians over each condition's trials; null from fewer than `at_least`."""
    clean = trials.withColumns({v: F.when(~F.isnan(F.col(v).cast("double")), F.col(v)) for v in values})
    return clean.groupBy(*condition).agg(F.count("*").alias("n_trials"), *[F.when(F.count("*") >= at_least, F.median(v)).alias(f"{v}_median") for v in values])


def detectors(df: DataFrame, key: Names, order: Names, time: str, label: str, gaze: Names, head: Names, speed: float, least: float) -> dict[str, DataFrame]:
    """The detectors by name over one angular speed column."""
    back = segments.angular_speed(df, key, order, time, gaze, head)
    ahead = segments.angular_speed(df, key, order, time, gaze, head, forward=True)
    return {
        "speed": segments.by_speed(back, key, order, time, "angular_speed", label, most=speed, least=least),
        "speed_gap": segments.by_speed_and_gap(ahead, key, order, time, "angular_speed", gaze, most=speed / 3, least=least, gap=least, angle=0.5),
        "dispersion": segments.by_dispersion(df, key, order, time, gaze, head, least=least),
        "hidden_states": segments.by_hidden_states(back, key, order, "angular_speed"),
        "clusters": segments.by_clusters(df, key, order, time, gaze),
    }


def levels(segments_of: DataFrame, view: Names, trial: Names, side: str, condition: Names, compute, *, done: DataFrame | None = None, at_least: int = 5) -> dict[str, DataFrame]:
    """Viewing, trial and condition features by level, each from the one below.

    `compute` makes viewing features of samples or segments; keys of `view` that `done` holds aren't computed again. Trial
    features pair the sides; conditions are medians of the differences over their trials.
    """
    viewings = compute(segments_of) if done is None else recompute(done, segments_of, view, compute)
    values = [c for c in viewings.columns if c not in view and c not in condition]
    keys = [c for c in trial if c in viewings.columns]
    trials = trial_features(viewings, keys, side, values)
    missing = [c for c in condition if c not in trials.columns]
    if missing:
        trials = trials.join(segments_of.select(*keys, *missing).distinct(), keys)
    return {"viewing": viewings, "trial": trials, "condition": condition_medians(trials, condition, [f"{v}_diff" for v in values], at_least=at_least)}
