"""Features by name: an aggregate expression, a type and bounds. A feature is a Column, never a row function."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintspan.functions.measures import sentinel_status, with_sentinels


@dataclass(frozen=True)
class Feature:
    """`build(c)` gives the aggregate; c maps roles (label, start, duration, ...) to column names."""

    name: str
    build: Callable[[dict[str, str]], Column]
    dtype: str = "double"
    low: float | None = None
    high: float | None = None
    level: str = "viewing"


class Registry(dict[str, Feature]):
    def register(self, name: str, build: Callable[[dict[str, str]], Column], dtype: str = "double", low: float | None = None, high: float | None = None, level: str = "viewing") -> Feature:
        if name in self:
            raise ValueError(f"feature {name} is registered")
        self[name] = Feature(name, build, dtype, low, high, level)
        return self[name]

    def evaluate(self, df: DataFrame, key: Sequence[str], roles: dict[str, str], names: Sequence[str] | None = None, *, at_least: int = 1) -> DataFrame:
        """One row per key with the named features, all in one aggregation; null from fewer than `at_least` rows."""
        some = [self[n] for n in (names or self)]
        return df.groupBy(*key).agg(*[F.when(F.count("*") >= at_least, f.build(roles)).cast(f.dtype).alias(f.name) for f in some])

    def status(self, wide: DataFrame, key: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
        """(key, feature, value, status) with status ok, low, high or null."""
        some = [self[n] for n in (names or [n for n in self if n in wide.columns])]
        rows = F.array(*[F.struct(F.lit(f.name).alias("feature"), F.col(f.name).cast("double").alias("value"), sentinel_status(F.col(f.name).cast("double"), f.low, f.high).alias("status")) for f in some])
        return wide.select(*key, F.inline(rows))

    def bounded(self, wide: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """`wide` with values out of bounds as sentinels."""
        some = [self[n] for n in (names or [n for n in self if n in wide.columns])]
        return wide.withColumns({f.name: with_sentinels(F.col(f.name), f.low, f.high) for f in some})


def counted(label: str | None) -> Callable[[dict[str, str]], Column]:
    return lambda c: F.count("*") if label is None else F.count_if(F.col(c["label"]) == label)


def summed(label: str | None, measure: str) -> Callable[[dict[str, str]], Column]:
    return lambda c: F.coalesce(F.sum(F.when(F.lit(True) if label is None else F.col(c["label"]) == label, F.col(c[measure]))), F.lit(0.0))


def first_time(labels: Sequence[str], never: float) -> Callable[[dict[str, str]], Column]:
    return lambda c: F.coalesce(F.min(F.when(F.col(c["label"]).isin(*labels), F.col(c["start"]))) - F.min(c["start"]), F.lit(never))


def mean_of(measure: str, at_least: int = 0) -> Callable[[dict[str, str]], Column]:
    return lambda c: F.when(F.count(c[measure]) > at_least, F.avg(c[measure]))


def fixation_features(labels: Sequence[str], never: float = 13_000.0) -> Registry:
    """The fixation family over given labels: counts, dwell, first times, refixations, durations, dispersion."""
    r = Registry()
    for name, label in [("total", None), *((x, x) for x in labels)]:
        r.register(f"n_fix_{name}", counted(label), "long", 0, 10_000)
        r.register(f"dwell_{name}", summed(label, "duration"), "double", 0, None)
        r.register(f"n_refix_{name}", (lambda x: lambda c: F.count_if((F.col(c["visit"]) > 1) & (F.lit(True) if x is None else F.col(c["label"]) == x)))(label), "long", 0, 10_000)
        r.register(f"redwell_{name}", (lambda x: lambda c: F.coalesce(F.sum(F.when((F.col(c["visit"]) > 1) & (F.lit(True) if x is None else F.col(c["label"]) == x), F.col(c["duration"]))), F.lit(0.0)))(label), "double", 0, None)
    for x in labels:
        r.register(f"t_first_{x}", first_time([x], never), "double", 0, None)
    r.register("t_first_array", first_time(labels, never), "double", 0, None)
    r.register("fix_duration_mean", lambda c: F.coalesce(F.avg(c["duration"]), F.lit(0.0)))
    r.register("refix_duration_mean", lambda c: F.coalesce(F.avg(F.when(F.col(c["visit"]) > 1, F.col(c["duration"]))), F.lit(0.0)))
    r.register("dispersion_mean", mean_of("dispersion", 2))
    r.register("drop_out_total", lambda c: F.coalesce(F.sum(c["invalid"]), F.lit(0.0)))
    return r


def saccade_features(labels: Sequence[str] = ()) -> Registry:
    """Saccades in all and by the label they land on, and their speeds."""
    r = Registry()
    for name, label in [("total", None), *((x, x) for x in labels)]:
        r.register(f"n_sacc_{name}", counted(label), "long", 0, 10_000)
    r.register("velocity_mean_total", mean_of("mean_speed", 2))
    r.register("velocity_std_total", lambda c: F.when(F.count(c["mean_speed"]) > 2, F.stddev_pop(c["mean_speed"])))
    return r


def pupil_features(left: str, right: str) -> Registry:
    """Centre: mean of the eyes' medians; spread: mean of their interquartile ranges. An eye without values is left out."""
    r = Registry()
    spread = lambda x: F.percentile(x, 0.75) - F.percentile(x, 0.25)
    mean = lambda a, b: (F.coalesce(a, b) + F.coalesce(b, a)) / 2
    r.register("pupil_diam_centre", lambda c: mean(F.median(left), F.median(right)))
    r.register("pupil_diam_spread", lambda c: mean(spread(left), spread(right)))
    return r


def group_features() -> Registry:
    """Trials by condition: number, correct, share and mean confidence without its sentinel."""
    r = Registry()
    r.register("n_trials", counted(None), "long", 0, None, "condition")
    r.register("n_correct", lambda c: F.count_if(F.col(c["truth"]) == F.col(c["answer"])), "long", 0, None, "condition")
    r.register("p_correct", lambda c: F.try_divide(F.count_if(F.col(c["truth"]) == F.col(c["answer"])), F.count("*")), "double", 0, 1, "condition")
    r.register("mean_confidence", lambda c: F.avg(F.nullif(F.col(c["confidence"]).cast("double"), F.lit(-999.0))), "double", 0, None, "condition")
    return r
