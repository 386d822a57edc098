"""Repair of raw samples: sandwiches, blinks, track loss, time stamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .islands import drop_short_runs, first_of_duplicates, ordered, time_share

Names = Sequence[str]


def repair_sandwiches(df: DataFrame, key: Names, order: Names, label: str, numeric: Names = (), copied: Names = ()) -> DataFrame:
    """A sample whose label differs from its four equal neighbours takes their label.

    Its numeric columns become the mean of the neighbours' and the copied ones the one before.
    """
    w = ordered(key, order)
    near = [F.lag(label, 2).over(w), F.lag(label, 1).over(w), F.lead(label, 1).over(w), F.lead(label, 2).over(w)]
    hit = F.coalesce((near[0] == near[1]) & (near[1] == near[2]) & (near[2] == near[3]) & (F.col(label) != near[1]), F.lit(False))
    new = {label: F.when(hit, near[1]).otherwise(F.col(label)), "repaired": hit}
    new |= {c: F.when(hit, (F.lag(c).over(w) + F.lead(c).over(w)) / 2).otherwise(F.col(c)) for c in numeric}
    new |= {c: F.when(hit, F.lag(c).over(w)).otherwise(F.col(c)) for c in copied}
    return df.withColumns(new)


def track_loss(df: DataFrame, left: tuple[str, str], right: tuple[str, str], *, shut: float = 0.01, lost: float = -1.0) -> DataFrame:
    """track_loss where both eyes are lost: diameter at its sentinel, or openness below `shut`."""
    gone = [(F.col(d) == lost) | (F.col(o) < shut) for d, o in (left, right)]
    return df.withColumn("track_loss", F.coalesce((gone[0] & gone[1]).cast("int"), F.lit(0)))


def blinks(df: DataFrame, key: Names, order: Names, flag: str = "track_loss", *, least: float = 100) -> DataFrame:
    """blink: runs of `flag` of at least `least`; technical: flagged rows outside blinks."""
    df = drop_short_runs(df, key, order, flag, order[0], least, "blink")
    return df.withColumn("technical", ((F.col(flag) == 1) & (F.col("blink") == 0)).cast("int"))


def null_missing(df: DataFrame, missing: str, channels: Names) -> DataFrame:
    return df.withColumns({c: F.when(F.coalesce(F.col(missing).cast("int"), F.lit(0)) != 1, F.col(c)) for c in channels})


def shift_to_zero(df: DataFrame, key: Names, time: str) -> DataFrame:
    """Sequences that start before 0 are moved so that they start at 1."""
    t0 = F.min(time).over(Window.partitionBy(*key))
    return df.withColumn(time, F.when(t0 < 0, F.col(time) + F.abs(t0) + 1).otherwise(F.col(time)))


def drop_unwanted(df: DataFrame, key: Names, time: str, label: str, *, early: str, within: float, always: Names = ()) -> DataFrame:
    """Without rows labelled `early` in the first `within` of a sequence, and without those labelled by `always`."""
    t0 = F.min(time).over(Window.partitionBy(*key))
    df = df.withColumn("_t0", t0).where(~((F.col(label) == early) & (F.col(time) - F.col("_t0") < within)) | F.col(label).isNull()).drop("_t0")
    return df.where(~F.col(label).isin(*always) | F.col(label).isNull()) if always else df


def dedup_time(df: DataFrame, key: Names, order: Names) -> DataFrame:
    """One sample for each time of a sequence: the first by the rest of the order."""
    return first_of_duplicates(df, [*key, order[0]], order)


def repair_time_splits(df: DataFrame, key: Names, frame: str, time: str, *, jump: float = 20_000, straight: float = 0.999) -> DataFrame:
    """Times of sequences that don't run with their frames (correlation below `straight`): each chunk after a jump follows the one before by the mean step.

    A running sum over steps in frame order does it: jumps count as one mean step, other steps as they are.
    """
    part, w = Window.partitionBy(*key), ordered(key, [frame])
    step = F.col(time) - F.lag(time).over(w)
    df = df.withColumns({"_r": F.corr(F.col(time).cast("double"), F.col(frame).cast("double")).over(part), "_step": step})
    usual = F.avg(F.when(F.abs("_step") <= jump, F.col("_step"))).over(part).cast("long")
    df = df.withColumn("_fixed", F.coalesce(F.when(F.abs("_step") > jump, usual).otherwise(F.col("_step")), F.lit(0)))
    first = F.first(time).over(w.rowsBetween(Window.unboundedPreceding, 0))
    moved = first + F.sum("_fixed").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(time, F.when(F.coalesce(F.col("_r") < straight, F.lit(False)), moved).otherwise(F.col(time))).drop("_r", "_step", "_fixed")


def usable_sequences(df: DataFrame, key: Names, order: Names, missing: str, *, least_rows: int = 10, most_missing: float = 0.25) -> DataFrame:
    """Rows of sequences of enough samples of which not too much time is missing."""
    counts = df.groupBy(*key).agg(F.count("*").alias("_rows"))
    share = time_share(df, key, order, order[0], F.col(missing).cast("int") == 1, "_share")
    good = counts.join(share, list(key)).where((F.col("_rows") >= least_rows) & (F.coalesce("_share", F.lit(0.0)) <= most_missing))
    return df.join(good.select(*key), list(key), "left_semi")


def staged(df: DataFrame, key: Names, order: Names, label: str, numeric: Names, missing: str, *, least: float) -> DataFrame:
    """`df` with what each step of cleaning makes of the numeric columns side by side: {c}_sandwich after the repair of labels, {c}_blink with blinks as nulls."""
    raw = df.withColumns({f"{c}_sandwich": F.col(c) for c in numeric})
    fixed = repair_sandwiches(raw, key, order, label, [f"{c}_sandwich" for c in numeric])
    return blinks(fixed, key, order, missing, least=least).withColumns({f"{c}_blink": F.when(F.col("blink") == 0, F.col(f"{c}_sandwich")) for c in numeric})


def preprocessed(df: DataFrame, key: Names, order: Names, frame: str, label: str, missing: str, channels: dict[str, dict], *, least_rows: int = 10, most_missing: float = 0.25, blink: float = 100, pad: int = 1) -> DataFrame:
    """The whole preparation of raw samples as one plan: time stamps, sandwiches, bridged and flagged blinks, filters, nulls.

    Keys of fewer than `least_rows` samples go first; after the repair of split time stamps and sandwiches, and of
    repeated times the first, windows of lost samples are bridged and their runs of at least `blink` are blinks. Channels are
    filtered (each with cutoff, median and mean widths), set to null in blinks, and keys with more than `most_missing` of
    their time lost go.
    """
    from .signal import bridge_blinks, filter_channels

    time = order[0]
    enough = df.withColumn("_rows", F.count("*").over(Window.partitionBy(*key))).where(F.col("_rows") >= least_rows).drop("_rows")
    even = dedup_time(repair_time_splits(enough, key, frame, time), key, order)
    fixed = repair_sandwiches(even, key, order, label, list(channels)).drop("repaired")
    bridged = bridge_blinks(fixed, key, order, time, missing, list(channels), pad=pad)
    flagged = blinks(bridged, key, order, "window", least=blink)
    kept = usable_sequences(flagged, key, order, "blink", least_rows=least_rows, most_missing=most_missing)
    return null_missing(filter_channels(kept, key, order, time, channels), "blink", list(channels))
