"""Row-level ingest: view classes, epochs, retrieval intervals, ids, codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintspan.operators.islands import first_pair_after, intervals_join


def view_class(view_no: Column, frame: Column, practice: Column, start: Column, end: Column) -> Column:
    """bc between the calibration frames of practice blocks, null (to skip) before them, else by the view number; an unknown number is an error."""
    return (
        F.when(practice & (frame > start) & (frame < end), "bc").when(practice & (frame <= start), F.lit(None).cast("string"))
        .when(view_no == 0, "na").when(view_no == 1, "enc").when(view_no == 2, "ret_view").when(view_no == 3, "ret_full").otherwise(F.raise_error(F.concat(F.lit("view number "), view_no.cast("string"))))
    )


def epoch(view: Column) -> Column:
    return F.when(view == "ret_view", "view").when(view == "ret_full", "full").otherwise("na")


def move_type(code: Column) -> Column:
    return F.when(code == 1, "Walk").when(code == 2, "Teleport").when(code == 3, "Stay").otherwise(F.raise_error(F.concat(F.lit("move code "), code.cast("string"))))


def confidence(answer: Column) -> Column:
    """Answers 1 to 4; 0 if timed out, -999 if invalid."""
    number = F.regexp_extract(answer, r"([0-9]+)\s*$", 1).try_cast("int")
    return F.when(number.between(1, 4), number).when(F.lower(answer).contains("time"), 0).otherwise(-999)


def keys(pid: Column, phase: Column, block: Column, trial: Column, view: Column) -> dict[str, Column]:
    """The key of each level: each is its parent's with one more part."""
    block_id = F.concat(pid, phase, block.cast("string"))
    trial_id = F.concat_ws("_", block_id, trial.cast("string"))
    return {"block_id": block_id, "trial_id": trial_id, "viewing_id": F.concat_ws("_", trial_id, view)}


def parts_of(viewing_id: Column) -> dict[str, Column]:
    p = F.split(viewing_id, "_")
    return {"block_id": F.get(p, F.lit(0)), "trial_id": F.concat_ws("_", F.get(p, F.lit(0)), F.get(p, F.lit(1))), "view": F.get(p, F.lit(2))}


def retrieval_rows(samples: DataFrame, session: DataFrame, events: DataFrame, key: list[str], frame: str, start: str, end: str, bucket: int = 1000) -> DataFrame:
    """`samples` and the session's rows in frames between `start` and `end` events that it doesn't have, as view number 3."""
    spans = first_pair_after(events, key, ["frame"], "event", start, end)
    more = intervals_join(session, spans, key, frame, "start_at", "end_at", bucket).drop("start_at", "end_at")
    more = more.join(samples.select(*key, frame), [*key, frame], "left_anti").withColumn("ViewNo", F.lit(3))
    return samples.unionByName(more, allowMissingColumns=True)


def trim_before(df: DataFrame, key: list[str], frame: str, start: DataFrame) -> DataFrame:
    """Rows from the key's start frame on; keys without one keep all."""
    return df.join(start.select(*key, F.col("start_at").alias("_from")), key, "left").where(F.col("_from").isNull() | (F.col(frame) >= F.col("_from"))).drop("_from")


def viewings_of_trials(trials: DataFrame, trial_id: str, baseline: Column) -> DataFrame:
    """Two viewings of each trial, enc and ret, or one, bc, of a baseline."""
    views = F.when(baseline, F.array(F.lit("bc"))).otherwise(F.array(F.lit("enc"), F.lit("ret")))
    return trials.withColumn("view", F.explode(views)).withColumn("viewing_id", F.concat_ws("_", trial_id, "view"))


def conditions_of(participants: DataFrame, pid: str, moves: tuple[str, ...] = ("Stay", "Walk", "Teleport")) -> DataFrame:
    """(pid, move, rotated, condition_id): each participant's conditions."""
    all_of = F.array(*[F.struct(F.lit(m).alias("move"), F.lit(r).alias("rotated")) for m in moves for r in (False, True)])
    return participants.select(pid, F.explode(all_of).alias("c")).select(pid, "c.move", "c.rotated", F.concat_ws("_", pid, "c.move", F.col("c.rotated").cast("string")).alias("condition_id"))


def with_missing_trials(info: DataFrame, config: DataFrame, trial: str) -> DataFrame:
    """`info` and the configured trials that it lacks."""
    return info.unionByName(config.join(info.select(trial), trial, "left_anti"), allowMissingColumns=True)


def once(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def without_first_repeat(df: DataFrame, key: list[str], order: list[str], trial: str, number: int = -8) -> DataFrame:
    """Rows without the first one of trial `number` of a key, where there are several: a recording that was begun anew."""
    rank, many = F.row_number().over(Window.partitionBy(*key, trial).orderBy(*order)), F.count("*").over(Window.partitionBy(*key, trial))
    return df.withColumns({"_n": rank, "_m": many}).where(~F.coalesce((F.col(trial) == number) & (F.col("_m") > 1) & (F.col("_n") == 1), F.lit(False))).drop("_n", "_m")


def with_baseline(info: DataFrame, key: list[str], order: list[str], trial: str, number: int = -1) -> DataFrame:
    """`info` and, for each key, a baseline trial: its first row again, as trial `number`."""
    return info.unionByName(once(info, key, order).withColumn(trial, F.lit(number).cast(info.schema[trial].dataType)))


def resolved_layout(df: DataFrame, four: dict[str, str], five: dict[str, str], probe: str) -> DataFrame:
    """`df` with columns that two layouts keep in different places: those of `five` where `probe` holds a number, else those of `four`."""
    has = F.col(probe).isNotNull() & ~F.isnan(F.col(probe).cast("double"))
    return df.withColumns({name: F.when(has, F.col(five[name])).otherwise(F.col(four[name]) if name in four else None) for name in five})
