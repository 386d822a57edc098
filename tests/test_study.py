import numpy as np
import pytest
from pyspark.sql import functions as F

from glintspan.operators import cleaning, islands, signal, statistics
from glintspan.plans import catalogue, pipeline
from glintspan.sources import fetch, files, ingest

SF = "/root/testdata/sf0.001"


def test_ids_and_lists():
    assert fetch.study_ids("all", "s") is None and fetch.study_ids([1, "s_2"], "s") == ["s_1", "s_2"] and fetch.study_ids("3", "s") == ["s_3"]
    assert fetch.as_list("x", str) == ["x"] and fetch.as_list(("x", "y"), str) == ["x", "y"]
    with pytest.raises(TypeError):
        fetch.as_list([1], str)
    with pytest.raises(KeyError):
        fetch.level("sessions", lambda name: None)


def test_defaults_keep_nulls_of_practice(spark):
    df = spark.createDataFrame([("s_1", "na", 0, None), ("s_1", "full", 0, None), ("s_2", "view", 18, False), ("s_2", "view", 17, True), ("s_3", "view", 17, False)], "ppt_id string, epoch string, trial int, practice boolean")
    got = fetch.fetched(df, epoch="epoch", trial="trial", practice="practice").collect()
    assert sorted(r.ppt_id for r in got) == ["s_1", "s_3"]
    assert fetch.drop_like(df.withColumn("x_notable", F.lit(1)), "notable").columns == df.columns


def test_first_pairs(spark):
    df = spark.createDataFrame([("k", i, e) for i, e in enumerate("end start x start end y end start".split())], "key string, at int, event string")
    one = islands.first_pair_after(df, ["key"], ["at"], "event", "start", "end").collect()
    assert [(r.start_at, r.end_at) for r in one] == [(1, 4)]
    more = islands.first_pair_after(df, ["key"], ["at"], "event", "start", "end", each=True).collect()
    assert [(r.start_at, r.end_at) for r in more] == [(1, 4)]


def test_windows_of_lost_samples_are_straight():
    t = np.arange(0, 60, 5.0)
    x = t.copy()
    x[4:6] = 999  # lost at 20 and 25: from 15 - 1 to 30 + 1
    lost = np.zeros(len(t), int)
    lost[4:6] = 1
    (y,), window = signal.bridge_windows(t, lost, [x], pad=1)
    assert y == pytest.approx(t, abs=1e-9) and window.tolist() == [0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0]
    (same,), none = signal.bridge_windows(t, lost * 0, [x])
    assert same == pytest.approx(x) and not none.any()
    lost[8] = 1  # 40: from 34 to 46; apart from the first
    (y,), _ = signal.bridge_windows(t, lost, [x], pad=1)
    assert y == pytest.approx(t, abs=1e-9)
    (y,), _ = signal.bridge_windows(t, np.array([0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0]), [t], pad=3)  # windows that overlap are one
    assert y == pytest.approx(t, abs=1e-9)


def test_preprocessed_keys(spark):
    rows = [("a", i, 10 * i, "o", float(i), int(5 <= i < 8)) for i in range(40)] + [("few", i, i, "o", 0.0, 0) for i in range(9)] + [("lost", i, 10 * i, "o", 0.0, int(i > 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, frame int, t int, label string, x double, missing int")
    out = cleaning.preprocessed(df, ["key"], ["t"], "frame", "label", "missing", {"x": {"cutoff": 40.0, "median": 3, "mean": 3}}, blink=20).orderBy("t").collect()
    assert {r.key for r in out} == {"a"} and len(out) == 40
    assert [r.x is None for r in out] == [bool(r.blink) for r in out] and 3 <= sum(r.blink for r in out) <= 6
    assert all(abs(r.x - r.t / 10) < 0.5 for r in out if r.x is not None and 0 < r.t < 380)


def test_imputed_rows_keep_raw_values(spark):
    rows = [("k", i, float(i % 3), 1.0, 1.0, 0.0, 0.0, 0.0, "External", int(3 <= i < 5)) for i in range(10)]
    df = spark.createDataFrame(rows, "key string, t int, x double, y double, z double, hx double, hy double, hz double, label string, blink int")
    out = signal.impute_blinks(df, ["key"], ["t"], "t", "blink", ["x", "y", "z"], ["hx", "hy", "hz"], "label").orderBy("t").collect()
    assert [r.x for r in out] == [float(i % 3) for i in range(10)] and [r.imputed for r in out] == [0, 0, 0, 1, 1, 0, 0, 0, 0, 0]


def test_layouts_and_truncation(spark):
    df = spark.createDataFrame([("a", 1, 2, None), ("b", 3, 4, 5.0), ("c", 5, 6, float("nan"))], "k string, old int, new int, probe double")
    got = {r.k: r.x for r in ingest.resolved_layout(df, {"x": "old"}, {"x": "new"}, "probe").collect()}
    assert got == {"a": 1, "b": 4, "c": 5}
    assert files.truncated(df.withColumn("f", F.lit(1)), ["f"], ["k"], 2).count() == 2
    got = files.gaze_rows(df, {"id": "s_1"}, ["new", "k"], F.lit("view"))
    assert got.columns == ["id", "epoch", "new", "k"] and files.numbered(got).select("row").distinct().count() == 3


def test_pair_stats_by_hand(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in (2, 4, 6, 8)] + [("c", 1.0)], "g string, v double")
    got = {(r.first, r.second): (r.t, r.d) for r in statistics.pair_stats(df, "g", ["v"]).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert got["a", "b"][1] == pytest.approx(-1.224745, abs=1e-6) and got["a", "b"][0] == pytest.approx(-1.224745 * 2**0.5, abs=1e-6)


def test_draws_about_means(spark):
    rows = statistics.hypothesis_draws(spark, {"a": 1.0, "b": 5.0}, 500, 0.1).collect()
    assert np.mean([r.value for r in rows if r.group == "a"]) == pytest.approx(1, abs=0.02) and len(rows) == 1_000


def test_levels_compute_only_what_is_missing(spark):
    df = spark.createDataFrame([(u, s, float(u + i)) for u in range(12) for s in ("enc", "ret") for i in range(3)], "u long, side string, x double").withColumn("c", F.col("u") % 2)
    asked = []

    def compute(s):
        asked.append(s.select("u").distinct().count())
        return s.groupBy("u", "side").agg(F.avg("x").alias("x"))

    whole = pipeline.levels(df, ["u", "side"], ["u"], "side", ["c"], compute)["condition"].orderBy("c").collect()
    done = compute(df.where("u < 8"))
    part = pipeline.levels(df, ["u", "side"], ["u"], "side", ["c"], compute, done=done)["condition"].orderBy("c").collect()
    assert whole == part and asked == [12, 8, 4]


def test_preprocess_query(spark):
    out = catalogue.QUERIES["q_preprocess"](spark, SF).toPandas()
    assert len(out) and out.x[out.blink == 0].notna().all() and out.x[out.blink == 1].isna().all()
