import pytest

from glintspan.operators import cleaning, islands, timecourse, transitions

KEY, ORDER = ["k"], ["t"]


def frame(spark, rows, cols="k string, t long, label string"):
    return spark.createDataFrame(rows, cols)


def column(df, *names, order=("k", "t")):
    out = [tuple(r) for r in df.orderBy(*order).select(*names).collect()]
    return [x[0] for x in out] if len(names) == 1 else out


def seq(spark, labels):
    return frame(spark, [("a", i * 10, x) for i, x in enumerate(labels)])


def test_merged_runs_and_entropy(spark):
    df = seq(spark, "AABACCB").selectExpr("*", "t + 10 AS t_end")
    merged = islands.merge_runs(df, KEY, ORDER, "label", "t", "t_end")
    assert column(merged, "label", order=("run",)) == list("ABACB")
    counts = transitions.transition_counts(df, KEY, ORDER, "label")
    assert {(r.from_label, r.to_label): r.n for r in counts.collect()} == {("A", "B"): 1, ("B", "A"): 1, ("A", "C"): 1, ("C", "B"): 1}
    shares = transitions.transition_shares(counts, KEY)
    assert transitions.joint_entropy(shares, KEY).first()["ht"] == pytest.approx(0.5)
    assert transitions.weighted_entropy(shares, transitions.label_weights(merged, KEY, "label"), KEY, "hn").first()["hn"] == pytest.approx(0.4)


def test_merge_is_idempotent(spark):
    once = islands.merge_runs(seq(spark, "AABBA").selectExpr("*", "t + 10 AS t_end"), KEY, ORDER, "label", "t", "t_end")
    twice = islands.merge_runs(once.drop("run", "n", "duration"), KEY, ["start"], "label", "start", "end")
    assert column(once, "label", "start", "end", order=("start",)) == column(twice, "label", "start", "end", order=("start",))


@pytest.mark.parametrize("flags, times, kept", [([1, 0, 1], [0, 50, 100], [0, 0, 0]), ([0, 1, 1], [0, 40, 80], [0, 1, 1]), ([1, 1, 1], [0, 40, 80], [1, 1, 1]), ([0], [0], [0]), ([1], [0], [0])])
def test_run_durations(spark, flags, times, kept):
    df = frame(spark, [("a", t, f) for t, f in zip(times, flags)], "k string, t long, f int")
    assert column(islands.drop_short_runs(df, KEY, ORDER, "f", "t", 75), "kept") == kept


def test_run_edges(spark):
    df = frame(spark, [("a", i, f) for i, f in enumerate([1, 1, 0, 1, 0, 1])], "k string, t long, f int")
    assert column(islands.run_edges(df, KEY, ORDER, "f"), "run_start", "run_end") == [(1, 0), (0, 1), (0, 0), (1, 1), (0, 0), (1, 1)]


def test_gap_and_missing_splits(spark):
    df = frame(spark, [("a", t, m) for t, m in [(0, 0), (10, 0), (100, 1), (110, 0), (120, 0), (300, 1), (310, 0)]], "k string, t long, m int")
    assert column(islands.split_by_gap(df, KEY, ORDER, "t", 50), "segment") == [0, 0, 1, 1, 1, 2, 2]
    assert column(islands.split_by_missing(df, KEY, ORDER, "m"), "t", "segment") == [(0, 0), (10, 0), (110, 1), (120, 1)]


def test_sandwich_repair(spark):
    df = frame(spark, [("a", i, x, float(i * i)) for i, x in enumerate("AABAA")], "k string, t long, label string, v double")
    out = column(cleaning.repair_sandwiches(df, KEY, ORDER, "label", ["v"]), "label", "v")
    assert [x for x, _ in out] == list("AAAAA") and out[2][1] == (1 + 9) / 2


def test_time_share(spark):
    df = frame(spark, [("a", 0, 0), ("a", 10, 1), ("a", 30, 0)], "k string, t long, f int")
    assert islands.time_share(df, KEY, ORDER, "t", df["f"] == 1).first()["share"] == pytest.approx(1 / 3)


def test_empty_and_single(spark):
    none = frame(spark, [])
    assert transitions.transition_counts(none, KEY, ORDER, "label").count() == 0
    assert islands.merge_runs(none.selectExpr("*", "t AS e"), KEY, ORDER, "label", "t", "e").count() == 0
    assert transitions.transition_counts(frame(spark, [("a", 0, "A")]), KEY, ORDER, "label").count() == 0


def test_interval_join_takes_starts_and_not_ends(spark):
    p = frame(spark, [("a", t, "x") for t in (0, 5, 9, 10, 15)])
    s = spark.createDataFrame([("a", 5, 10)], "k string, s long, e long")
    assert column(islands.intervals_join(p, s, KEY, "t", "s", "e", 4), "t") == [5, 9]


def test_time_split_repair(spark):
    good = [(f, f * 10) for f in range(50)]
    broken = [("a", f, t if f < 25 else t - 100_000) for f, t in good]
    out = column(cleaning.repair_time_splits(spark.createDataFrame(broken, "k string, f long, t long"), KEY, "f", "t"), "t", order=("k", "f"))
    assert out == [t for _, t in good]


def test_sliding_bins_hold_their_rows(spark):
    df = timecourse.sliding_bins(frame(spark, [("a", 75, "x")]), "t", 100, 50)
    assert column(df, "window_start", order=("window_start",)) == [0, 50]


def test_divergence_of_equal_matrices_is_zero(spark):
    s = transitions.transition_shares(transitions.transition_counts(seq(spark, "ABCABAC"), KEY, ORDER, "label"), KEY)
    assert transitions.symmetric_divergence(s, s.select(*[s[c].alias(c) for c in s.columns]), KEY).first()["d_kl"] == pytest.approx(0)
