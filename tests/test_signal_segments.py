import numpy as np
import pytest

from glintspan.operators import aoi, compare, segments, signal
from glintspan.operators import relational as rel
from glintspan.operators import statistics as st


def test_butterworth_coefficients():
    assert signal.butterworth(1000, 40) == pytest.approx((0.11216024, -0.77567951), abs=1e-7)
    assert signal.butterworth(1000, 20) == pytest.approx((0.05919070, -0.88161846), abs=2e-7)


def test_filters_keep_constants():
    x = np.full(300, 3.0)
    assert signal.zero_lag(x, 1000, 40) == pytest.approx(x, abs=1e-6)
    assert signal.median_filter(np.array([1.0, 9, 2, 3, 4]), 3).tolist() == [1, 2, 3, 3, 3]
    assert signal.mean_filter(np.array([1.0, 2, 6, 4, 5]), 3).tolist() == pytest.approx([1, 3, 4, 5, 5])
    assert signal.wiener(np.ones(10))[3] == pytest.approx(1)


def test_resampling():
    grid, y = signal.upsample(np.array([0.0, 4, 6]), np.array([0.0, 4, 0]))
    assert grid.tolist() == list(range(7)) and y.tolist() == [0, 1, 2, 3, 4, 2, 0]
    assert signal.downsample(grid, y, np.array([0.0, 4, 6])).tolist() == [0, 4, 0]
    with pytest.raises(ValueError):
        signal.downsample(grid, y, np.array([0.0, 0, 6]))
    assert signal.downsample_flags(grid, np.array([0, 1, 1, 1, 0, 0, 0]), np.array([0.0, 4, 6])).tolist() == [0, 1, 0]


def test_viterbi_finds_the_slow_middle():
    x = np.array([90.0, 95, 8, 12, 9, 100])
    s = segments.viterbi(x, np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([10.0, 95.0]), np.array([25.0, 100.0]))
    assert s.tolist() == [1, 1, 0, 0, 0, 1]
    fit = segments.fit_hidden_states(np.concatenate([np.random.default_rng(0).normal(10, 2, 300), np.random.default_rng(1).normal(90, 5, 100)]))
    assert sorted(fit["mean"]) == pytest.approx([10, 90], abs=2)


def test_detectors_on_a_jump(spark):
    rows = [("a", i * 20, *((1.0, 0.0, 0.0) if i < 10 else (0.0, 1.0, 0.0)), "x") for i in range(20)]
    df = spark.createDataFrame(rows, "k string, t long, x double, y double, z double, label string").selectExpr("*", "0D AS hx", "0D AS hy", "0D AS hz")
    fast = segments.angular_speed(df, ["k"], ["t"], "t", ["x", "y", "z"])
    flags = [r.fixation for r in segments.by_speed(fast, ["k"], ["t"], "t", "angular_speed", "label", most=1, least=75).orderBy("t").collect()]
    assert flags == [1] * 10 + [0] + [1] * 9
    flags = [r.fixation for r in segments.by_dispersion(df, ["k"], ["t"], "t", ["x", "y", "z"], ["hx", "hy", "hz"]).orderBy("t").collect()]
    assert flags == [1] * 20
    table = segments.segment_table(segments.by_speed(fast, ["k"], ["t"], "t", "angular_speed", "label", most=1, least=75), ["k"], ["t"], "t", "fixation", "label", ["x", "y", "z"])
    got = [(r.kind, r.start, r.end) for r in table.orderBy("start", "kind").collect()]
    assert got == [("fixation", 0, 180), ("saccade", 180, 220), ("fixation", 220, 380)]


def test_scan_paths():
    p = (np.array([0.0, 10, 20, 30]), np.array([0.0, 0, 10, 0]), np.array([1.0, 2, 1, 2]))
    same = compare.scan_path_similarity(p, p, (100, 100))
    assert all(v == pytest.approx(1) for v in same.values())
    assert compare.scan_path_similarity((p[0][:2], p[1][:2], p[2][:2]), p, (100, 100)) is None


def test_cohens_d(spark):
    df = spark.createDataFrame([(0, True, float(v)) for v in (1, 2, 3, 4)] + [(0, False, float(v)) for v in (2, 4, 6, 8)], "k int, s boolean, v double")
    assert st.cohens_d(df, ["k"], df["s"], "v").first()["d"] == pytest.approx(-1.224745, abs=1e-6)


def test_permutations_keep_group_sizes(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(12)], "m long, g string")
    out = st.permute_groups(df, "m", "g", repeats=3)
    assert {(r.repeat, r.g): r["count"] for r in out.groupBy("repeat", "g").count().collect()} == {(r, g): n for r in range(3) for g, n in (("a", 8), ("b", 4))}


def test_nearest_of_group_in_parts(spark):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, size=(60, 2)).astype(float)
    data = [(i, i % 2, [float(v) for v in p]) for i, p in enumerate(points)] + [(90, 0, None), (91, 0, [1.0]), (92, None, [1.0, 1.0]), (93, 1, [None, 1.0])]
    df = spark.createDataFrame(data, "row long, g int, v array<double>")
    want = {}
    for i in range(60):
        want[i] = min((round(float(np.linalg.norm(points[i] - points[j])), 6), j) for j in range(60) if j != i and i % 2 == j % 2)
    for part in (4, 2048):
        assert {r.row: (r.distance, r.nearest) for r in rel.nearest_of_group(df, "row", "g", "v", part=part).collect()} == want


def test_leaders_in_order(spark):
    rng = np.random.default_rng(4)
    data = [("k", i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 5, size=(200, 2)))] + [("k", 500, None, 1.0), ("one", 0, 0.0, 0.0)]
    got = {(r.key, r.at): r.sub_area for r in aoi.leader_clusters(spark.createDataFrame(data, "key string, at int, x double, y double"), ["key"], ["at"], "x", "y", 1.0).collect()}
    leaders, want = [], {("k", 500): None, ("one", 0): "Table_1"}
    for _, i, x, y in data[:200]:
        near = [n for n, (a, b) in enumerate(leaders) if np.hypot(a - x, b - y) <= 1.0]
        if not near:
            leaders.append((x, y))
        want["k", i] = f"Table_{near[0] + 1 if near else len(leaders)}"
    assert got == want


def test_labels_dealt_in_ranges_are_those_of_one_sort(spark):
    data = [(i, "ab"[i % 3 == 0] if i % 7 else None) for i in range(50)]
    df = spark.createDataFrame(data, "m long, g string")
    got = {n: sorted((r.repeat, r.m, r.g or "") for r in st.permute_groups(df, "m", "g", repeats=4, ranges=n).collect()) for n in (1, 7, 1024)}
    assert got[1] == got[7] == got[1024] and len(got[1]) == 200
    assert all(sorted(g for k, _, g in got[1] if k == r) == sorted(g or "" for _, g in data) for r in range(4))
