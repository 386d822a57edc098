import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from glintspan.functions import geometry as geo
from glintspan.functions import measures
from glintspan.plans.registry import Registry, first_time


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def array(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize("xs, slots, want", [([1, 1, 1, 1], None, 0), ([0, 0, 0, 1], None, 0.75), ([0.5, 0.1, 0.5, 0.1, 0.1, 0], None, 0.474359), ([0.25] * 4, 11, 0.636364)])
def test_gini(spark, xs, slots, want):
    assert value(spark, measures.gini(array(xs), slots)) == pytest.approx(want, abs=1e-6)


def test_entropy_and_kappa(spark):
    assert value(spark, measures.entropy(array([0.34, 0.12, 0.38, 0.16]))) == pytest.approx(1.849711, abs=1e-6)
    assert value(spark, measures.entropy(array([0.25] * 4))) == pytest.approx(2)
    assert value(spark, measures.kappa(F.lit(0.7), F.lit(0.5))) == pytest.approx(0.4)


def test_edit_similarity(spark):
    assert value(spark, F.levenshtein(F.lit("mtb"), F.lit("mxb"))) == 1
    assert value(spark, measures.indel_ratio(F.lit("mtb"), F.lit("mxb"))) == pytest.approx(4 / 6)
    assert value(spark, measures.indel_ratio(F.lit(""), F.lit(""))) == 1
    assert value(spark, measures.indel_ratio(F.lit(""), F.lit("a"))) == 0


@settings(max_examples=15, deadline=None)
@given(some.text("abc", max_size=7), some.text("abc", max_size=7))
def test_common_subsequence(spark, a, b):
    def lcs(x, y):
        return 0 if not x or not y else lcs(x[1:], y[1:]) + 1 if x[0] == y[0] else max(lcs(x[1:], y), lcs(x, y[1:]))

    assert value(spark, measures.common_subsequence(F.lit(a), F.lit(b))) == lcs(a, b)


def test_angles(spark):
    one, two = [F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0), F.lit(0.0)]
    assert value(spark, geo.angle_degrees(one, two)) == pytest.approx(90)
    assert value(spark, geo.angle_degrees(one, one)) == pytest.approx(0)
    assert value(spark, geo.angle_degrees(one, [F.lit(0.0)] * 3)) is None


def test_ray_sphere(spark):
    at = geo.ray_sphere([F.lit(0.0)] * 3, [F.lit(4.0), F.lit(0.0), F.lit(0.0)], [F.lit(2.0), F.lit(0.0), F.lit(0.0)], F.lit(1.0))
    assert value(spark, at) * 4 == pytest.approx(1)
    assert value(spark, geo.ray_sphere([F.lit(0.0)] * 3, [F.lit(4.0), F.lit(0.0), F.lit(0.0)], [F.lit(2.0), F.lit(5.0), F.lit(0.0)], F.lit(1.0))) is None


def test_rotation_and_spheres(spark):
    x, z = geo.rotate_about(F.lit(2.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(90.0))
    assert value(spark, x) == pytest.approx(1) and value(spark, z) == pytest.approx(2)
    back = geo.from_spherical(*geo.to_spherical(F.lit(1.0), F.lit(2.0), F.lit(2.0)))
    assert [value(spark, c) for c in back] == pytest.approx([1, 2, 2])


def test_hexagons_hold_their_centres(spark):
    for q, r in ((0, 0), (2, -1), (-3, 4)):
        x, y = math.sqrt(3) * (q + r / 2), 1.5 * r
        a, b = geo.hex_cell(F.lit(x), F.lit(y), 1.0)
        assert (value(spark, a), value(spark, b)) == (q, r)


def test_bounds_and_sentinels(spark):
    r = Registry()
    r.register("v", lambda c: F.max(c["v"]), "double", 0, 10)
    df = spark.createDataFrame([(1, -1.0), (2, 5.0), (3, 11.0), (4, None)], "k long, v double")
    w = r.evaluate(df, ["k"], {"v": "v"})
    assert [x.status for x in r.status(w, ["k"]).orderBy("k").collect()] == ["low", "ok", "high", "null"]
    assert [x.v for x in r.bounded(w).orderBy("k").collect()] == [-999, 5, 999, None]
    with pytest.raises(ValueError):
        r.register("v", first_time([], 0.0))


def test_unknown_label_is_an_error(spark):
    with pytest.raises(Exception, match="no code for label"):
        spark.createDataFrame([("x",)], "l string").select(measures.encode_labels(F.col("l"), [("a", "a")])).collect()
