import numpy as np
import pytest
from pyspark.sql import functions as F
from volgrid.operators import quality, stats

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def frame(spark):
    rows = [(1.0, 5.0, None), (2.0, 5.0, NAN), (4.0, 5.0, 3.0), (None, 5.0, 9.0)]
    return spark.createDataFrame(rows, "a double, b double, c double")


def test_missing_and_nan_do_not_poison(frame):
    one = stats.fit_norm(frame, ["a", "b", "c"]).first()
    assert one["mean"] == pytest.approx([7 / 3, 5.0, 6.0])
    assert one["std"] == pytest.approx([np.std([1, 2, 4]), 1e-6, 3.0])
    assert (one.count_seconds, one.source) == (4, "train")


def test_column_without_values(frame):
    one = stats.fit_norm(frame.select("a", F.lit(None).cast("double").alias("n")), ["n", "a"]).first()
    assert one["mean"][0] == 0 and one["std"][0] == 1 and one["std"][1] > 1
    assert stats.fit_norm(frame.limit(0), ["a"]).first()["std"] == [1.0]


def test_moments(frame):
    rows = {r.feature: r for r in stats.norm_moments(frame, ["a", "c"]).collect()}
    assert (rows["a"].total, rows["a"].total_sq, rows["a"].observed) == (7, 21, 3)
    assert (rows["c"].total, rows["c"].total_sq, rows["c"].observed) == (12, 90, 2)


def test_normalized_train_has_mean_0_std_1(spark):
    df = spark.range(5000).select((F.randn(1) * 3 + 7).alias("a"), F.rand(2).alias("b"))
    scaled = stats.apply_norm(df, stats.fit_norm(df, ["a", "b"]), ["a", "b"])
    row = scaled.agg(F.avg("a"), F.stddev_pop("a"), F.avg("b"), F.stddev_pop("b")).first()
    assert tuple(row) == pytest.approx((0, 1, 0, 1), abs=1e-9)


def test_nonfinite_report(spark):
    values = [(1.0,), (NAN,), (INF,), (-INF,), (None,)]
    report = quality.nonfinite_report(spark.createDataFrame(values, "a double"), ["a"]).first()
    assert tuple(report) == ("a", 1, 1, 2, 5)


@pytest.mark.parametrize("bad", [NAN, INF, -INF, None])
def test_require_finite_fails_the_job(spark, bad):
    df = spark.createDataFrame([(1.0,), (bad,)], "a double")
    with pytest.raises(Exception, match="non-finite value in a"):
        quality.require_finite(df, ["a"]).collect()


def test_require_finite_passes_good_rows(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "a double")
    assert quality.require_finite(df, ["a"], allow_nulls=True).count() == 2


def test_shapes(spark):
    good = [[1.0, 2.0]] * 3
    cases = [good, good[:2], [[1.0]] * 3, [[1.0, 2.0], None, [1.0, 2.0]], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x array<array<double>>")
    flags = [r[0] for r in df.orderBy("i").select(quality.has_shape("x", 2, 3)).collect()]
    assert flags == [True, False, False, False, False]
    assert tuple(quality.shape_report(df, 2, 3).first()) == (5, 4)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "a int, b int")
    assert [tuple(r) for r in quality.duplicate_keys(df, ["a", "b"]).collect()] == [(1, 1, 2)]
