import math
import random

import pytest
from pyspark.sql import functions as F
from volgrid.functions import losses, scalars

NAN, INF = float("nan"), float("inf")


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r[0] for r in df.orderBy("i").select(build("x")).collect()]


def test_sanitize(spark):
    values = [NAN, INF, -INF, None, -12.0, 3.0, 1e4]
    assert column(spark, values, scalars.sanitize) == [0, 0, 0, 0, -10, 3, 10]
    raw = column(spark, values, lambda c: scalars.sanitize(c, normalized=False))
    assert raw == [0, 0, 0, 0, -12, 3, 1000]


def test_output_guard(spark):
    values = [NAN, INF, -INF, None, 3.0]
    assert column(spark, values, scalars.safe_log_prediction) == [0, 50, -50, 0, 3]
    real = column(spark, values, scalars.safe_exp)
    want = [math.exp(v) - 1e-8 for v in (0, 20, -20, 0, 3)]
    assert real == pytest.approx(want, rel=1e-12)


def test_log_label_round_trip(spark):
    values = [0.0, 1e-6, 0.004, 2.0]
    there = column(spark, values, scalars.log_label)
    assert there == pytest.approx([math.log(v + 1e-8) for v in values])
    back = column(spark, there, scalars.exp_label)
    assert back == pytest.approx(values, rel=1e-9, abs=1e-16)


def test_is_finite(spark):
    assert column(spark, [NAN, INF, -INF, None, 0.0], scalars.is_finite) == [False] * 4 + [True]


def test_rounding_is_that_of_decimals(spark):
    rng = random.Random(5)
    values = [NAN, INF, -INF, None, 0.0, -0.0, 1e300, -1e-300, 5e-7, -5e-7, 4.999e-7, 2147.4836475, -2147.483648, 1.0000005]
    values += [n / 1e6 + 5e-7 for n in range(-200, 200)] + [rng.uniform(-3000, 3000) for _ in range(500)]
    values += [rng.randint(-(10**7), 10**7) / 1e6 + 5e-7 + off for off in (1e-9, -1e-9, 1e-12) for _ in range(100)]
    values += [rng.gauss(0, 1e-5) for _ in range(500)]
    for digits in (3, 6, 8):
        quick = column(spark, values, lambda c, d=digits: scalars.round_half_up(c, d) + 0.0)
        assert [repr(v) for v in quick] == [repr(v) for v in column(spark, values, lambda c, d=digits: F.round(c, d) + 0.0)]


def test_gradient_against_numeric_derivative(spark):
    rows = [(math.log(0.005), math.log(0.004)), (-4.0, -5.0), (0.3, -0.2)]
    df = spark.createDataFrame(rows, "p double, y double")
    step = 1e-6
    up, down = F.col("p") + step, F.col("p") - step
    numeric = (
        losses.squared_percentage_error(up, "y") - losses.squared_percentage_error(down, "y")
    ) / (2 * step * len(rows))
    for analytic, measured in df.select(losses.mspe_gradient("p", "y", F.lit(len(rows))), numeric).collect():
        assert analytic == pytest.approx(measured, rel=1e-4, abs=1e-5)


def test_loss_against_plain_arithmetic(spark):
    df = spark.range(4096).select(
        F.randn(0).cast("float").alias("p"), F.randn(1).cast("float").alias("y")
    )
    rows = df.collect()
    eps = 1e-8
    terms = [
        ((math.exp(p) - math.exp(y)) / (math.exp(y) - eps + eps)) ** 2 for p, y in rows
    ]
    got = df.agg(losses.mspe_from_log("p", "y")).first()[0]
    assert got == pytest.approx(sum(terms) / len(terms), rel=1e-5, abs=1e-6)
