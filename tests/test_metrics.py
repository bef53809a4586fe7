import math

import pytest
from pyspark.sql import functions as F
from volgrid.operators import latency, metrics

PAIRS = "pred_log double, y_log double"


def test_empty_input_gives_zero(spark):
    empty = spark.createDataFrame([], PAIRS)
    assert tuple(metrics.eval_report(empty).first()) == (0.0, 0.0, 0)
    assert metrics.rmspe_from_batches(spark.createDataFrame([], "loss double, n long")).first()[0] == 0.0


def test_report_by_hand(spark):
    rows = [(math.log(2 + 1e-8), math.log(1 + 1e-8)), (math.log(3 + 1e-8), math.log(6 + 1e-8))]
    report = metrics.eval_report(spark.createDataFrame(rows, PAIRS)).first()
    assert report.rmse == pytest.approx(math.sqrt((1 + 9) / 2), rel=1e-6)
    assert report.rmspe == pytest.approx(math.sqrt((1 + 0.25) / 2), rel=1e-6)
    assert report["count"] == 2


def test_batched_rmspe_equals_row_level(spark):
    df = spark.range(1000).select(
        (F.col("id") % 7).alias("batch"), F.randn(3).alias("pred_log"), F.randn(4).alias("y_log")
    )
    batched = metrics.rmspe_from_batches(metrics.batch_losses(df, ["batch"])).first()[0]
    assert batched == pytest.approx(math.sqrt(metrics.mspe(df).first()[0]), rel=1e-12)


def test_running_metric_emits_whole_intervals_only(spark):
    rows = [(e, s, float(s + e), 2) for e, last in ((0, 1007), (1, 400), (2, 199)) for s in range(1, last + 1)]
    steps = spark.createDataFrame(rows, "epoch int, step long, loss double, n long")
    got = {(r.epoch, r.step): (r.n, r.metric) for r in metrics.running_metric(steps).collect()}
    assert set(got) == {(0, s) for s in (200, 400, 600, 800, 1000)} | {(1, 200), (1, 400)}
    for (epoch, step), (n, metric) in got.items():
        mean = sum(s + epoch for s in range(1, step + 1)) / step
        assert n == 2 * step and metric == pytest.approx(math.sqrt(mean))


def test_running_metric_over_many_blocks(spark):
    steps = spark.range(1, 5001).select(
        F.lit(0).alias("epoch"), F.col("id").alias("step"), F.col("id").cast("double").alias("loss"),
        F.lit(1).cast("long").alias("n"),
    )
    got = metrics.running_metric(steps, interval=2).collect()
    assert len(got) == 2500
    for r in got:
        assert r.metric == pytest.approx(math.sqrt((r.step + 1) / 2))


def test_first_of_a_tie_is_best(spark):
    epochs = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 2.0), (3, 1.0), (4, 5.0)], "epoch int, metric double")
    flags = [r.is_best for r in metrics.best_so_far(epochs).orderBy("epoch").collect()]
    assert flags == [True, True, False, True, False]
    assert metrics.best_epoch(epochs.where("epoch < 3")).first().epoch == 1


def floor_rank(values, p):
    values = sorted(values)
    return values[max(0, min(len(values) - 1, int(p * len(values)) - 1))]


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [float(i) for i in range(20)],
        [7.5] * 1000 + [1.0, 9.0],
        [0.0, -1.5, -3.0, 1e-300, 1e300, 2.0, -1e300, 0.0],
        [33.4 + i * 1e-9 for i in range(3000)],
        [math.exp(math.sin(i) * 3) for i in range(2006)],
    ],
    ids=["one", "twenty", "hot value", "signs", "narrow", "spread"],
)
def test_floor_rank_percentiles(spark, values):
    df = spark.createDataFrame([("m", v) for v in values], "mode string, latency_ms double")
    row = latency.latency_summary(df.repartition(5), 32, ["mode"]).first()
    assert row["p50_ms"] == floor_rank(values, 0.50)
    assert row["p95_ms"] == floor_rank(values, 0.95)
    assert row["p99_ms"] == floor_rank(values, 0.99)
    assert row["count"] == len(values)
    # Sums of values that cancel are only as good as the largest one.
    tolerance = 1e-9 + 1e-12 * max(map(abs, values))
    assert row.mean_ms == pytest.approx(math.fsum(values) / len(values), abs=tolerance)


def test_value_ranges_keep_order(spark):
    df = spark.range(20_000).select((F.randn(1) * F.exp(F.randn(2) * 50)).alias("v"))
    ranged = df.withColumn("r", latency.value_range(F.col("v"))).orderBy("v")
    ranges = [r.r for r in ranged.collect()]
    assert ranges == sorted(ranges)


def test_percentiles_read_the_rows_once(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("mode"), F.abs(F.randn(5)).alias("latency_ms"))
    values = {m: [r[1] for r in df.collect() if r[0] == m] for m in range(3)}
    report = latency.percentiles(df, ["mode"])
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan  # what was read is combined already
    for row in report.collect():
        assert row.p95_ms == floor_rank(values[row.mode], 0.95)


def test_hot_values_and_null_groups_stay(spark):
    rows = [("hot", 1.0)] * 5000 + [("hot", float(i)) for i in range(100)] + [(None, 5.0), (None, 7.0), ("none", None), ("none", None)]
    got = {r["mode"]: r for r in latency.latency_summary(spark.createDataFrame(rows, "mode string, latency_ms double"), 1, ["mode"]).collect()}
    assert set(got) == {"hot", None, "none"}
    assert got["hot"].p50_ms == 1.0 and got["hot"]["count"] == 5100
    assert got[None]["count"] == 2 and got[None].mean_ms == 6.0 and got[None].p99_ms == 5.0
    assert got["none"]["count"] == 0 and got["none"].p50_ms is None and got["none"].mean_ms is None


def test_missing_predictions_do_not_flatter(spark):
    rows = [(0, math.log(2), 0.0), (0, None, 0.0), (1, float("nan"), 0.0), (1, 0.0, None)]
    df = spark.createDataFrame(rows, "batch int, pred_log double, y_log double")
    for call in (metrics.mspe, metrics.log_mse, metrics.eval_report, metrics.mspe_gradient, lambda d: metrics.batch_losses(d, ["batch"])):
        with pytest.raises(Exception, match="non-finite"):
            call(df).collect()
    report = metrics.eval_report(df, missing="skip").first()
    assert report.rmspe == pytest.approx(1.0, rel=1e-6) and report["count"] == 1 and report.missing == 3
    assert metrics.mspe(df, missing="skip").first()[0] == pytest.approx(1.0, rel=1e-6)
    batches = metrics.batch_losses(df, ["batch"], missing="skip")
    assert sorted(r["n"] for r in batches.collect()) == [0, 1]
    assert metrics.rmspe_from_batches(batches).first()[0] == pytest.approx(1.0, rel=1e-6)
    slopes = [r["gradient"] for r in metrics.mspe_gradient(df, missing="skip").collect()]
    assert slopes.count(None) == 3 and max(s for s in slopes if s) == pytest.approx(4.0, rel=1e-6)


def test_a_missing_metric_never_wins(spark):
    rows = [(0, None), (1, 0.5), (2, float("nan")), (3, 0.4), (4, None)]
    epochs = spark.createDataFrame(rows, "epoch int, metric double")
    assert metrics.best_epoch(epochs).first()["epoch"] == 3
    flags = {r["epoch"]: r["is_best"] for r in metrics.best_so_far(epochs).collect()}
    assert flags == {0: False, 1: True, 2: False, 3: True, 4: False}
    steps = spark.createDataFrame([(0, None, 2), (0, float("nan"), 2), (1, 4.0, 1), (1, None, 9)], "epoch int, loss double, n long")
    assert {r["epoch"]: r["metric"] for r in metrics.epoch_metric(steps).collect()} == {0: None, 1: 2.0}


def test_throughput_and_settings(spark):
    df = spark.createDataFrame([("serial", 500.0), ("serial", 1500.0), ("concurrent", 250.0)], "mode string, latency_ms double")
    rows = {r["mode"]: r for r in latency.latency_report(df, 32, {"iters": 2}).collect()}
    assert rows["serial"].throughput_qps == pytest.approx(2 * 32 / 2.0)
    assert rows["concurrent"].total_s == 0.25
    assert rows["serial"].config.iters == 2
