import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from volgrid.operators import model
from volgrid.sources import requests
from volgrid.streaming import scoring

SECONDS, WIDTH = 5, 3
MEAN, STD = [1.0, 2.0, 3.0], [2.0, 1.0, 0.5]
SAMPLES = "id long, x array<array<float>>"


def mean_model():
    def load():
        return lambda x: np.nan_to_num(x).mean(axis=(1, 2))

    return load


# A function made inside a function travels by value: workers need not import this file.
load_mean = mean_model()


def tensors(n, seed=0):
    return np.random.default_rng(seed).normal(size=(n, SECONDS, WIDTH)).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(x)], SAMPLES)


def expected(x):
    scaled = (x - np.asarray(MEAN, np.float32)) / (np.asarray(STD, np.float32) + np.float32(1e-12))
    return np.nan_to_num(scaled).mean(axis=(1, 2))


def test_batch_scoring_equals_numpy(spark):
    x = tensors(700)
    scored = model.score_samples(frame(spark, x).repartition(3), load_mean, MEAN, STD, ["id"], SECONDS)
    got = {r.id: r.y_log_pred for r in scored.collect()}
    assert len(got) == 700
    for i, want in enumerate(expected(x)):
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_missing_values_reach_the_model_as_nan(spark):
    x = tensors(1).tolist()
    x[0][2][1] = None
    df = spark.createDataFrame([(0, x[0])], SAMPLES)
    row = model.score_samples(df, load_mean, MEAN, STD, ["id"], SECONDS).first()
    plain = np.array([[[np.nan if v is None else v for v in r] for r in x[0]]], np.float32)
    assert row.y_log_pred == pytest.approx(expected(plain)[0], rel=1e-4)


def test_wrong_shape_fails_the_batch(spark):
    df = spark.createDataFrame([(0, [[1.0, 2.0]] * SECONDS)], SAMPLES)
    with pytest.raises(Exception, match="samples must have shape"):
        model.score_samples(df, load_mean, MEAN, STD, ["id"], SECONDS).collect()


def test_model_must_answer_every_sample(spark):
    def load():
        return lambda x: x[:1, 0, 0]

    with pytest.raises(Exception, match="one value per sample"):
        model.score_samples(frame(spark, tensors(3)).coalesce(1), load, MEAN, STD, ["id"], SECONDS).collect()


def test_output_scales(spark):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "id int, y_log_pred double")
    real = [r.y_pred for r in model.sane_predictions(df).orderBy("id").collect()]
    assert real == pytest.approx([np.exp(0.5) - 1e-8, 1 - 1e-8])
    assert model.sane_predictions(df, "log").columns == df.columns
    with pytest.raises(ValueError):
        model.sane_predictions(df, "percent")


def request_rows(spark):
    x = tensors(7, seed=3)
    bodies = [
        ("three", json.dumps({"x": x[:3].tolist()})),
        ("four", json.dumps({"x": x[3:].tolist()})),
        ("narrow", json.dumps({"x": x[:1, :, :2].tolist()})),
        ("flat", json.dumps({"x": [1.0, 2.0]})),
        ("empty", json.dumps({"x": []})),
        ("broken", "{"),
    ]
    return x, spark.createDataFrame(bodies, scoring.REQUEST_SCHEMA)


def check_responses(x, rows):
    answers = {r.request_id: json.loads(r.response) for r in rows}
    want = np.exp(np.clip(expected(x), -20, 20)) - 1e-8
    assert answers["three"]["y"] == pytest.approx(want[:3].tolist(), rel=1e-3)
    assert answers["four"]["y"] == pytest.approx(want[3:].tolist(), rel=1e-3)
    for bad in ("narrow", "flat", "empty", "broken"):
        assert set(answers[bad]) == {"error"}, bad


def test_json_requests(spark):
    x, bodies = request_rows(spark)
    parsed = requests.parse_json_requests(bodies)
    answers = model.score_requests(parsed, load_mean, MEAN, STD, ["request_id"], SECONDS)
    check_responses(x, requests.encode_json_responses(answers).collect())


def test_request_stream(spark, tmp_path, monkeypatch):
    import volgrid.operators.model as m

    monkeypatch.setattr(m.score_requests, "__defaults__", (SECONDS,))
    x, bodies = request_rows(spark)
    bodies.repartition(3).write.json(str(tmp_path / "in"))
    stream = scoring.read_request_stream(spark, str(tmp_path / "in"))
    scoring.score_request_stream(
        stream, load_mean, MEAN, STD, str(tmp_path / "out"), str(tmp_path / "progress"), available_now=True
    ).awaitTermination()
    check_responses(x, spark.read.parquet(str(tmp_path / "out")).collect())


def test_sample_stream_equals_batch_and_resumes(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(40, 600, WIDTH)).astype(np.float32)
    df = frame(spark, x)
    source, out, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))

    def run():
        stream = scoring.read_sample_stream(spark, source, df.schema, files_per_trigger=2)
        scoring.score_sample_stream(
            stream, load_mean, MEAN, STD, ["id"], out, progress, available_now=True
        ).awaitTermination()

    df.where("id < 25").repartition(5).write.parquet(source)
    run()
    df.where("id >= 25").repartition(2).write.mode("append").parquet(source)
    run()
    run()
    batch = model.sane_predictions(model.score_samples(df, load_mean, MEAN, STD, ["id"]))
    streamed = spark.read.parquet(out)
    assert streamed.count() == 40
    assert streamed.exceptAll(batch).isEmpty()


def test_fits_recover_a_linear_rule(spark):
    df = spark.range(400).select(
        F.randn(1).alias("a"), F.randn(2).alias("b")
    ).withColumn("y_log", 0.5 * F.col("a") - 0.25 * F.col("b") - 5)
    fitted = model.coefficients(model.fit_log_mse(df, ["a", "b"]))
    assert fitted["weights"] == pytest.approx([0.5, -0.25], abs=1e-8)
    assert fitted["intercept"] == pytest.approx(-5, abs=1e-8)


def test_mspe_fit_is_a_minimum(spark):
    df = spark.range(500).select(
        F.rand(1).alias("a"), (F.rand(2) * 0.1).alias("noise")
    ).withColumn("y_log", F.ln(0.01 + 0.02 * F.col("a") + 0.01 * F.col("noise")))
    best = model.coefficients(model.fit_mspe(df, ["a"]))

    def loss(slope, intercept):
        y = F.exp("y_log")
        rel = (F.lit(slope) * F.col("a") + F.lit(intercept) - y) / y
        return df.agg(F.avg(rel * rel)).first()[0]

    slope, intercept = best["weights"][0], best["intercept"]
    low = loss(slope, intercept)
    for d in (1e-4, -1e-4):
        assert loss(slope + d, intercept) > low
        assert loss(slope, intercept + d) > low


def test_synthetic_samples_repeat_and_look_normal(spark):
    keys = spark.range(40)
    first = requests.synthetic_samples(keys, 4, 50, seed=1)
    again = requests.synthetic_samples(keys.repartition(7), 4, 50, seed=1)
    assert first.exceptAll(again).isEmpty()
    x = np.array([r.x for r in first.collect()])
    assert x.shape == (40, 50, 4)
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05
    assert len(np.unique(x)) > 7900
    other = requests.synthetic_samples(keys, 4, 50, seed=2)
    assert not first.exceptAll(other).isEmpty()


@pytest.mark.parametrize("factor", [0.5, 2])
def test_requests_need_one_answer_per_sample(spark, factor):
    def load():
        return lambda x: np.zeros(int(len(x) * factor), np.float32)

    rows = [(f"r{i}", tensors(2, i).tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "request_id string, x array<array<array<float>>>")
    with pytest.raises(Exception, match="one value per sample"):
        model.score_requests(df, load, MEAN, STD, ["request_id"], SECONDS).collect()


def test_sanitized_scoring_clamps_and_refuses(spark):
    x = tensors(3)
    x[0, 0, 0], x[1, 1, 1], x[2, 2, 2] = 1e9, np.nan, -np.inf
    scored = model.score_samples(frame(spark, x), load_mean, MEAN, STD, ["id"], SECONDS, sanitize=True)
    scaled = (x - np.asarray(MEAN, np.float32)) / np.asarray(STD, np.float32)
    want = np.clip(np.nan_to_num(scaled, nan=0, posinf=0, neginf=0), -10, 10).mean(axis=(1, 2))
    got = {r["id"]: r["y_log_pred"] for r in scored.collect()}
    assert [got[i] for i in range(3)] == pytest.approx(want.tolist(), rel=1e-5)

    def broken():
        return lambda v: np.full(len(v), np.nan, np.float32)

    with pytest.raises(Exception, match="not finite"):
        model.score_samples(frame(spark, x), broken, MEAN, STD, ["id"], SECONDS, sanitize=True).collect()


def test_synthetic_samples_are_repeatable(spark):
    keys = spark.range(300).select(F.col("id").alias("k"))
    first = {r["k"]: r["x"] for r in requests.synthetic_samples(keys, 3, 4, seed=1).collect()}
    again = {r["k"]: r["x"] for r in requests.synthetic_samples(keys.coalesce(1), 3, 4, seed=1).collect()}
    assert first == again and len(first) == 300 and first[0] != first[1]
    assert requests.synthetic_samples(keys.limit(0), 3, 4).count() == 0


def test_synthetic_samples_of_distinct_keys_are_spread(spark):
    rows = spark.range(40, numPartitions=2).selectExpr("id % 20 AS a", "id % 20 AS b")
    samples = requests.synthetic_samples(rows.distinct(), 2, 3)
    # Small keys, placed by their columns already: still a task each for the session's partitions.
    assert samples.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert samples.count() == 20


def test_samples_reach_python_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(model, "MODEL_BATCH", 4)
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        samples = spark.range(10, numPartitions=1).selectExpr("id", "array(array(1.0f)) AS x")
        scored = model.score_samples(samples, lambda: lambda x: x[:, 0, 0], [0.0], [1.0], ["id"], seconds=1)
        assert int(spark.conf.get(key)) == 4 and scored.count() == 10
        spark.conf.set(key, "3")
        model.score_samples(samples, lambda: lambda x: x[:, 0, 0], [0.0], [1.0], ["id"], seconds=1)
        assert int(spark.conf.get(key)) == 3
    finally:
        spark.conf.set(key, before)
