import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from volgrid.operators import split
from volgrid.plans import jobs
from volgrid.schemas import FEATURES
from volgrid.sources import fixtures, tables


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """Label CSV, book and trade tables as files."""
    root = str(tmp_path_factory.mktemp("raw"))
    fixtures.labels(spark, sf_dir, 8).coalesce(1).write.option("header", True).csv(f"{root}/labels")
    tables.write_by_stock(fixtures.book(spark, sf_dir, 8), f"{root}/book")
    tables.write_by_stock(fixtures.trade(spark, sf_dir, 8), f"{root}/trade")
    return root


@pytest.fixture(scope="module")
def built(spark, sf_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("built"))
    labels = fixtures.labels(spark, sf_dir, 8)
    book, trade = fixtures.book(spark, sf_dir, 8), fixtures.trade(spark, sf_dir, 8)
    jobs.build_job(spark, labels, book, trade, out, shard_size=64)
    return out


def zero_model():
    def load():
        return lambda x: np.zeros(len(x))

    return load


def run(monkeypatch, *arguments):
    monkeypatch.setattr(sys, "argv", ["jobs", *arguments])
    jobs.main()


def test_stages_from_files_to_report(spark, stored, tmp_path, monkeypatch):
    run(
        monkeypatch, "index", "--labels", f"{stored}/labels", "--out", f"{tmp_path}/index",
        "--eval-fraction", "0.25", "--validation-fraction", "0.15",
    )
    index = tables.read_index(spark, f"{tmp_path}/index")
    total = tables.read_labels_csv(spark, f"{stored}/labels").count()
    assert index.count() == total
    assert {r.split for r in index.select("split").distinct().collect()} == set(split.SPLITS)

    run(
        monkeypatch, "build", "--index", f"{tmp_path}/index", "--book", f"{stored}/book",
        "--trade", f"{stored}/trade", "--out", f"{tmp_path}/built", "--shard-size", "32",
        "--unique-slots",
    )
    samples = tables.read_samples(spark, f"{tmp_path}/built/samples")
    assert samples.count() == total
    kept = samples.select("stock_id", "time_id", "split")
    assert kept.exceptAll(index.select(*kept.columns)).isEmpty()
    for name in split.SPLITS:
        sizes = {
            r.shard_id: r["count"]
            for r in tables.read_samples(spark, f"{tmp_path}/built/samples", name)
            .groupBy("shard_id").count().collect()
        }
        assert all(sizes[i] == 32 for i in range(len(sizes) - 1))
        manifest = tables.read_manifest(spark, f"{tmp_path}/built/manifest/{name}").first()
        assert manifest.num_shards == len(sizes) and manifest.shard_size == 32
        assert manifest.feature_cols == FEATURES and len(manifest.norm.mean) == len(FEATURES)
        train = index.where("split = 'train'").count()
        assert manifest.norm.count_seconds == (600 * train if name == "train" else 0)

    for loss in sorted(jobs.LOSSES):
        run(
            monkeypatch, "evaluate", "--built", f"{tmp_path}/built", "--loss", loss,
            "--out", f"{tmp_path}/{loss}",
        )
        report = spark.read.json(f"{tmp_path}/{loss}/report").first()
        assert report["count"] == index.where("split = 'eval'").count()
        # Some small buckets have a target of 0, so the percentage error has no upper bound here.
        assert 0 < report.rmse < 1 and 0 < report.rmspe < float("inf")
        epochs = spark.read.json(f"{tmp_path}/{loss}/epochs")
        assert epochs.count() == 4 and epochs.where("is_best").count() >= 1


def test_score_and_serve(spark, built, tmp_path, monkeypatch):
    manifest = f"{built}/manifest/train"
    monkeypatch.setattr(jobs, "_named", lambda name: zero_model())
    run(
        monkeypatch, "score", "--samples", f"{built}/samples", "--manifest", manifest,
        "--predictor", "any:model", "--out", f"{tmp_path}/scored",
    )
    scored = spark.read.parquet(f"{tmp_path}/scored")
    assert scored.count() == tables.read_samples(spark, f"{built}/samples").count()
    assert scored.where("abs(y_pred - 1) > 1e-7").isEmpty()

    sample = tables.read_samples(spark, f"{built}/samples").limit(3)
    bodies = sample.select(
        F.concat_ws("-", "stock_id", "time_id").alias("request_id"),
        F.to_json(F.struct(F.array("x").alias("x"))).alias("body"),
    )
    bodies.write.json(f"{tmp_path}/requests")
    run(
        monkeypatch, "serve", "--requests", f"{tmp_path}/requests", "--manifest", manifest,
        "--predictor", "any:model", "--out", f"{tmp_path}/answers",
        "--progress", f"{tmp_path}/progress", "--until-done",
    )
    answers = spark.read.parquet(f"{tmp_path}/answers")
    assert answers.count() == 3 and answers.where("response NOT LIKE '{\"y\":[0.99999999]}'").isEmpty()


def test_predictor_by_name():
    assert jobs._named("math:sqrt")(4) == 2


def test_fit_choice_and_report_against_numpy(spark, built):
    rows = jobs.model_rows(tables.read_samples(spark, f"{built}/samples"), jobs.read_norm(spark, built))
    chosen = ["log_rv", "rv_30s", "spread_last"]
    trained = jobs.fit_job(spark, rows, regs=(0.0,), features=chosen)
    report = jobs.evaluate_job(rows, trained).first()

    def part(name):
        table = rows.where(F.col("split") == name).select(*chosen, "y_log").collect()
        data = np.array([list(r) for r in table], dtype=float)
        return np.column_stack([data[:, :-1], np.ones(len(data))]), data[:, -1]

    x, y = part("train")
    weights = np.linalg.lstsq(x, y, rcond=None)[0]
    x, y = part("eval")
    error = np.exp(x @ weights) - np.exp(y)
    assert report["count"] == len(y)
    assert report.rmse == pytest.approx(np.sqrt(np.mean(error**2)), rel=1e-6)
    assert report.rmspe == pytest.approx(np.sqrt(np.mean((error / np.exp(y)) ** 2)), rel=1e-6)


def _evaluated(spark, sf_dir, out, columns, loss="log_mse"):
    labels = fixtures.labels(spark, sf_dir, 8)
    book, trade = fixtures.book(spark, sf_dir, 8), fixtures.trade(spark, sf_dir, 8)
    jobs.build_job(spark, labels, book, trade, out, shard_size=64, columns=columns)
    return jobs.train_eval_job(spark, out, loss)


@pytest.mark.parametrize("loss", jobs.LOSSES)
def test_evaluate_follows_the_feature_list(spark, sf_dir, built, tmp_path, loss):
    """A build in another order fits the same model; a shorter one uses what it has."""
    trained, report = jobs.train_eval_job(spark, built, loss)
    turned, turned_report = _evaluated(spark, sf_dir, f"{tmp_path}/turned", FEATURES[::-1], loss)
    assert turned.features == [*FEATURES[::-1], "log_rv"] and turned.reg == trained.reg
    a, b = report.first(), turned_report.first()
    assert a["count"] == b["count"] and a.rmse == pytest.approx(b.rmse, rel=1e-5)
    rows = jobs.model_rows(
        tables.read_samples(spark, f"{tmp_path}/turned/samples"), jobs.read_norm(spark, f"{tmp_path}/turned"), FEATURES[::-1]
    )
    plain = jobs.model_rows(tables.read_samples(spark, f"{built}/samples"), jobs.read_norm(spark, built))
    key = lambda r: (r["stock_id"], r["time_id"])
    for x, y in zip(sorted(rows.collect(), key=key), sorted(plain.collect(), key=key), strict=True):
        assert all(x[c] == pytest.approx(y[c], abs=1e-6) for c in (*FEATURES, "log_rv"))


def test_evaluate_with_few_features(spark, sf_dir, tmp_path):
    few = ["spread_last", "size", "rv_30s"]
    trained, report = _evaluated(spark, sf_dir, f"{tmp_path}/few", few)
    assert trained.features == few and report.first()["count"] > 0
    trained, report = _evaluated(spark, sf_dir, f"{tmp_path}/one", ["log_return"])
    assert trained.features == ["log_return", "log_rv"] and report.first()["rmse"] > 0


def test_boosted_stage(spark, built, tmp_path, monkeypatch):
    run(monkeypatch, "evaluate", "--built", built, "--model", "boosted", "--out", f"{tmp_path}/b")
    report = spark.read.json(f"{tmp_path}/b/report").first()
    wanted = tables.read_samples(spark, f"{built}/samples", "eval").count()
    assert report["count"] == wanted and 0 < report["rmse"] < 1
    fitted, again = jobs.boost_eval_job(spark, built)
    assert fitted.features == [*FEATURES, "log_rv"] and len(fitted.trees) == 20
    assert again.first()["rmspe"] == pytest.approx(report["rmspe"], rel=1e-6)


def test_report_and_epochs_of_stored_predictions(spark, tmp_path, monkeypatch):
    rows = [(s, e, i, float(i % 3), (0.1 * e - 0.2) ** 2 + i % 3 if (s, i) != ("eval", 0) else None) for s in split.SPLITS for e in range(4) for i in range(6)]
    names = "split string, epoch int, id int, y_log double, y_log_pred double"
    spark.createDataFrame(rows, names).write.partitionBy("epoch").parquet(f"{tmp_path}/p")
    run(monkeypatch, "epochs", "--predictions", f"{tmp_path}/p", "--out", f"{tmp_path}/e")
    epochs = {r["epoch"]: r for r in spark.read.json(f"{tmp_path}/e/epochs").collect()}
    assert [epochs[e]["metric"] for e in range(4)] == pytest.approx([abs(np.exp((0.1 * e - 0.2) ** 2) - 1) for e in range(4)], abs=1e-6)
    assert spark.read.json(f"{tmp_path}/e/best").first()["epoch"] == 2
    run(monkeypatch, "evaluate", "--predictions", f"{tmp_path}/p", "--split", "validation", "--by", "epoch", "--out", f"{tmp_path}/v")
    assert spark.read.json(f"{tmp_path}/v/report").count() == 4
    run(monkeypatch, "evaluate", "--predictions", f"{tmp_path}/p", "--missing", "skip", "--out", f"{tmp_path}/s")
    report = spark.read.json(f"{tmp_path}/s/report").first()
    assert (report["count"], report["missing"]) == (20, 4)


def test_latency_stage(spark, sf_dir, tmp_path, monkeypatch):
    fixtures.timings(spark, sf_dir).write.parquet(f"{tmp_path}/timings")
    run(monkeypatch, "latency", "--timings", f"{tmp_path}/timings", "--out", f"{tmp_path}/report")
    modes = spark.read.json(f"{tmp_path}/report")
    assert modes.count() == 5 and modes.where("p99_ms >= p95_ms AND p95_ms >= p50_ms").count() == 5


def test_scans_prune(spark, stored):
    book = tables.read_book(spark, f"{stored}/book")
    plan = (
        tables.bucket_lookup(book, 3, 5).select("bid_price1")
        ._jdf.queryExecution().executedPlan().toString()
    )
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "stock_id" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "EqualTo(time_id,5)" in scan
    assert "ask_size1" not in scan.split("ReadSchema:")[1]
    assert tables.bucket_lookup(book, 3, 5).count() == book.where(
        (F.col("stock_id") == 3) & (F.col("time_id") == 5)
    ).count()


def test_split_scan_reads_one_folder(spark, stored, tmp_path):
    index = split.assign_split(tables.read_labels_csv(spark, f"{stored}/labels"))
    tables.write_index(index, f"{tmp_path}/index")
    part = tables.read_index(spark, f"{tmp_path}/index", "validation")
    assert len(part.inputFiles()) >= 1
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "split" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert part.count() == index.where("split = 'validation'").count()
