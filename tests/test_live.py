"""Live latency and live features: late and repeated rows, restarts, bounded state."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from volgrid.operators import features as batch
from volgrid.operators import latency as exact
from volgrid.schemas import BOOK_VALUES, FEATURES, SECOND, TRADE_VALUES
from volgrid.streaming import features as live
from volgrid.streaming import latency
from volgrid.streaming.moments import read_row_stream

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def run_latency(spark, folder, batches, by=("mode",), every="1 minute", delay="2 minutes"):
    """One run of the stream per batch of rows, each from the checkpoint of the one before."""
    schema = "request_id string, mode string, ts timestamp, latency_ms double"
    histograms = None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = read_row_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
        histograms = latency.latency_histograms(stream, list(by), every, delay)
        latency.write_histograms(histograms, f"{folder}/out", f"{folder}/progress", available_now=True).awaitTermination()
    return latency.read_histograms(spark, f"{folder}/out", histograms)


def timings(n, seed=1):
    rng = random.Random(seed)
    return [(f"r{i}", rng.choice(["a", "a", "b", None]), at(rng.random() * 600), rng.lognormvariate(2, 2)) for i in range(n)]


def test_ranges_are_narrow_and_hold_their_values(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 65, 127, 128, 1000, 123_456_789, 2**40 + 5, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    low, high = latency.range_of(F.col("v"))
    for r in df.select("v", low.alias("low"), high.alias("high")).collect():
        assert r["low"] <= r["v"] <= r["high"]
        assert r["v"] < 64 and r["low"] == r["high"] or (r["high"] - r["low"] + 1) / r["low"] <= 2 ** (1 - latency.BITS)


def test_bounds_hold_the_exact_percentiles(spark, tmp_path):
    rows = sorted(timings(3000), key=lambda r: r[2])
    # A last row far ahead lets the watermark pass all others.
    batches = [rows[:1200], rows[1200:2000], [*rows[2000:], ("end", "a", at(10_000), 1.0)]]
    counts = run_latency(spark, str(tmp_path), batches)
    table = spark.createDataFrame(rows, "request_id string, mode string, ts timestamp, latency_ms double")
    got = {r["mode"]: r for r in latency.latency_bounds(counts, ["mode"]).collect()}
    wanted = {r["mode"]: r for r in exact.latency_summary(table, 1, ["mode"]).collect()}
    assert got.keys() == wanted.keys() == {"a", "b", None}
    for mode, w in wanted.items():
        g = got[mode]
        assert g["count"] == w["count"] and g["invalid"] == 0
        assert g["mean_ms"] == pytest.approx(w["mean_ms"], abs=1e-3)
        for p in ("p50_ms", "p95_ms", "p99_ms"):
            # In whole microseconds.
            assert g[f"{p}_low"] - 0.0006 <= w[p] <= g[f"{p}_high"] + 0.0006
            assert g[f"{p}_high"] <= g[f"{p}_low"] * (1 + 2 ** (1 - latency.BITS)) + 0.002
    # The same counts by window, and merged without a group.
    windows = latency.latency_bounds(counts, ["window_start", "mode"])
    assert windows.agg(F.sum("count")).first()[0] == 3000
    assert latency.latency_bounds(counts, []).first()["count"] == 3000
    # On a table the histograms are the same.
    plain = latency.latency_bounds(latency.latency_histograms(table, ["mode"], "1 minute"), ["mode"])
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in got.values()}


def test_repeated_and_late_rows(spark, tmp_path):
    first = [(f"r{i}", "a", at(i), 10.0) for i in range(60)] + [("r5", "a", at(5), 10.0), ("r6", "a", at(6), 10.0)]
    # Sent again in a later run, but within the delay; on time though out of order; one too late.
    second = [("r59", "a", at(59), 10.0), ("late-but-fine", "a", at(30), 20.0), ("ahead", "a", at(1000), 1.0)]
    third = [("too-late", "a", at(40), 99.0), ("end", "a", at(3000), 1.0)]
    counts = run_latency(spark, str(tmp_path), [first, second, third])
    window = counts.where(F.col("window_start") == F.lit(START)).groupBy().agg(F.sum("n"), F.max("most")).first()
    assert tuple(window) == (61, 20_000)


def test_invalid_values_count_apart(spark):
    values = [None, math.nan, math.inf, -math.inf, -1.0, 0.0, 5.0]
    table = spark.createDataFrame([(str(i), "a", at(i), v) for i, v in enumerate(values)], "request_id string, mode string, ts timestamp, latency_ms double")
    row = latency.latency_bounds(latency.latency_histograms(table, ["mode"]), ["mode"]).first()
    assert (row["count"], row["invalid"], row["p50_ms_low"], row["p99_ms_high"]) == (2, 5, 0.0, 0.0)
    only = latency.latency_bounds(latency.latency_histograms(table.limit(3), ["mode"]), ["mode"]).first()
    assert only["count"] == 0 and only["mean_ms"] is None and only["p50_ms_low"] is None
    assert latency.latency_bounds(latency.latency_histograms(table.limit(0), ["mode"]), ["mode"]).count() == 0


# --- features while a bucket fills -----------------------------------------------------------

BOOK_SCHEMA = f"stock_id int, time_id int, {SECOND} int, ts timestamp, bid_price1 double, ask_price1 double, bid_size1 long, ask_size1 long"
TRADE_SCHEMA = f"stock_id int, time_id int, {SECOND} int, ts timestamp, size long, order_count long"
#: Two buckets that overlap in time, and one that is empty.
BUCKETS = {(1, 1): 0, (2, 1): 300, (3, 1): 0}


def market(seed=3):
    rng = random.Random(seed)
    book, trade = [], []
    for (stock, time), start in BUCKETS.items():
        if stock == 3:
            continue
        price = 1.0
        for s in range(600):
            if rng.random() < 0.3:
                price *= math.exp(rng.gauss(0, 0.001))
                bid = None if rng.random() < 0.1 else price if rng.random() > 0.02 else -price
                book.append((stock, time, s, at(start + s), bid, price * 1.001, rng.randint(0, 50), rng.randint(1, 50)))
            if rng.random() < 0.1:
                trade.append((stock, time, s, at(start + s), None if rng.random() < 0.1 else rng.randint(1, 99), rng.randint(1, 5)))
    return book, trade


def run_features(spark, folder, parts, delay="20 seconds"):
    """One run per (book, trade, index) part."""
    for book, trade, index in parts:
        rows = live.bucket_rows(
            spark.createDataFrame(book, BOOK_SCHEMA), spark.createDataFrame(trade, TRADE_SCHEMA),
            spark.createDataFrame(index, "stock_id int, time_id int, ts timestamp"),
        )
        rows.coalesce(2).write.mode("append").parquet(f"{folder}/in")
        stream = read_row_stream(spark, f"{folder}/in", rows.schema)
        live.write_features(live.live_features(stream, delay), f"{folder}/out", f"{folder}/progress", True).awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    return {(r["stock_id"], r["time_id"], r[SECOND]): [None if r[c] != r[c] else r[c] for c in FEATURES] for r in found.collect()}, found.count()


def by_batch(spark, book, trade):
    index = spark.createDataFrame([(s, t) for s, t in BUCKETS], "stock_id int, time_id int")
    frame = batch.bucket_features(
        index, spark.createDataFrame(book, BOOK_SCHEMA).drop("ts"), spark.createDataFrame(trade, TRADE_SCHEMA).drop("ts")
    )
    return {(r["stock_id"], r["time_id"], r[SECOND]): [r[c] for c in FEATURES] for r in frame.collect()}


def same(got, wanted):
    return all((a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-12)) for a, b in zip(got, wanted, strict=True))


def test_live_features_are_the_batch_features(spark, tmp_path):
    """Four runs, rows out of order within the delay, copies of rows, an empty bucket."""
    book, trade = market()
    rng = random.Random(9)
    index = [(s, t, at(start)) for (s, t), start in BUCKETS.items()]
    cuts = [0, 200, 450, 700, 100_000]
    parts = []
    for low, high in zip(cuts, cuts[1:]):
        def mine(rows):
            # Some rows arrive in the run after their own.
            late = {id(r): r for r in rows if rng.random() < 0.5 and any(0 < c - (r[3] - START).total_seconds() < 10 for c in cuts[1:-1])}
            return [r for r in rows if low <= (r[3] - START).total_seconds() < high and id(r) not in late]

        parts.append([mine(book), mine(trade), [i for i in index if low <= (i[2] - START).total_seconds() < high]])
    done_book = [r for p in parts for r in p[0]]
    done_trade = [r for p in parts for r in p[1]]
    for rows, done, which in ((book, done_book, 0), (trade, done_trade, 1)):
        for r in rows:
            if r not in done:
                run = next(i for i, c in enumerate(cuts[1:]) if (r[3] - START).total_seconds() < c)
                parts[run + 1][which].append(r)
    parts[1][0] += parts[1][0][:5]
    # A bucket far ahead lets the watermark pass the ends of the others.
    parts[-1][2].append((9, 9, at(50_000)))
    got, n = run_features(spark, str(tmp_path), parts)
    wanted = by_batch(spark, book, trade)
    assert n == len(got) == 1800 and got.keys() == wanted.keys()
    assert all(same(got[k], wanted[k]) for k in wanted)


def test_seconds_are_emitted_when_they_are_final(spark, tmp_path):
    book, trade = market()
    index = [(s, t, at(start)) for (s, t), start in BUCKETS.items()]
    early = [[r for r in rows if (r[3] - START).total_seconds() < 400] for rows in (book, trade)]
    latest = max((r[3] - START).total_seconds() for rows in early for r in rows)
    got, _ = run_features(spark, str(tmp_path), [(*early, index)])
    for (stock, time), start in BUCKETS.items():
        seconds = sorted(s for k, t, s in got if (k, t) == (stock, time))
        assert seconds == list(range(max(0, min(600, int(latest - 20 - start)))))


def test_rows_that_differ_fail_and_state_stays_small():
    bucket = live._Bucket(None)
    for s in range(600):
        bucket.add(s, live.BOOK, (1.0, 1.1, 5.0, 5.0, math.nan, math.nan))
        bucket.add(s, live.BOOK, (1.0, 1.1, 5.0, 5.0, math.nan, math.nan))
        bucket.add(s, live.TRADE, (math.nan,) * 4 + (3.0, 1.0))
    assert len(bucket.held) == 1200
    with pytest.raises(ValueError):
        bucket.add(3, live.BOOK, (1.0, 1.2, 5.0, 5.0, math.nan, math.nan))
    for _ in range(500):
        bucket.second()
    bucket.start = 0
    state = bucket.state()
    assert len(state[8]) == 120 and len(state[9]) == 60 and len(state[10]) == 200
    # It goes on from its state as if it had never been stored.
    again = live._Bucket(state)
    assert [again.second() for _ in range(100)] == [bucket.second() for _ in range(100)]
    assert not bucket.held and len(BOOK_VALUES) + len(TRADE_VALUES) == 6


def test_many_seconds_at_once_are_those_of_single_steps():
    at_once, single = live._Bucket(None), live._Bucket(None)
    for bucket in (at_once, single):
        for s in range(0, 600, 7):
            bid = math.nan if s % 5 == 0 else 1.0 + s / 1000
            bucket.add(s, live.BOOK, (bid, 1.5 + s % 3, 5.0 + s % 11, 6.0, math.nan, math.nan))
            bucket.add(s + 1, live.TRADE, (math.nan,) * 4 + (math.nan if s % 4 == 0 else 3.0, float(s % 6)))
    for final in (3, 200, 600):
        columns = at_once.seconds(final)
        rows = list(zip(*(c.tolist() for c in columns.values()), strict=True))
        steps = [single.second() for _ in rows]
        assert [[repr(v) for v in r] for r in rows] == [[repr(v) for v in r] for r in steps]
        assert repr(at_once.state()) == repr(single.state())
    assert not at_once.held


def test_several_buckets_at_once_are_those_of_single_ones():
    together, wanted = live._Seconds(), []
    for b in range(5):
        at_once, single = live._Bucket(None), live._Bucket(None)
        for bucket in (at_once, single):
            for s in range(b, 600, 5 + b):
                bucket.add(s, live.BOOK, (math.nan if s % 9 == 0 else 1.0 + s / 1000, 1.5 + s % 3, 5.0 + s % 11, 6.0, math.nan, math.nan))
                bucket.add(s + 1, live.TRADE, (math.nan,) * 4 + (3.0 + b, float(s % 6)))
            # Buckets begin at other seconds; one begins anew.
            bucket.seconds(100 * b) if b else None
        together.take(at_once, 600 - b, (b, None))
        wanted += zip(*(c.tolist() for c in single.seconds(600 - b).values()), strict=True)
        assert repr(at_once.state()) == repr(single.state())
    rows = list(zip(*(c.tolist() for c in together.columns().values()), strict=True))
    assert [[repr(v) for v in r] for r in rows] == [[repr(v) for v in r] for r in wanted]
    batch_of = together.batch()
    assert batch_of.num_rows == len(rows) and batch_of["time_id"].null_count == len(rows)
    assert batch_of["stock_id"].to_pylist() == [b for b in range(5) for _ in range(100 * b, 600 - b)]


def test_buckets_share_calls_and_state(spark, tmp_path):
    """The state has a row per group, not one per bucket; null keys are keys; the number of groups stays."""
    rng = random.Random(4)
    keys = [(s, t) for s in (*range(20), None) for t in range(5)]
    book = [(*k, s, at(s), 1.0 + rng.random(), 2.0 + rng.random(), 3, 4) for k in keys for s in rng.sample(range(600), 9)]
    trade = [(*k, s, at(s), 5, 2) for k in keys for s in rng.sample(range(600), 4)]
    starts = [(*k, at(0)) for k in keys]

    def arrive(rows, book, trade, index):
        parts = (book, BOOK_SCHEMA), (trade, TRADE_SCHEMA), (index, "stock_id int, time_id int, ts timestamp")
        live.bucket_rows(*(spark.createDataFrame(part, schema) for part, schema in parts)).write.mode("append").parquet(rows)
        return spark.read.parquet(rows).schema

    def run(schema, groups):
        stream = live.live_features(read_row_stream(spark, f"{tmp_path}/in", schema), "20 seconds", 1, groups)
        query = live.write_features(stream, f"{tmp_path}/out", f"{tmp_path}/progress", True)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    early, late = ([[r for r in rows if (r[3] < at(330)) == first] for rows in (book, trade)] for first in (True, False))
    schema = arrive(f"{tmp_path}/in", *early, starts)
    assert 0 < run(schema, 6) <= 6 < len(keys)
    # A bucket far ahead lets the watermark pass the ends of the others.
    arrive(f"{tmp_path}/in", *late, [(99, 99, at(50_000))])
    with pytest.raises(Exception, match="6 groups"):
        run(schema, 7)
    assert run(schema, 6) == 1
    found = spark.read.parquet(f"{tmp_path}/out")
    got = {(r["stock_id"], r["time_id"], r[SECOND]): [r[c] for c in FEATURES] for r in found.collect()}
    frame = batch.bucket_features(
        spark.createDataFrame(keys, "stock_id int, time_id int"),
        spark.createDataFrame(book, BOOK_SCHEMA).drop("ts"), spark.createDataFrame(trade, TRADE_SCHEMA).drop("ts"),
    )
    wanted = {(r["stock_id"], r["time_id"], r[SECOND]): [r[c] for c in FEATURES] for r in frame.collect()}
    assert found.count() == len(got) == 600 * len(keys) and got.keys() == wanted.keys()
    assert all(same(got[k], wanted[k]) for k in wanted)
