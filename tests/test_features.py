import math
import random

import pytest
from brute import bucket
from pyspark.sql import functions as F
from volgrid.operators import assemble, features, grid
from volgrid.schemas import BUCKET_KEY, FEATURES, SECOND, SLOT_KEY

BOOK = "stock_id int, time_id int, seconds_in_bucket int, bid_price1 double, ask_price1 double, bid_size1 long, ask_size1 long"
TRADE = "stock_id int, time_id int, seconds_in_bucket int, size long, order_count long"
INDEX = "stock_id int, time_id int, target double"


def market(spark, books, trades, keys=None):
    """Frames from ``{(stock, time): {second: values}}``."""
    keys = keys or sorted(set(books) | set(trades))
    index = spark.createDataFrame([(*k, 0.001 * (i + 1)) for i, k in enumerate(keys)], INDEX)
    book = spark.createDataFrame([(*k, s, *v) for k, b in books.items() for s, v in b.items()], BOOK)
    trade = spark.createDataFrame([(*k, s, *v) for k, t in trades.items() for s, v in t.items()], TRADE)
    return index, book, trade


def by_second(df, *names):
    rows = df.select(SECOND, *names).orderBy(SECOND).collect()
    assert [r[0] for r in rows] == list(range(600))
    return [r[1] if len(names) == 1 else tuple(r)[1:] for r in rows]


def one(spark, book, trade):
    return features.bucket_features(*market(spark, {(1, 1): book}, {(1, 1): trade}, [(1, 1)]))


def test_all_features_against_the_definitions(spark):
    rng = random.Random(7)
    books, trades = {}, {}
    for key in [(s, t) for s in (1, 2) for t in (5, 6, 11)]:
        seconds = rng.sample(range(600), rng.choice([1, 40, 400]))
        books[key] = {}
        for s in seconds:
            bid = rng.uniform(0.9, 1.1)
            quote = [bid, bid + rng.uniform(0.0001, 0.01), rng.randint(1, 300), rng.randint(1, 300)]
            if rng.random() < 0.1:
                quote[rng.randrange(4)] = None
            books[key][s] = tuple(quote)
        trades[key] = {
            s: (rng.randint(1, 500), rng.randint(1, 9)) for s in rng.sample(range(600), 30)
        }
    got = {
        (r.stock_id, r.time_id, r.seconds_in_bucket): r
        for r in features.bucket_features(*market(spark, books, trades)).collect()
    }
    assert len(got) == 600 * len(books)
    for key in books:
        for second, want in enumerate(bucket(books[key], trades[key])):
            row = got[(*key, second)]
            for name in FEATURES:
                if want[name] is None:
                    assert row[name] is None, (key, second, name)
                else:
                    assert row[name] == pytest.approx(want[name], rel=1e-9, abs=1e-12), (key, second, name)


def test_empty_bucket_has_600_rows(spark):
    frame = features.bucket_features(*market(spark, {}, {}, [(3, 4)]))
    rows = by_second(frame, "wap_last", "size", "seconds_since_last_wap", "seconds_since_last_trade", "rv_120s")
    for s, (wap, size, stale_wap, stale_trade, rv) in enumerate(rows):
        assert (wap, size, rv) == (None, 0, 0.0)
        assert stale_wap == stale_trade == min(s + 1, 15)


def test_rows_before_the_first_quote(spark):
    frame = one(spark, {5: (1.0, 1.1, 10, 10)}, {})
    rows = by_second(frame, "wap_last", "seconds_since_last_wap", "log_return")
    assert [r[0] for r in rows[:5]] == [None] * 5
    assert [r[1] for r in rows[:7]] == [1, 2, 3, 4, 5, 0, 1]
    assert all(r[2] == 0 for r in rows)


def test_price_that_is_not_positive_breaks_both_returns(spark):
    quotes = {0: (1.0, 1.0, 1, 1), 10: (-1.0, -1.0, 1, 1), 20: (2.0, 2.0, 1, 1), 30: (4.0, 4.0, 1, 1)}
    returns = by_second(one(spark, quotes, {}), "log_return")
    assert returns[10] == returns[20] == 0
    assert returns[30] == pytest.approx(math.log(2))


def test_nan_quote_counts_as_unobserved(spark):
    quotes = {0: (1.0, 1.0, 1, 1), 10: (float("nan"), 1.0, 1, 1), 20: (2.0, 2.0, 1, 1)}
    rows = by_second(one(spark, quotes, {}), "log_return", "wap_last", "rv_30s")
    assert rows[10][0] == 0 and rows[10][1] == rows[0][1]
    assert rows[20][0] == pytest.approx(math.log(2))
    assert not any(math.isnan(r[2]) for r in rows)


def test_staleness_around_the_cap(spark):
    rows = by_second(one(spark, {}, {0: (5, 1)}), "seconds_since_last_trade", "last_trade_gap_geq_cap")
    assert (rows[14], rows[15], rows[20]) == ((14, 0), (15, 1), (15, 1))


def test_rolling_windows_open_and_close(spark):
    quotes = {0: (1.0, 1.0, 1, 1), 10: (2.0, 2.0, 1, 1)}
    rows = by_second(one(spark, quotes, {10: (1, 3)}), "rv_30s", "rv_120s", "order_intensity_60s")
    jump = pytest.approx(math.log(2))
    assert rows[9] == (0, 0, 0)
    assert (rows[39][0], rows[40][0]) == (jump, 0)
    assert (rows[129][1], rows[130][1]) == (jump, 0)
    assert (rows[69][2], rows[70][2]) == (3, 0)


def test_trade_only_seconds(spark):
    tables = market(spark, {(1, 1): {3: (1.0, 1.1, 2, 2)}}, {(1, 1): {3: (4, 1), 9: (6, 2)}})
    kept = by_second(features.bucket_features(*tables), "size")
    assert (kept[3], kept[9]) == (4, 6)
    dropped = by_second(features.bucket_features(*tables, keep_trade_only=False), "size")
    assert (dropped[3], dropped[9]) == (4, 0)
    assert grid.merge_book_trade(*tables[1:]).count() == 2
    assert grid.merge_book_trade(*tables[1:], keep_trade_only=False).count() == 1


def test_index_decides_which_buckets_exist(spark):
    tables = market(spark, {(1, 1): {3: (1.0, 1.1, 2, 2)}, (1, 2): {3: (1.0, 1.1, 2, 2)}}, {}, [(1, 2), (9, 9)])
    counts = features.bucket_features(*tables).groupBy(*BUCKET_KEY).count().collect()
    assert {tuple(r) for r in counts} == {(1, 2, 600), (9, 9, 600)}


def test_seconds_off_the_grid_are_dropped(spark):
    quote = (1.0, 1.1, 2, 2)
    frame = features.bucket_features(*market(spark, {(1, 1): {-1: quote, 600: quote}}, {(1, 1): {700: (1, 1)}}))
    rows = by_second(frame, "wap_last", "size")
    assert set(rows) == {(None, 0)}


def test_union_form_equals_join_form(spark, sf_dir):
    from volgrid.sources import fixtures

    book, trade = fixtures.book(spark, sf_dir), fixtures.trade(spark, sf_dir)
    union = grid.merge_book_trade(book, trade)
    join = grid.merge_book_trade_by_join(book, trade).select(*union.columns)
    assert union.exceptAll(join).isEmpty() and join.exceptAll(union).isEmpty()


def test_unique_slots_only_changes_the_plan(spark, sf_dir):
    from volgrid.sources import fixtures

    tables = fixtures.market(spark, sf_dir)
    plain = features.bucket_features(*tables)
    placed = features.bucket_features(*tables, unique_slots=True)
    assert plain.exceptAll(placed).isEmpty() and placed.exceptAll(plain).isEmpty()


def test_invariants(spark, sf_dir):
    from volgrid.sources import fixtures

    frame = features.bucket_features(*fixtures.market(spark, sf_dir))
    sizes = frame.groupBy(*BUCKET_KEY).count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [600]
    assert frame.select(*SLOT_KEY).distinct().count() == frame.count()
    assert frame.where((F.col("rv_30s") < 0) | (F.col("rv_120s") < F.col("rv_30s") - 1e-12)).isEmpty()


def test_bucket_rv_equals_dense_sum(spark, sf_dir):
    from volgrid.sources import fixtures

    tables = fixtures.market(spark, sf_dir)
    sparse = {tuple(r)[:2]: r.rv for r in features.bucket_rv(*tables).collect()}
    dense = assemble.bucket_summary(features.bucket_features(*tables)).collect()
    assert len(sparse) == len(dense)
    for r in dense:
        assert r.rv == pytest.approx(sparse[(r.stock_id, r.time_id)], rel=1e-12)


def test_labels_ride_along(spark):
    tables = market(spark, {(1, 1): {3: (1.0, 1.1, 2, 2)}}, {}, [(1, 1), (2, 2)])
    targets = assemble.attach_labels(*tables).groupBy(*BUCKET_KEY).agg(
        F.min("target"), F.max("target"), F.count("target")
    )
    assert {tuple(r) for r in targets.collect()} == {(1, 1, 0.001, 0.001, 600), (2, 2, 0.002, 0.002, 600)}


def test_tensor_is_in_second_order(spark):
    frame = one(spark, {s: (1.0 + s, 2.0 + s, 3, 4) for s in range(0, 600, 7)}, {11: (5, 2)})
    x = assemble.bucket_tensor(frame).first().x
    assert len(x) == 600 and {len(row) for row in x} == {len(FEATURES)}
    assert x[11][0] == 5 and x[12][0] == 0
    want = by_second(frame, "mid_last")
    assert [row[FEATURES.index("mid_last")] for row in x] == pytest.approx(want)


def test_regression_values(spark):
    """Sums of the derived market with 8 instruments, as recorded when the inputs were chosen."""
    from volgrid.sources import fixtures

    tables = fixtures.market(spark, "/root/testdata/sf0.01", 8)
    names = ["size", "order_intensity_60s", "rv_30s", "rv_120s", "rel_spread_last", "last_trade_gap_geq_cap"]
    frame = features.bucket_features(*tables)
    row = frame.agg(F.count(F.lit(1)), F.count_if(F.col("wap_last").isNull()), *[F.sum(c) for c in names]).first()
    assert tuple(row)[:4] == (144_000, 5_698, 199_190, 673_393)
    assert tuple(row)[4:7] == pytest.approx((6142.841618, 15437.136306, 527.359722), abs=1e-6)
    assert row[7] == 93_007
    known = fixtures.forecasts(spark, "/root/testdata/sf0.01", 8).agg(F.sum("pred"), F.sum("target")).first()
    assert tuple(known) == pytest.approx((71.67861871, 68.96248875), abs=1e-8)


@pytest.mark.parametrize("unique", [True, False])
def test_repeated_labels_and_differing_rows_fail(spark, unique):
    index, book, trade = market(spark, {(1, 1): {3: (10.0, 10.1, 3, 4)}}, {(1, 1): {3: (5, 1)}})
    other = spark.createDataFrame([(1, 1, 3, 9.0, 11.0, 8, 1)], BOOK)

    def build(labels, quotes):
        return assemble.attach_labels(labels, quotes, trade, unique_slots=unique).count()

    def read(labels, quotes):
        return assemble.attach_labels(labels, quotes, trade, unique_slots=unique).agg(F.sum("wap_last"), F.sum("target")).collect()

    assert build(index, book.unionAll(book)) == 600  # copies are harmless
    for frames in ((index.unionAll(index), book), (index, book.unionAll(other))):
        with pytest.raises(Exception, match="more than one label row|rows of one source differ"):
            read(*frames)
    picked = grid.whole_rows(book.unionAll(other), ["bid_price1", "ask_price1", "bid_size1", "ask_size1"])
    assert [tuple(r)[3:] for r in picked.collect()] == [(10.0, 10.1, 3, 4)]
    part = spark.createDataFrame([(1, 1, 3, None, 10.1, 3, 4)], BOOK)
    with pytest.raises(Exception, match="rows of one source differ"):
        read(index, book.unionAll(part))
