"""Table schemas, key columns and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# A bucket is one (instrument, time bucket) pair; a slot is one second of a bucket.
BUCKET_KEY = ["stock_id", "time_id"]
SECOND = "seconds_in_bucket"
SLOT_KEY = [*BUCKET_KEY, SECOND]

# They must equal the published definitions for results to agree.
BUCKET_SECONDS = 600
STALE_CAP = 15
EPS = 1e-8
STD_EPS = 1e-12
VARIANCE_FLOOR = 1e-12
SHARD_SIZE = 2048
SPLIT_SEED = 42
SHUFFLE_SEED = 23
EVAL_FRACTION = 0.2
VALIDATION_FRACTION = 0.1
LOG_INTERVAL = 200

# Feature names in output order.
FEATURES = [
    "size",
    "order_count",
    "wap_last",
    "seconds_since_last_wap",
    "log_return",
    "rv_30s",
    "rv_120s",
    "spread_last",
    "mid_last",
    "rel_spread_last",
    "ofi_last",
    "seconds_since_last_trade",
    "last_trade_gap_geq_cap",
    "order_intensity_60s",
]

BOOK_VALUES = ["bid_price1", "ask_price1", "bid_size1", "ask_size1"]
TRADE_VALUES = ["size", "order_count"]

LABELS = T.StructType(
    [
        T.StructField("stock_id", T.IntegerType()),
        T.StructField("time_id", T.IntegerType()),
        T.StructField("target", T.DoubleType()),
    ]
)

BOOK = T.StructType(
    [
        T.StructField("time_id", T.IntegerType()),
        T.StructField("seconds_in_bucket", T.IntegerType()),
        T.StructField("bid_price1", T.DoubleType()),
        T.StructField("ask_price1", T.DoubleType()),
        T.StructField("bid_size1", T.LongType()),
        T.StructField("ask_size1", T.LongType()),
        T.StructField("stock_id", T.IntegerType()),
    ]
)

TRADE = T.StructType(
    [
        T.StructField("time_id", T.IntegerType()),
        T.StructField("seconds_in_bucket", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("order_count", T.LongType()),
        T.StructField("stock_id", T.IntegerType()),
    ]
)

SAMPLE = T.StructType(
    [
        T.StructField("stock_id", T.IntegerType()),
        T.StructField("time_id", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        T.StructField("x", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("y_log", T.FloatType()),
        T.StructField("split", T.StringType()),
        T.StructField("shard_id", T.LongType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("feature_cols", T.ArrayType(T.StringType())),
        T.StructField("num_shards", T.LongType()),
        T.StructField("shard_size", T.LongType()),
        T.StructField(
            "norm",
            T.StructType(
                [
                    T.StructField("mean", T.ArrayType(T.DoubleType())),
                    T.StructField("std", T.ArrayType(T.DoubleType())),
                    T.StructField("count_seconds", T.LongType()),
                    T.StructField("source", T.StringType()),
                ]
            ),
        ),
    ]
)

REQUEST_BODY = "x array<array<array<float>>>"
