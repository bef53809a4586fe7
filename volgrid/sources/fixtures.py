"""Book, trade, label, prediction and timing tables derived from the given test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.features import bucket_rv
from ..schemas import BOOK_VALUES, BUCKET_KEY, EPS, SECOND, SLOT_KEY, TRADE_VALUES

BOOK_EVENTS = ["view", "click", "signup"]
TRADE_EVENTS = ["purchase", "error"]
USERS_PER_STOCK = 16
SLOT_SECONDS = 144  # a day has 600 slots of 144 seconds
SLOT_PARTS = 64  # parts that the rows of a slot are combined in
MOST_ROWS, FEW_ROWS = 200_000, 5_000  # events that a task combines
PREDICTION_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed_events(spark: SparkSession, sf_dir: str, stocks: int | None) -> DataFrame:
    """Events with bucket and slot. An instrument is a run of users, so that the market grows
    with the table, or users modulo ``stocks`` for a market of fixed width."""
    user = F.col("user_id")
    stock = user % stocks if stocks else F.floor(user / USERS_PER_STOCK)
    second_of_day = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf_dir, "events").select(
        stock.cast("int").alias("stock_id"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("time_id"),
        F.floor(second_of_day / SLOT_SECONDS).cast("int").alias(SECOND),
        "event_id",
        "event_type",
        "ts",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def _partitions(events: DataFrame) -> int:
    """Tasks for so many rows: as many as the session says, but none with too many or hardly any."""
    rows = events.count()
    usual = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // MOST_ROWS), min(usual, rows // FEW_ROWS), 1)


def _latest_per_slot(events: DataFrame, values: list[str]) -> DataFrame:
    """Latest row per slot. A hot slot is combined in parts first, so that it is no task's alone.

    Rows are wide while they are sorted and small in a shuffle: its size says little about the memory
    of a task, so the partition count follows the rows instead of being left to coalescing.
    """
    partitions = _partitions(events)
    latest = F.max_by("_row", F.struct("_row.ts", "_row.event_id")).alias("_row")
    part = F.pmod(F.xxhash64("event_id", F.spark_partition_id()), F.lit(SLOT_PARTS)).alias("_part")
    rows = events.select(*SLOT_KEY, part, F.struct("ts", "event_id", *values).alias("_row"))
    parts = rows.repartition(partitions, *SLOT_KEY, "_part").groupBy(*SLOT_KEY, "_part").agg(latest)
    slots = parts.repartition(partitions, *BUCKET_KEY).groupBy(*SLOT_KEY).agg(latest)
    return slots.select(*SLOT_KEY, *[F.col(f"_row.{c}") for c in values])


def book(spark: SparkSession, sf_dir: str, stocks: int | None = None) -> DataFrame:
    events = _keyed_events(spark, sf_dir, stocks).where(F.col("event_type").isin(BOOK_EVENTS))
    bid = F.lit(1) + F.col("value") / 1000
    quotes = events.select(
        *SLOT_KEY,
        "ts",
        "event_id",
        bid.alias("bid_price1"),
        (bid + (F.col("event_id") % 7 + 1) / F.lit(1000.0)).alias("ask_price1"),
        (F.col("k") + 1).alias("bid_size1"),
        (F.col("event_id") % 50 + 1).alias("ask_size1"),
    )
    return _latest_per_slot(quotes, BOOK_VALUES)


def trade(spark: SparkSession, sf_dir: str, stocks: int | None = None) -> DataFrame:
    events = _keyed_events(spark, sf_dir, stocks).where(F.col("event_type").isin(TRADE_EVENTS))
    trades = events.select(
        *SLOT_KEY,
        "ts",
        "event_id",
        (F.col("event_id") % 100 + 1).alias("size"),
        (F.col("event_id") % 5 + 1).alias("order_count"),
    )
    return _latest_per_slot(trades, TRADE_VALUES)


def raw_slots(spark: SparkSession, sf_dir: str, stocks: int | None = None) -> DataFrame:
    """Slot of every event, copies included."""
    return _keyed_events(spark, sf_dir, stocks).select(*SLOT_KEY)


def buckets(spark: SparkSession, sf_dir: str, stocks: int | None = None) -> DataFrame:
    return _keyed_events(spark, sf_dir, stocks).select(*BUCKET_KEY).distinct()


def market(
    spark: SparkSession, sf_dir: str, stocks: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(buckets, book, trade)``."""
    return (
        buckets(spark, sf_dir, stocks),
        book(spark, sf_dir, stocks),
        trade(spark, sf_dir, stocks),
    )


def forecasts(spark: SparkSession, sf_dir: str, stocks: int | None = None) -> DataFrame:
    """Persistence forecast: a bucket's volatility predicts the next one of its instrument.

    The window holds one row per day of an instrument.
    """
    by_day = Window.partitionBy("stock_id").orderBy("time_id")
    rv = bucket_rv(*market(spark, sf_dir, stocks))
    return rv.select(
        *BUCKET_KEY, F.col("rv").alias("pred"), F.lead("rv").over(by_day).alias("target")
    )


def labels(spark: SparkSession, sf_dir: str, stocks: int | None = None) -> DataFrame:
    """Label table: buckets with a known next volatility."""
    known = forecasts(spark, sf_dir, stocks).where(F.col("target").isNotNull())
    return known.select(*BUCKET_KEY, "target")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction and label per order line, on the real and the log scale."""
    lines = table(spark, sf_dir, "lineitem").select(
        *PREDICTION_KEY, "l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        *PREDICTION_KEY,
        "l_returnflag",
        F.month("l_shipdate").alias("epoch"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("pred"),
    ).withColumns(
        {"y_log": F.ln(F.col("y") + F.lit(EPS)), "pred_log": F.ln(F.col("pred") + F.lit(EPS))}
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("mode"), F.col("value").alias("latency_ms")
    )


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label-like table of unique key pairs."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("stock_id"),
        F.col("o_orderkey").alias("time_id"),
        F.col("o_totalprice").alias("target"),
    )
