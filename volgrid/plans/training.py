"""Registered queries of epochs, exact splits and model choice, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import permutation as perm
from ..functions.scalars import round_half_up
from ..operators import boosting, custom, epochs, moments, ordering, quota, regpath
from ..operators import split as splits
from ..schemas import BUCKET_KEY, EPS, FEATURES, SHUFFLE_SEED, SPLIT_SEED
from ..session import scratch_path
from ..sources import fixtures, layout
from ..streaming import features as live_buckets
from ..streaming import latency as live
from ..streaming import moments as moment_streams
from . import increments, jobs
from .oracles import ALL, BUILT_FEATURES, KEY, PREDICTIONS, SLOT, STD, digest, r, rs, unit
from .oracles import SQL as EARLIER
from .queries import BATCH, CONSUMERS, SHARD, Query, _split_features, rounded

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EPOCHS = 3
FOLDS = 5
REGS = [0.0, 0.01, 0.1, 1.0]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample keys with the place they are stored at."""
    path = scratch_path(spark, "stored-samples")
    keys = fixtures.order_keys(spark, sf_dir).drop("target")
    ordering.assign_shards(keys, SHARD).write.parquet(path)
    return spark.read.parquet(path)


@query
def epoch_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every sample in each of three epochs: from stored places, without a shuffle."""
    samples = _stored_samples(spark, sf_dir)
    rows = samples.count()
    each = samples.withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS)))))
    return epochs.epoch_place(each, rows, "epoch", SHARD)


@query
def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards in the order of an epoch, with consumers and batches: without a shuffle."""
    samples = _stored_samples(spark, sf_dir)
    return epochs.epoch_order(samples, samples.count(), 1, SHARD, BATCH, CONSUMERS)


@query
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.assign_split_exact(fixtures.order_keys(spark, sf_dir).drop("target"))


@query
def split_exact_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split of instruments of very different size: runs of customers, one half of all."""
    keys = fixtures.order_keys(spark, sf_dir).drop("target")
    hot = F.when(F.col("time_id") % 2 == 0, F.lit(-1)).otherwise(F.col("stock_id") % 40)
    split = quota.assign_split_exact(keys.withColumn("stock_id", hot))
    return split.groupBy("stock_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query
def reg_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every penalty on every held-out fold, for both losses, from one scan each."""
    rows = fixtures.predictions(spark, sf_dir)
    real = F.col("y") + F.lit(EPS)
    tasks = {"log_mse": ("pred_log", "y_log", None), "mspe": ("pred", "y", 1 / (real * real))}
    found = []
    for loss, (feature, label, weight) in tasks.items():
        sums = regpath.fold_sums(rows, [feature], label, fixtures.PREDICTION_KEY, FOLDS, weight=weight)
        found += [
            (loss, reg, fold, n, model.coefficients[0], model.intercept, None if error is None else error**0.5)
            for reg, fold, model, n, error in regpath.reg_path(sums, REGS)
        ]
    schema = "loss string, reg double, fold int, n long, slope double, intercept double, root_error double"
    return rounded(spark.createDataFrame(found, schema), 5)


@query
def norm_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train statistics as a stream: two runs over files that arrive in between, several triggers."""
    folder = scratch_path(spark, "norm-stream")
    train = _split_features(spark, sf_dir, "train")
    # Later days arrive after the first run.
    written = scratch_path(spark, "arriving")
    train.withColumn("late", (F.col("time_id") % 3 == 0).cast("int")).write.partitionBy("late").parquet(written)
    schema = train.schema
    for late in (0, 1):
        spark.read.schema(schema).parquet(f"{written}/late={late}").write.mode("append").parquet(f"{folder}/rows")
        files = max(1, len(spark.read.parquet(f"{folder}/rows").inputFiles()) // 3)
        rows = moment_streams.read_row_stream(spark, f"{folder}/rows", schema, files)
        moment_streams.moment_stream(
            rows, f"{folder}/moments", f"{folder}/progress", available_now=True
        ).awaitTermination()
    return _norm_rows(moments.norm_of(moment_streams.latest_moments(spark, f"{folder}/moments")), 6)


def _norm_rows(norm: DataFrame, digits: int) -> DataFrame:
    """Statistics as one row per feature."""
    names = F.array(*map(F.lit, FEATURES)).alias("feature")
    return rounded(norm.select("count_seconds", F.inline(F.arrays_zip(names, "mean", "std"))), digits)


def _appended(spark: SparkSession, sf_dir: str) -> str:
    """The derived market in three builds: labels arrive by day."""
    out = scratch_path(spark, "appended")
    labels = fixtures.labels(spark, sf_dir)
    book, trade = fixtures.book(spark, sf_dir), fixtures.trade(spark, sf_dir)
    for last in (9, 19, 10_000):
        # Each time all labels so far: those that are built already are left out.
        increments.append_build(spark, labels.where(F.col("time_id") <= last), book, trade, out, SHARD)
    return out


@query
def append_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics after three builds, merged from the moments of their shards."""
    return _norm_rows(increments.read_norm(spark, _appended(spark, sf_dir)), 3)


@query
def append_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of three builds: the same as those of a single one, but for their shards."""
    samples = increments.read_samples(spark, _appended(spark, sf_dir))
    cells = F.flatten("x")
    total = F.aggregate(cells, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))
    return rounded(
        samples.select(*BUCKET_KEY, "split", F.col("y_log").cast("double").alias("y_log"), F.size(cells).alias("cells"), total.alias("total")), 3
    )


@query
def train_eval_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build in another order of features, then fit, choose and report with one input."""
    out = scratch_path(spark, "built")
    labels = fixtures.labels(spark, sf_dir)
    book, trade = fixtures.book(spark, sf_dir), fixtures.trade(spark, sf_dir)
    jobs.build_job(spark, labels, book, trade, out, shard_size=SHARD, columns=["rv_30s", "log_return", "size"])
    reports = []
    for loss in jobs.LOSSES:
        trained, report = jobs.train_eval_job(spark, out, loss, (0.0,), ["log_rv"])
        reports.append(report.withColumn("loss", F.lit(loss)))
    return rounded(reports[0].unionByName(reports[1]), 4)


@query
def bucket_features_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features from tables that are stored in their distribution: no shuffle."""
    frame = layout.bucket_features(spark, *_stored_layout(spark, sf_dir))
    flag = "last_trade_gap_geq_cap"
    return rounded(frame.withColumn(flag, F.col(flag).cast("int")))


LEAST_HASHES, PER_HASH = 8, 2_000


def _stored_layout(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> tuple[str, str]:
    """Names of the stored index and slots of the derived market.

    A task makes the 600 rows of each time bucket in one hash bucket: these are as many as the index
    needs for about ``PER_HASH`` time buckets each, unless ``buckets`` says how many.
    """
    folder = scratch_path(spark, "layout")
    name = folder.rsplit("-", 1)[1]
    index, book, trade = fixtures.market(spark, sf_dir)
    if buckets is None:
        buckets = max(LEAST_HASHES, -(-index.count() // PER_HASH))
    layout.write_slots(book, trade, f"slots_{name}", f"{folder}/slots", buckets)
    layout.write_index(index, f"index_{name}", f"{folder}/index", buckets)
    return f"index_{name}", f"slots_{name}"


def volatility(stock_id: int, time_id: int, book, trade) -> dict[str, np.ndarray]:
    """An example of a function of one's own: log returns of the filled price, and traded size."""
    seconds = np.arange(600)
    sizes = book["bid_size1"] + book["ask_size1"] + 1e-8
    wap = (book["bid_price1"] * book["ask_size1"] + book["ask_price1"] * book["bid_size1"]) / sizes
    good = wap.notna().to_numpy()
    at, prices = book["seconds_in_bucket"].to_numpy()[good], wap.to_numpy()[good]
    logs = np.where(prices > 0, np.log(np.where(prices > 0, prices, 1.0)), np.nan)
    last = np.searchsorted(at, seconds, side="right") - 1
    filled = np.where(last >= 0, logs[last], np.nan) if len(at) else np.full(600, np.nan)
    size = np.zeros(600)
    size[trade["seconds_in_bucket"].to_numpy()] = trade["size"].fillna(0).to_numpy()
    return {"log_return": np.nan_to_num(np.diff(filled, prepend=np.nan)), "size": size}


@query
def bucket_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realized volatility and traded size of each bucket, by the function above."""
    rows = custom.bucket_udf(*fixtures.market(spark, sf_dir), volatility, ["log_return", "size"])
    squares = F.sqrt(F.sum(F.col("log_return") * F.col("log_return")))
    return rounded(rows.groupBy(*BUCKET_KEY).agg(squares.alias("rv"), F.sum("size").alias("size")), 8)


EVERY, DELAY = "6 hours", "2 hours"
PER_GROUP = 1_000  # time buckets that a call of the stream works on


@query
def latency_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency of finished windows, by mode: two runs of a stream, every tenth row sent twice."""
    folder = scratch_path(spark, "latency")
    events = fixtures.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("mode"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms")
    )
    sent = events.unionByName(events.where("request_id % 10 = 0"))
    middle = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    histograms = None
    for part in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)):
        sent.where(part).write.mode("append").parquet(f"{folder}/timings")
        arriving = moment_streams.read_row_stream(spark, f"{folder}/timings", sent.schema)
        histograms = live.latency_histograms(arriving, ["mode"], EVERY, DELAY)
        live.write_histograms(histograms, f"{folder}/counts", f"{folder}/progress", available_now=True).awaitTermination()
    counts = live.read_histograms(spark, f"{folder}/counts", histograms)
    bounds = live.latency_bounds(counts, ["window_start", "mode"])
    return rounded(bounds.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")), 6)


@query
def features_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all seconds that are final after two runs; the first ends amid a day."""
    folder = scratch_path(spark, "live-features")
    # A slot of the derived market stands for 144 seconds of its day.
    start = (F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("time_id") * 86_400).cast("timestamp")
    at = F.timestamp_add("second", F.col("seconds_in_bucket") * fixtures.SLOT_SECONDS, start)
    index, book, trade = fixtures.market(spark, sf_dir)
    rows = live_buckets.bucket_rows(book.withColumn("ts", at), trade.withColumn("ts", at), index.withColumn("ts", start))
    path = scratch_path(spark, "live-rows")
    rows.write.parquet(path)
    stored = spark.read.parquet(path)
    # Of all buckets, about half are open in each run.
    opened = stored.where(F.col("source") == live_buckets.ANCHOR).count()
    groups = max(live_buckets.GROUPS, -(-opened // PER_GROUP))
    first = F.struct("time_id", "seconds_in_bucket") < F.struct(F.lit(15), F.lit(300))
    for part in (first, ~first):
        stored.where(part).write.mode("append").parquet(f"{folder}/rows")
        arriving = moment_streams.read_row_stream(spark, f"{folder}/rows", stored.schema)
        frame = live_buckets.live_features(arriving, DELAY, fixtures.SLOT_SECONDS, groups)
        live_buckets.write_features(frame, f"{folder}/features", f"{folder}/progress", available_now=True).awaitTermination()
    found = spark.read.parquet(f"{folder}/features")
    missing = {c: F.when(~F.isnan(c), F.col(c)) for c, kind in found.dtypes if kind == "double"}
    flag = "last_trade_gap_geq_cap"
    typed = found.withColumns(missing | {flag: F.col(flag).cast("int")})
    # As ``rounded`` does; by decimals alone it took longer than either run.
    return typed.withColumns({c: round_half_up(c, 6) + 0.0 for c in missing})


STUMP_EDGES = {"l_quantity": [5.0 * i for i in range(1, 10)], "pred": [5000.0 * i for i in range(1, 16)]}


@query
def boosted_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best single cut under the percentage error, and the values on its sides."""
    rows = fixtures.predictions(spark, sf_dir).join(
        fixtures.table(spark, sf_dir, "lineitem").select(*fixtures.PREDICTION_KEY, "l_quantity"), fixtures.PREDICTION_KEY
    )
    model = boosting.fit_boosted(
        rows, list(STUMP_EDGES), "y", rounds=1, depth=1, rate=1.0, least=1, edges=list(STUMP_EDGES.values())
    )
    (tree,) = model.trees
    found = (model.features[tree.feature], tree.edge, model.start + tree.left.value, model.start + tree.right.value)
    return rounded(spark.createDataFrame([found], "feature string, edge double, low double, high double"), 4)


# --- SQL -------------------------------------------------------------------------------------


def _keys(seed: int, *parts: str) -> list[str]:
    text = f"concat_ws('|', '{seed}', {', '.join(f'({p})::VARCHAR' for p in parts)})"
    more = f"concat_ws('|', '{seed}', {', '.join(f'({p})::VARCHAR' for p in parts)}, 'more')"
    places = [(text, i) for i in range(4)] + [(more, i) for i in range(perm.ROUNDS - 4)]
    return [f"('0x' || substring(md5({t}), {1 + 7 * i}, 7))::BIGINT" for t, i in places]


def _network(source: str) -> str:
    """One pass of the network over ``v`` in 0 .. a*b-1, from the definitions."""
    sql = f"SELECT * EXCLUDE (v), v // b AS l, v % b AS r, b AS own_b FROM {source}"
    for i in range(perm.ROUNDS):
        first = f"((xor(r, k{i}) * {perm.FIRST_FACTOR}::BIGINT) >> {perm.FIRST_SHIFT}) & {perm.MASK}::BIGINT"
        mixed = f"(xor({first}, k{i}) * {perm.SECOND_FACTOR}::BIGINT) >> {perm.SECOND_SHIFT}"
        sql = f"SELECT * REPLACE (r AS l, (l + ({mixed})) % a AS r, b AS a, a AS b) FROM ({sql})"
    return f"SELECT * EXCLUDE (l, r, own_b), l * own_b + r AS v FROM ({sql})"


def permuted(name: str, source: str, index: str, n: str, keys: list[str]) -> str:
    """CTEs: ``name`` is ``source`` with the place ``v`` of ``index`` among ``n``."""
    keyed = ", ".join(f"{k} AS k{i}" for i, k in enumerate(keys))
    return f"""{name}_start AS (
  SELECT *, greatest(1, (n + a - 1) // a) AS b
  FROM (SELECT *, greatest(1, ceil(sqrt(n::DOUBLE))::BIGINT) AS a
        FROM (SELECT *, ({index})::BIGINT AS v, ({n})::BIGINT AS n, {keyed} FROM {source}))),
{name}_walk AS (
  SELECT * FROM ({_network(f"{name}_start")})
  UNION ALL SELECT * FROM ({_network(f"(SELECT * FROM {name}_walk WHERE v >= n)")})),
{name} AS (SELECT * EXCLUDE ({", ".join(f"k{i}" for i in range(len(keys)))}, a, b) FROM {name}_walk WHERE v < n)"""


STORED = f"""stored AS (
  SELECT stock_id, time_id, rank // {SHARD} AS shard_id, rank % {SHARD} AS pos FROM (
    SELECT o_custkey AS stock_id, o_orderkey AS time_id,
      row_number() OVER (ORDER BY {unit(SPLIT_SEED, "o_custkey", "o_orderkey")}, o_custkey, o_orderkey) - 1 AS rank
    FROM orders))"""

SQL["epoch_permutation"] = f"""WITH RECURSIVE {STORED},
each AS (SELECT *, unnest(range({EPOCHS}))::INTEGER AS epoch FROM stored),
{permuted("placed", "each", f"shard_id * {SHARD} + pos", "SELECT count(*) FROM stored", _keys(SHUFFLE_SEED, "epoch"))}
SELECT stock_id, time_id, shard_id, pos, epoch, v AS place FROM placed"""

_SHARDS = "(SELECT max(shard_id) + 1 FROM stored)"
SQL["epoch_order"] = f"""WITH RECURSIVE {STORED},
shards AS (SELECT DISTINCT shard_id, {_SHARDS} AS all_shards FROM stored),
{permuted("shard_order", "shards", "shard_id", "all_shards", _keys(SHUFFLE_SEED, "1"))},
sizes AS (SELECT shard_id, count(*) AS size FROM stored GROUP BY shard_id),
sized AS (SELECT * FROM stored JOIN sizes USING (shard_id)),
{permuted("samples", "sized", "pos", "size", _keys(SHUFFLE_SEED, "1", "shard_id"))},
ordered AS (
  SELECT stock_id, time_id, shard_id, pos, o.v AS shard_pos, samples.v AS sample_pos,
    o.v // ((all_shards + {CONSUMERS - 1}) // {CONSUMERS}) AS consumer
  FROM samples JOIN shard_order AS o USING (shard_id))
SELECT *, (row_number() OVER (PARTITION BY consumer ORDER BY shard_pos, sample_pos) - 1) // {BATCH} AS batch
FROM ordered"""


def _exact_split(source: str) -> str:
    """The first rows of each stock by digest are train, the next validation, in exact numbers."""
    train, validation, held = quota.shares()
    rests = [f"(n * {p}) % {quota.PARTS}" for p in (train, validation, held)]
    return f"""
hashed AS (SELECT *, {digest(SPLIT_SEED, "stock_id", "time_id")} AS h FROM {source}),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY h) AS place, count(*) OVER (PARTITION BY stock_id) AS n
  FROM hashed),
remainders AS (
  SELECT stock_id, any_value(n) AS n, unnest([0, 1, 2]) AS s,
    unnest([any_value({rests[0]}), any_value({rests[1]}), any_value({rests[2]})]) AS rest,
    unnest([any_value(n * {train} // {quota.PARTS}), any_value(n * {validation} // {quota.PARTS}),
            any_value(n * {held} // {quota.PARTS})]) AS whole
  FROM counted GROUP BY stock_id),
quotas AS (
  SELECT stock_id, s, whole + CASE WHEN row_number() OVER (PARTITION BY stock_id ORDER BY rest DESC, s)
    <= n - sum(whole) OVER (PARTITION BY stock_id) THEN 1 ELSE 0 END AS q FROM remainders),
ends AS (
  SELECT stock_id, max(q) FILTER (s = 0) AS first, max(q) FILTER (s = 0) + max(q) FILTER (s = 1) AS second
  FROM quotas GROUP BY stock_id),
split AS (
  SELECT stock_id, time_id,
    CASE WHEN place <= first THEN 'train' WHEN place <= second THEN 'validation' ELSE 'eval' END AS split
  FROM counted JOIN ends USING (stock_id))"""


SQL["split_exact"] = f"""WITH keys AS (SELECT o_custkey AS stock_id, o_orderkey AS time_id FROM orders),
{_exact_split("keys")} SELECT * FROM split"""
SQL["split_exact_balance"] = f"""WITH keys AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE o_custkey % 40 END AS stock_id, o_orderkey AS time_id FROM orders),
{_exact_split("keys")} SELECT stock_id, split, count(*) AS n FROM split GROUP BY ALL"""

SQL["reg_path"] = f"""{PREDICTIONS},
folded AS (
  SELECT *, least(floor({unit(SPLIT_SEED, *KEY.split(", "))} * {FOLDS}), {FOLDS - 1})::INTEGER AS fold FROM predictions),
points AS (
  SELECT 'log_mse' AS loss, fold, pred_log AS x, y_log AS t, 1.0::DOUBLE AS w FROM folded
  UNION ALL SELECT 'mspe', fold, pred, y, 1 / ((y + {EPS!r}::DOUBLE) * (y + {EPS!r}::DOUBLE)) FROM folded),
folds AS (SELECT unnest(range({FOLDS}))::INTEGER AS fold),
regs AS (SELECT unnest({REGS})::DOUBLE AS reg),
means AS (
  SELECT loss, f.fold, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * t) / sum(w) AS mt
  FROM points AS p JOIN folds AS f ON p.fold <> f.fold GROUP BY ALL),
spreads AS (
  SELECT loss, m.fold, any_value(mx) AS mx, any_value(mt) AS mt, sum(w * (x - mx) * (x - mx)) / any_value(sw) AS vx,
    sum(w * (t - mt) * (t - mt)) / any_value(sw) AS vt, sum(w * (x - mx) * (t - mt)) / any_value(sw) AS c
  FROM points AS p JOIN means AS m USING (loss) WHERE p.fold <> m.fold GROUP BY ALL),
lines AS (
  SELECT loss, fold, reg, c / vx / (1 + reg / sqrt(vt)) AS slope, mt - c / vx / (1 + reg / sqrt(vt)) * mx AS intercept
  FROM spreads, regs)
SELECT loss, reg, fold, count(*) AS n, {r("any_value(slope)", 5, "slope")}, {r("any_value(intercept)", 5, "intercept")},
  {r("sqrt(sum(w * (t - intercept - slope * x) * (t - intercept - slope * x)) / sum(w))", 5, "root_error")}
FROM points JOIN lines USING (loss, fold) GROUP BY loss, reg, fold"""

SQL["norm_stream"] = EARLIER["norm_stats"]
SQL["append_norm"] = BUILT_FEATURES + " UNION ALL ".join(
    f""" SELECT '{c}' AS feature, count(*) AS count_seconds, {r(f"avg({c}::FLOAT::DOUBLE)", 3, "mean")},
    {r(STD.format(c=f"{c}::FLOAT"), 3, "std")} FROM built_train"""
    for c in FEATURES
)
_CELLS = " + ".join(f"coalesce({c}::FLOAT::DOUBLE, 0)" for c in FEATURES)
SQL["append_samples"] = f"""{BUILT_FEATURES},
sums AS (SELECT stock_id, time_id, sum({_CELLS}) AS total FROM built GROUP BY ALL)
SELECT stock_id, time_id, split, {r("ln(target + 1e-8::DOUBLE)::FLOAT", 3, "y_log")}, 8400::INTEGER AS cells, {r("total", 3)}
FROM placed JOIN sums USING (stock_id, time_id)"""

SQL["train_eval_line"] = f"""{BUILT_FEATURES},
points AS (
  SELECT split, ln(sqrt(sum(log_return::FLOAT::DOUBLE * log_return::FLOAT::DOUBLE)) + 1e-8::DOUBLE) AS x,
    any_value(ln(target + 1e-8::DOUBLE)::FLOAT)::DOUBLE AS t
  FROM built JOIN placed USING (stock_id, time_id, split) GROUP BY stock_id, time_id, split),
weighted AS (
  SELECT 'log_mse' AS loss, split, x, t, t AS y, 1.0::DOUBLE AS w FROM points
  UNION ALL SELECT 'rmspe', split, x, t, exp(t) - 1e-8::DOUBLE, 1 / (exp(t) * exp(t)) FROM points),
means AS (
  SELECT loss, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM weighted
  WHERE split = 'train' GROUP BY loss),
lines AS (
  SELECT loss, any_value(mx) AS mx, any_value(my) AS my,
    sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS slope
  FROM weighted JOIN means USING (loss) WHERE split = 'train' GROUP BY loss),
scored AS (
  SELECT loss, CASE WHEN loss = 'log_mse' THEN exp(my + slope * (x - mx)) - 1e-8::DOUBLE
      ELSE greatest(my + slope * (x - mx), 0) END AS p, exp(t) - 1e-8::DOUBLE AS y
  FROM weighted JOIN lines USING (loss) WHERE split = 'eval')
SELECT loss, {r("sqrt(avg((p - y) * (p - y)))", 4, "rmse")},
  {r("sqrt(avg((p - y) / (y + 1e-8::DOUBLE) * ((p - y) / (y + 1e-8::DOUBLE))))", 4, "rmspe")}, count(*) AS count
FROM scored GROUP BY loss"""

SQL["bucket_features_layout"] = EARLIER["bucket_features"]
SQL["bucket_udf"] = f"""{ALL}
SELECT stock_id, time_id, {r("sqrt(sum(log_return * log_return))", 8, "rv")}, {r("sum(size)", 8, "size")}
FROM features GROUP BY stock_id, time_id"""

_BOUNDS = ", ".join(
    f"max(least) FILTER (rank_{p} > before AND rank_{p} <= upto) / 1000.0::DOUBLE AS p{p}_ms_low, "
    f"max(most) FILTER (rank_{p} > before AND rank_{p} <= upto) / 1000.0::DOUBLE AS p{p}_ms_high"
    for p in (50, 95, 99)
)
_RANKS = ", ".join(
    f"greatest(1, floor({p / 100!r}::DOUBLE * sum(n) OVER (PARTITION BY window_start, mode))) AS rank_{p}" for p in (50, 95, 99)
)
SQL["latency_live"] = f"""WITH timed AS (
  SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type AS mode,
    round(value * 1000)::BIGINT AS v FROM events),
done AS (SELECT * FROM timed WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR),
ranged AS (SELECT *, greatest(length(bin(v)) - {live.BITS}, 0)::BIGINT AS s FROM done),
ranges AS (
  SELECT window_start, mode, (v >> s) << s AS low, count(*) AS n, sum(v) AS total, min(v) AS least, max(v) AS most
  FROM ranged GROUP BY ALL),
placed AS (
  SELECT *, sum(n) OVER (PARTITION BY window_start, mode ORDER BY low) AS upto,
    sum(n) OVER (PARTITION BY window_start, mode ORDER BY low) - n AS before, {_RANKS} FROM ranges),
bounds AS (
  SELECT window_start, mode, sum(total) / 1000.0::DOUBLE / sum(n) AS mean_ms, {_BOUNDS},
    sum(n)::BIGINT AS count, 0::BIGINT AS invalid FROM placed GROUP BY ALL)
SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS window_start, mode, count, invalid, {rs("mean_ms, p50_ms_low, p50_ms_high, p95_ms_low, p95_ms_high, p99_ms_low, p99_ms_high")}
FROM bounds"""

SQL["features_live"] = f"""{ALL},
ends AS (SELECT time_id * 600 + seconds_in_bucket AS slot FROM book UNION ALL SELECT time_id * 600 + seconds_in_bucket FROM trade)
SELECT {SLOT}, size, order_count, {rs("wap_last")}, seconds_since_last_wap, {rs("log_return, rv_30s, rv_120s, spread_last")},
  {rs("mid_last, rel_spread_last, ofi_last")}, seconds_since_last_trade, last_trade_gap_geq_cap, order_intensity_60s
FROM features WHERE (time_id * 600 + seconds_in_bucket + 1) * 144 <= (SELECT max(slot) FROM ends) * 144 - 7200"""

_CUTS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS place, unnest({edges})::DOUBLE AS edge" for i, (c, edges) in enumerate(STUMP_EDGES.items())
)
SQL["boosted_stump"] = f"""{PREDICTIONS},
weighted AS (
  SELECT p.*, l_quantity, 1 / ((y + {EPS!r}::DOUBLE) * (y + {EPS!r}::DOUBLE)) AS w
  FROM predictions AS p JOIN lineitem USING ({KEY})),
values AS (
  SELECT 'l_quantity' AS feature, l_quantity::DOUBLE AS x, y, w FROM weighted
  UNION ALL SELECT 'pred', pred, y, w FROM weighted),
cuts AS ({_CUTS}),
sides AS (
  SELECT c.feature, place, edge, x <= edge AS is_low, sum(w * y) / sum(w) AS value, sum(w) AS w
  FROM values JOIN cuts AS c USING (feature) GROUP BY ALL),
means AS (SELECT sum(w * y) / sum(w) AS m FROM weighted),
gains AS (
  SELECT feature, place, edge, sum(w * (value - m) * (value - m)) AS gain, max(value) FILTER (is_low) AS low,
    max(value) FILTER (NOT is_low) AS high
  FROM sides, means GROUP BY ALL HAVING count(*) = 2)
SELECT feature, edge, {r("low", 4)}, {r("high", 4)} FROM gains ORDER BY gain DESC, place, edge LIMIT 1"""
