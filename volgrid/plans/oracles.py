"""The registered queries in plain SQL, written from the definitions.

Written to be read: joins and windows follow the definitions one by one, where the DataFrame
operators use other shapes.
"""

from __future__ import annotations

from ..operators.split import split_thresholds
from ..schemas import EVAL_FRACTION, FEATURES, SHUFFLE_SEED, SPLIT_SEED, VALIDATION_FRACTION

SQL: dict[str, str] = {}

SLOT = "stock_id, time_id, seconds_in_bucket"
BOOK = "bid_price1, ask_price1, bid_size1, ask_size1"


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    """Rounded to ``digits`` without negative zeros."""
    value = f"round(({expr})::DOUBLE, {digits})"
    return f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END AS {name or expr}"


def rs(names: str, digits: int = 6) -> str:
    return ", ".join(r(n.strip(), digits) for n in names.split(","))


def digest(seed: int, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'({k})::VARCHAR' for k in keys)}))"


def unit(seed: int, *keys: str) -> str:
    return f"(('0x' || substring({digest(seed, *keys)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def split_case(u: str) -> str:
    train, validation = split_thresholds(EVAL_FRACTION, VALIDATION_FRACTION)
    return (
        f"CASE WHEN {u} < {train!r}::DOUBLE THEN 'train' "
        f"WHEN {u} < {validation!r}::DOUBLE THEN 'validation' ELSE 'eval' END"
    )


# Events as book and trade rows: the latest row of each kind per slot.
MARKET = """
ev AS (
  SELECT (user_id // 16)::INTEGER AS stock_id,
         date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS time_id,
         floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 144)::INTEGER AS seconds_in_bucket,
         event_id, event_type, ts, value, json_extract_string(props, '$.k')::BIGINT AS k
  FROM events),
book AS (
  SELECT stock_id, time_id, seconds_in_bucket,
         1 + value / 1000 AS bid_price1,
         (1 + value / 1000) + (event_id % 7 + 1) / 1000.0::DOUBLE AS ask_price1,
         k + 1 AS bid_size1, event_id % 50 + 1 AS ask_size1
  FROM ev WHERE event_type IN ('view', 'click', 'signup')
  QUALIFY row_number() OVER (PARTITION BY stock_id, time_id, seconds_in_bucket
                             ORDER BY ts DESC, event_id DESC) = 1),
trade AS (
  SELECT stock_id, time_id, seconds_in_bucket,
         event_id % 100 + 1 AS size, event_id % 5 + 1 AS order_count
  FROM ev WHERE event_type IN ('purchase', 'error')
  QUALIFY row_number() OVER (PARTITION BY stock_id, time_id, seconds_in_bucket
                             ORDER BY ts DESC, event_id DESC) = 1),
buckets AS (SELECT DISTINCT stock_id, time_id FROM ev),
merged AS (
  SELECT stock_id, time_id, seconds_in_bucket, bid_price1, ask_price1, bid_size1, ask_size1,
         size, order_count
  FROM book FULL JOIN trade USING (stock_id, time_id, seconds_in_bucket)),
grid AS (
  SELECT stock_id, time_id, i::INTEGER AS seconds_in_bucket FROM buckets, range(600) s(i)),
dense AS (
  SELECT stock_id, time_id, seconds_in_bucket, bid_price1, ask_price1, bid_size1, ask_size1,
         size, order_count
  FROM grid LEFT JOIN merged USING (stock_id, time_id, seconds_in_bucket))"""

FILL = """last_value({c} IGNORE NULLS) OVER (PARTITION BY stock_id, time_id ORDER BY seconds_in_bucket
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

OBSERVED = """
raw AS (
  SELECT *, (bid_price1 * ask_size1 + ask_price1 * bid_size1) / (bid_size1 + ask_size1 + 1e-8::DOUBLE) AS wap,
         ask_price1 - bid_price1 AS spread,
         (ask_price1 + bid_price1) / 2 AS mid,
         (bid_size1 - ask_size1) / (bid_size1 + ask_size1 + 1e-8::DOUBLE) AS ofi
  FROM dense)"""

FRAMES = f"""
filled AS (
  SELECT stock_id, time_id, seconds_in_bucket,
         coalesce(size, 0) AS size, coalesce(order_count, 0) AS order_count,
         {FILL.format(c="wap")} AS wap_last,
         {FILL.format(c="spread")} AS spread_last,
         {FILL.format(c="mid")} AS mid_last,
         {FILL.format(c="ofi")} AS ofi_last,
         {FILL.format(c="CASE WHEN wap IS NOT NULL THEN seconds_in_bucket END")} AS wap_second,
         {FILL.format(c="CASE WHEN size IS NOT NULL THEN seconds_in_bucket END")} AS trade_second
  FROM raw),
logged AS (SELECT *, CASE WHEN wap_last > 0 THEN ln(wap_last) END AS l FROM filled),
returned AS (
  SELECT *, coalesce(l - lag(l) OVER (PARTITION BY stock_id, time_id ORDER BY seconds_in_bucket), 0)
              AS log_return
  FROM logged),
features AS (
  SELECT stock_id, time_id, seconds_in_bucket, size::BIGINT AS size, order_count::BIGINT AS order_count,
         wap_last,
         least(coalesce(seconds_in_bucket - wap_second, seconds_in_bucket + 1), 15)::INTEGER
           AS seconds_since_last_wap,
         log_return,
         sqrt(sum(log_return * log_return) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) AS rv_30s,
         sqrt(sum(log_return * log_return) OVER (w ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) AS rv_120s,
         spread_last, mid_last, spread_last / (mid_last + 1e-8::DOUBLE) AS rel_spread_last, ofi_last,
         least(coalesce(seconds_in_bucket - trade_second, seconds_in_bucket + 1), 15)::INTEGER
           AS seconds_since_last_trade,
         (least(coalesce(seconds_in_bucket - trade_second, seconds_in_bucket + 1), 15) >= 15)::INTEGER
           AS last_trade_gap_geq_cap,
         (sum(order_count) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))::BIGINT
           AS order_intensity_60s
  FROM returned
  WINDOW w AS (PARTITION BY stock_id, time_id ORDER BY seconds_in_bucket)),
rv AS (
  SELECT stock_id, time_id, sqrt(sum(log_return * log_return)) AS rv FROM returned GROUP BY ALL),
forecasts AS (
  SELECT stock_id, time_id, rv AS pred, lead(rv) OVER (PARTITION BY stock_id ORDER BY time_id) AS target
  FROM rv),
labels_known AS (SELECT stock_id, time_id, target FROM forecasts WHERE target IS NOT NULL)"""

RAW = f"WITH {MARKET}, {OBSERVED}"
ALL = f"WITH {MARKET}, {OBSERVED}, {FRAMES}"

DOUBLE_FEATURES = [
    "wap_last",
    "log_return",
    "rv_30s",
    "rv_120s",
    "spread_last",
    "mid_last",
    "rel_spread_last",
    "ofi_last",
]


def feature_query(*names: str) -> str:
    columns = [r(n) if n in DOUBLE_FEATURES else n for n in names]
    return f"{ALL} SELECT {SLOT}, {', '.join(columns)} FROM features"


# --- sources and sinks -------------------------------------------------------------------

SQL["scan_labels_csv"] = f"{ALL} SELECT stock_id, time_id, {r('target')} FROM labels_known"
BOOK_ROWS = f"{SLOT}, {rs('bid_price1, ask_price1')}, bid_size1, ask_size1"
SQL["scan_book"] = f"{RAW} SELECT {BOOK_ROWS} FROM book"
SQL["scan_trade"] = f"{RAW} SELECT {SLOT}, size, order_count FROM trade"
SQL["bucket_lookup"] = f"{SQL['scan_book']} WHERE stock_id = 0 AND time_id = 5"
LABEL_SPLIT = split_case(unit(SPLIT_SEED, "stock_id", "time_id"))
SQL["index_round_trip"] = (
    f"{ALL} SELECT stock_id, time_id, {r('target')}, {LABEL_SPLIT} AS split FROM labels_known"
)
BUILT = f"""{ALL},
split_labels AS (
  SELECT *, {LABEL_SPLIT} AS split, {unit(SPLIT_SEED, "stock_id", "time_id")} AS u FROM labels_known),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY u, stock_id, time_id) - 1 AS rank
  FROM split_labels)"""
SQL["shards_round_trip"] = f"""{BUILT}
SELECT stock_id, time_id, split, (rank // 64)::BIGINT AS shard_id, (rank % 64)::BIGINT AS pos,
       {r("ln(target + 1e-8::DOUBLE)::FLOAT", 4, "y_log")}, 600::INTEGER AS seconds, 8400::INTEGER AS cells
FROM placed"""

# --- split -------------------------------------------------------------------------------

ORDER_KEYS = "o_custkey AS stock_id, o_orderkey AS time_id"
ORDER_UNIT = unit(SPLIT_SEED, "o_custkey", "o_orderkey")
SQL["derive_paths"] = f"""SELECT {ORDER_KEYS},
  'raw/book_train.parquet/stock_id=' || o_custkey AS book_path,
  'raw/trade_train.parquet/stock_id=' || o_custkey AS trade_path FROM orders"""
SQL["hash_unit"] = f"SELECT {ORDER_KEYS}, {r(ORDER_UNIT, 9, 'unit')} FROM orders"
SQL["hash_split"] = f"SELECT {ORDER_KEYS}, {split_case(ORDER_UNIT)} AS split FROM orders"
SQL["split_route"] = f"""SELECT {ORDER_KEYS}, o_totalprice AS target FROM orders
WHERE {split_case(ORDER_UNIT)} = 'validation'"""
SQL["split_balance"] = f"""SELECT stock_id, count(*) FILTER (split = 'train') AS train,
  count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'eval') AS eval
FROM ({SQL["hash_split"]}) GROUP BY stock_id"""

# --- grid and features ---------------------------------------------------------------------

MERGED_ROWS = f"{BOOK_ROWS}, size, order_count"
SQL["book_trade_merge"] = f"{RAW} SELECT {MERGED_ROWS} FROM merged"
SQL["book_trade_merge_book_only"] = (
    f"{RAW} SELECT {MERGED_ROWS} FROM book LEFT JOIN trade USING ({SLOT})"
)
SQL["densify_grid"] = f"{RAW} SELECT {MERGED_ROWS} FROM dense"


def filled(columns: str) -> str:
    return ", ".join(f"{FILL.format(c=c.strip())} AS {c.strip()}" for c in columns.split(","))


SQL["asof_book_on_grid"] = f"""{RAW}
SELECT {BOOK_ROWS} FROM (SELECT {SLOT}, {filled(BOOK)} FROM dense)"""
SQL["ffill"] = f"""{RAW}
SELECT {MERGED_ROWS} FROM (SELECT {SLOT}, {filled(BOOK + ", size, order_count")} FROM dense)"""
SQL["wap_raw"] = f"{RAW} SELECT {SLOT}, {r('wap')} FROM raw"
SQL["wap_last"] = feature_query("wap_last")
SQL["trade_fill"] = feature_query("size", "order_count")
SQL["staleness"] = feature_query(
    "seconds_since_last_wap", "seconds_since_last_trade", "last_trade_gap_geq_cap"
)
SQL["log_return"] = feature_query("log_return")
SQL["rolling_rv"] = feature_query("rv_30s", "rv_120s")
SQL["spread_mid"] = feature_query("spread_last", "mid_last", "rel_spread_last")
SQL["book_imbalance"] = feature_query("ofi_last")
SQL["order_intensity"] = feature_query("order_intensity_60s")
SQL["bucket_features"] = feature_query(*FEATURES)
SQL["bucket_rv"] = f"{ALL} SELECT stock_id, time_id, {r('rv', 8)} FROM rv"
SQL["label_attach"] = f"""{ALL}
SELECT {SLOT}, {rs("target, wap_last, rv_30s")}
FROM labels_known JOIN features USING (stock_id, time_id)"""
SQL["bucket_tensor_rows"] = f"""{ALL}
SELECT {SLOT}, {', '.join(r(f'{c}::FLOAT', 4, c) for c in FEATURES)} FROM features"""
SQL["log_label"] = f"""{ALL}
SELECT stock_id, time_id, {r("target", 8)}, {r("ln(target + 1e-8::DOUBLE)", 8, "y_log")},
       {r("exp(ln(target + 1e-8::DOUBLE)) - 1e-8::DOUBLE", 8, "y")} FROM labels_known"""
SQL["shape_check"] = f"{RAW} SELECT count(*) AS samples, 0::BIGINT AS bad_samples FROM buckets"
SQL["duplicate_slots"] = f"""{RAW}
SELECT {SLOT}, count(*) AS copies FROM ev GROUP BY ALL HAVING count(*) > 1"""
SQL["pred_truth_join"] = f"""{ALL}
SELECT stock_id, time_id, {rs("pred, target", 8)} FROM forecasts WHERE target IS NOT NULL"""

# --- statistics ------------------------------------------------------------------------------

# The split is decided once per bucket, and the window chain runs once.
SPLIT_FEATURES = f"""{ALL},
bucket_split AS MATERIALIZED (
  SELECT *, {split_case(unit(SPLIT_SEED, "stock_id", "time_id"))} AS split FROM buckets),
tagged AS MATERIALIZED (
  SELECT features.*, split FROM features JOIN bucket_split USING (stock_id, time_id)),
train AS (SELECT * FROM tagged WHERE split = 'train')"""
SQL["norm_moments"] = SPLIT_FEATURES + " UNION ALL ".join(
    f""" SELECT '{c}' AS feature, {r(f"sum({c}::DOUBLE)", 5, "total")},
    {r(f"sum({c}::DOUBLE * {c}::DOUBLE)", 5, "total_sq")}, count({c}) AS observed FROM train"""
    for c in FEATURES
)
STD = "sqrt(greatest(var_pop({c}::DOUBLE), 1e-12::DOUBLE))"
SQL["norm_stats"] = SPLIT_FEATURES + " UNION ALL ".join(
    f""" SELECT '{c}' AS feature, count(*) AS count_seconds, {r(f"avg({c}::DOUBLE)", 6, "mean")},
    {r(STD.format(c=c), 6, "std")} FROM train"""
    for c in FEATURES
)


def _scaled(mean: str, std: str) -> str:
    """Every feature by its statistics, given as expressions of ``{c}``."""
    return ", ".join(
        r(f"({c} - {mean.format(c=c)}) / ({std.format(c=c)} + 1e-12::DOUBLE)", 5, c) for c in FEATURES
    )


_TRAIN_VALUE = "(CASE WHEN split = 'train' THEN {c} END)"


SQL["synthetic_samples"] = f"""{RAW}
SELECT stock_id, time_id, 8400::BIGINT AS cells, true AS centred, true AS scaled, true AS repeatable
FROM buckets"""
# Statistics over all rows of the train split, next to every row.
_OVER = {
    c: (f"avg({_TRAIN_VALUE.format(c=c)}::DOUBLE) OVER ()",
        f"sqrt(greatest(var_pop({_TRAIN_VALUE.format(c=c)}::DOUBLE) OVER (), 1e-12::DOUBLE))")
    for c in FEATURES
}
SQL["normalize"] = f"""{SPLIT_FEATURES},
scaled AS (
  SELECT {SLOT}, split, {", ".join(r(f"({c} - {m}) / ({d} + 1e-12::DOUBLE)", 5, c) for c, (m, d) in _OVER.items())}
  FROM tagged)
SELECT * EXCLUDE (split) FROM scaled WHERE split = 'train'"""
SQL["normalize_eval_split"] = f"""{SPLIT_FEATURES}
SELECT {SLOT}, {_scaled("(SELECT avg({c}::DOUBLE) FROM train)", f"(SELECT {STD} FROM train)")}
FROM tagged WHERE split = 'eval'"""
# One row per value: statistics are joined on the feature.
SQL["normalize_long"] = f"""{SPLIT_FEATURES},
long AS (
  {" UNION ALL ".join(f"SELECT {SLOT}, split, '{c}' AS feature, {c}::DOUBLE AS v FROM tagged" for c in FEATURES)}),
stats AS (
  SELECT feature, avg(v) AS mean, {STD.format(c="v")} AS std FROM long WHERE split = 'train' GROUP BY feature)
SELECT {SLOT}, feature, {r("(v - mean) / (std + 1e-12::DOUBLE)", 5, "value")}
FROM long JOIN stats USING (feature) WHERE split = 'validation'"""

ROUGH = """WITH rough AS (SELECT event_id, CASE event_id % 7
  WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN NULL
  WHEN 4 THEN (value - 40) / 4 WHEN 5 THEN (value - 40) * 40 ELSE value - 40 END AS raw FROM events)"""


def bounded(bound: int) -> str:
    return (
        f"CASE WHEN raw IS NULL OR isnan(raw) OR isinf(raw) THEN 0 "
        f"WHEN raw > {bound} THEN {bound} WHEN raw < -{bound} THEN -{bound} ELSE raw END"
    )


SQL["sanitize"] = f"""{ROUGH} SELECT event_id, {r(bounded(10), 6, "normalized")},
{r(bounded(1000), 6, "raw_scale")} FROM rough"""
SQL["safe_exp"] = f"""{ROUGH}, sane AS (
  SELECT event_id, CASE WHEN raw IS NULL OR isnan(raw) THEN 0 WHEN raw = 'inf'::DOUBLE THEN 50
    WHEN raw = '-inf'::DOUBLE THEN -50 ELSE raw END AS y_log FROM rough)
SELECT event_id, {r("y_log")},
  {r("ln(exp(CASE WHEN y_log > 20 THEN 20 WHEN y_log < -20 THEN -20 ELSE y_log END) - 1e-8::DOUBLE + 2e-8::DOUBLE)", 6, "log_y")}
FROM sane"""
SQL["nonfinite_report"] = f"""{ROUGH} SELECT 'raw' AS feature,
  count(*) FILTER (raw IS NULL) AS nulls, count(*) FILTER (isnan(raw)) AS nans,
  count(*) FILTER (isinf(raw)) AS infinities, count(*) AS total FROM rough"""

# --- metrics -----------------------------------------------------------------------------

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
PREDICTIONS = f"""WITH predictions AS (
  SELECT {KEY}, l_returnflag, month(l_shipdate)::INTEGER AS epoch,
         l_extendedprice AS y, l_quantity * p_retailprice AS pred,
         ln(l_extendedprice + 1e-8::DOUBLE) AS y_log,
         ln(l_quantity * p_retailprice + 1e-8::DOUBLE) AS pred_log
  FROM lineitem JOIN part ON l_partkey = p_partkey),
errors AS (
  SELECT *, exp(pred_log) - exp(y_log) AS diff,
         (exp(pred_log) - exp(y_log)) / exp(y_log) AS rel FROM predictions)"""
SQL["mspe"] = f"{PREDICTIONS} SELECT {r('avg(rel * rel)', 7, 'mspe')} FROM errors"
SQL["log_mse"] = (
    f"{PREDICTIONS} SELECT {r('avg((pred_log - y_log) * (pred_log - y_log))', 7, 'log_mse')} FROM errors"
)
SQL["rmspe_batched"] = f"{PREDICTIONS} SELECT {r('sqrt(avg(rel * rel))', 7, 'rmspe')} FROM errors"
REPORT = f"""{r("sqrt(avg(diff * diff))", 4, "rmse")}, {r("sqrt(avg(rel * rel))", 4, "rmspe")},
  count(*) AS count"""
SQL["eval_report"] = f"{PREDICTIONS} SELECT {REPORT} FROM errors"
SQL["eval_by_group"] = f"{PREDICTIONS} SELECT l_returnflag, {REPORT} FROM errors GROUP BY l_returnflag"
SQL["eval_report_missing"] = f"""{PREDICTIONS},
kept AS (SELECT * FROM errors WHERE l_partkey % 3 <> 0),
report AS (SELECT l_returnflag, {REPORT} FROM kept GROUP BY l_returnflag),
every AS (SELECT l_returnflag, count(*) AS n FROM errors GROUP BY l_returnflag)
SELECT l_returnflag, rmse, rmspe, count, n - count AS missing FROM report JOIN every USING (l_returnflag)"""
SQL["mspe_gradient"] = f"""{PREDICTIONS}
SELECT {KEY}, {r('''2 * diff / (exp(y_log) * exp(y_log) * (SELECT count(*) FROM predictions))
  * (exp(pred_log) - 1e-8::DOUBLE)''', 10, "gradient")} FROM errors"""
SQL["running_metric"] = f"""{PREDICTIONS}, steps AS (
  SELECT epoch, rel, row_number() OVER (PARTITION BY epoch ORDER BY
    {unit(SHUFFLE_SEED, *KEY.split(", "))}, {KEY}, y, pred) AS step FROM errors),
running AS (
  SELECT epoch, step, sqrt(avg(rel * rel) OVER (PARTITION BY epoch ORDER BY step)) AS metric FROM steps)
SELECT epoch, step, step AS n, {r("metric", 7)} FROM running WHERE step % 200 = 0"""
EPOCHS = f"""{PREDICTIONS}, epochs AS (
  SELECT epoch, sqrt(avg(rel * rel)) AS metric FROM errors GROUP BY epoch)"""
SQL["epoch_metric"] = f"{EPOCHS} SELECT epoch, {r('metric', 7)} FROM epochs"
SQL["best_so_far"] = f"""{EPOCHS} SELECT epoch, {r("metric", 7)}, coalesce(metric < min(metric) OVER (
  ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM epochs"""
SQL["best_epoch"] = f"{EPOCHS} SELECT epoch, {r('metric', 7)} FROM epochs ORDER BY epochs.metric, epoch LIMIT 1"

# --- shards, shuffles, batches ---------------------------------------------------------------

RANKED = f"""WITH keyed AS (SELECT {ORDER_KEYS}, o_totalprice AS target, {ORDER_UNIT} AS u,
  {split_case(ORDER_UNIT)} AS split FROM orders),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY u, stock_id, time_id) - 1 AS rank,
         row_number() OVER (PARTITION BY split ORDER BY u, stock_id, time_id) - 1 AS split_rank
  FROM keyed)"""
SQL["shard_assign"] = f"""{RANKED} SELECT stock_id, time_id, (rank // 2048)::BIGINT AS shard_id,
  (rank % 2048)::BIGINT AS pos, {r("ln(target + 1e-8::DOUBLE)", 6, "y_log")} FROM ranked"""
SQL["shard_assign_by_split"] = f"""{RANKED} SELECT stock_id, time_id, split,
  (split_rank // 2048)::BIGINT AS shard_id, (split_rank % 2048)::BIGINT AS pos FROM ranked"""
SHUFFLED = f"""{RANKED},
samples AS (SELECT stock_id, time_id, (rank // 64)::BIGINT AS shard_id FROM ranked),
shards AS (SELECT shard_id, count(*) AS samples FROM samples GROUP BY shard_id),
shuffled AS (
  SELECT *, row_number() OVER (ORDER BY {unit(SHUFFLE_SEED, "0", "shard_id")}, shard_id) - 1 AS shard_pos
  FROM shards),
sliced AS (
  SELECT *, floor(shard_pos / ceil((SELECT count(*) FROM shards) / 4))::BIGINT AS consumer FROM shuffled)"""
SQL["shard_shuffle"] = f"{SHUFFLED} SELECT shard_id, samples, shard_pos FROM shuffled"
PERMUTED = f"{digest(SHUFFLE_SEED, '0', 'stock_id', 'time_id')}, stock_id, time_id"
SQL["sample_shuffle"] = f"""{RANKED},
samples AS (SELECT stock_id, time_id, (rank // 2048)::BIGINT AS shard_id FROM ranked)
SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY {PERMUTED}) - 1 AS sample_pos FROM samples"""
SQL["consumer_slices"] = f"{SHUFFLED} SELECT shard_id, samples, shard_pos, consumer FROM sliced"
SQL["batch_assign"] = f"""{SHUFFLED}, streamed AS (
  SELECT stock_id, time_id, shard_id, consumer,
         row_number() OVER (PARTITION BY consumer ORDER BY shard_pos, {PERMUTED}) - 1 AS place
  FROM samples JOIN sliced USING (shard_id))
SELECT stock_id, time_id, shard_id, consumer, (place // 64)::BIGINT AS batch FROM streamed"""

# --- latency -------------------------------------------------------------------------------


def latency(by: str, extra: str = "") -> str:
    picks = ", ".join(
        r(f"max(latency_ms) FILTER (rn = greatest(1, floor({p} * n)))", 6, f"p{int(p * 100)}_ms")
        for p in (0.50, 0.95, 0.99)
    )
    return f"""WITH timed AS (
  SELECT event_type AS mode, value AS latency_ms,
         row_number() OVER (PARTITION BY {by or "1"} ORDER BY value) AS rn,
         count(*) OVER (PARTITION BY {by or "1"}) AS n FROM events)
SELECT {"mode," if by else ""} {r("avg(latency_ms)", 6, "mean_ms")}, {picks}, count(*) AS count,
  {r("sum(latency_ms) / 1000", 6, "total_s")},
  {r("count(*) * 32 / greatest(sum(latency_ms) / 1000, 1e-8)", 6, "throughput_qps")}{extra}
FROM timed {"GROUP BY mode" if by else ""}"""


SQL["latency_summary"] = latency("")
SQL["latency_by_mode"] = latency("event_type", ", 32::INTEGER AS batch_size")

# --- fitting and scoring -------------------------------------------------------------------

SQL["fit_log_mse"] = f"""{PREDICTIONS} SELECT {r("regr_slope(y_log, pred_log)", 6, "slope")},
  {r("regr_intercept(y_log, pred_log)", 6, "intercept")} FROM predictions"""
SQL["fit_mspe"] = f"""{PREDICTIONS}, weighted AS (
  SELECT exp(y_log) - 1e-8::DOUBLE AS t, pred AS p, 1 / (exp(y_log) * exp(y_log)) AS w FROM predictions),
means AS (SELECT sum(w * p) / sum(w) AS mp, sum(w * t) / sum(w) AS mt FROM weighted),
line AS (
  SELECT sum(w * (p - mp) * (t - mt)) / sum(w * (p - mp) * (p - mp)) AS slope FROM weighted, means)
SELECT {r("slope")}, {r("mt - slope * mp", 6, "intercept")} FROM line, means"""
SQL["score_linear"] = f"""{PREDICTIONS}, line AS (
  SELECT regr_slope(y_log, pred_log) AS slope, regr_intercept(y_log, pred_log) AS intercept FROM predictions)
SELECT {KEY}, {r("intercept + slope * pred_log", 6, "y_log_pred")} FROM predictions, line"""




def mean_model(features: str, train: str, normal: bool = True) -> str:
    """``y_log_pred`` per bucket: mean of all cells, normalized by the train rows' statistics."""
    one = ", ".join(
        f"avg({c}::DOUBLE) AS mean_{c}, {STD.format(c=c)} AS std_{c}" for c in FEATURES
    )
    scaled = "({c} - mean_{c}) / (std_{c} + 1e-12::DOUBLE)" if normal else "{c}::FLOAT::DOUBLE"
    cells = " + ".join(f"coalesce({scaled.format(c=c)}, 0)" for c in FEATURES)
    return f"""norm AS (SELECT {one} FROM {train}),
scored AS (
  SELECT stock_id, time_id, avg(({cells}) / {len(FEATURES)}) AS y_log_pred FROM {features}, norm GROUP BY ALL)"""


REAL = r("exp(y_log_pred) - 1e-8::DOUBLE", 3, "y_pred")
SQL["score_batch"] = f"""{ALL}, {mean_model("features", "features")}
SELECT stock_id, time_id, {r("y_log_pred", 3)}, {REAL} FROM scored"""
SQL["score_json_requests"] = f"""{ALL}, {mean_model("features", "features", normal=False)}
SELECT stock_id || '-' || time_id AS request_id, {r("least(20, greatest(-20, y_log_pred))", 6, "y_log")} FROM scored"""

# The built samples hold the labelled buckets; statistics come from their train split.
BUILT_FEATURES = f"""{BUILT},
built AS (SELECT features.*, split FROM features JOIN placed USING (stock_id, time_id)),
built_train AS (SELECT * FROM built WHERE split = 'train')"""
SQL["score_stream"] = f"""{BUILT_FEATURES}, {mean_model("built", "built_train")}
SELECT stock_id, time_id, split, {r("y_log_pred", 3)}, {REAL} FROM scored JOIN placed USING (stock_id, time_id)"""
SQL["manifest"] = f"""{BUILT_FEATURES},
shards AS (SELECT split, count(DISTINCT rank // 64) AS num_shards FROM placed GROUP BY split),
norm AS ({" UNION ALL ".join(f"""
  SELECT '{c}' AS feature, avg({c}::FLOAT::DOUBLE) AS mean,
         sqrt(greatest(var_pop({c}::FLOAT::DOUBLE), 1e-12::DOUBLE)) AS std FROM built_train"""
  for c in FEATURES)})
SELECT split, num_shards, 64::BIGINT AS shard_size,
  CASE WHEN split = 'train' THEN (SELECT count(*) FROM built_train) ELSE 0 END::BIGINT AS count_seconds,
  'train' AS source, feature, {rs("mean, std", 3)}
FROM shards, norm"""

CLEAN = " + ".join(
    f"greatest(-10, least(10, coalesce(({c} - mean_{c}) / (std_{c} + 1e-12::DOUBLE), 0)))" for c in FEATURES
)
MOMENTS = ", ".join(f"avg({c}::DOUBLE) AS mean_{c}, {STD.format(c=c)} AS std_{c}" for c in FEATURES)
SQL["score_eval_report"] = f"""{BUILT_FEATURES},
norm AS MATERIALIZED (SELECT {MOMENTS} FROM built_train),
scored AS (
  SELECT stock_id, time_id, exp(avg(({CLEAN}) / {len(FEATURES)})) - 1e-8::DOUBLE AS p
  FROM built, norm WHERE split = 'eval' GROUP BY ALL),
pairs AS (SELECT p, target AS y FROM scored JOIN placed USING (stock_id, time_id))
SELECT {r("sqrt(avg((p - y) * (p - y)))", 3, "rmse")},
  {r("sqrt(avg((p - y) / (y + 1e-8::DOUBLE) * ((p - y) / (y + 1e-8::DOUBLE))))", 3, "rmspe")},
  count(*) AS count FROM pairs"""
