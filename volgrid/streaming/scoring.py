"""Online scoring as a stream: files in, predictions out, the batch operator in between.

Scoring keeps no state, so there is nothing to watermark; progress lives in the checkpoint
folder and a restarted stream neither repeats nor skips a file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.model import Predictor, sane_predictions, score_requests, score_samples
from ..sources.requests import encode_json_responses, parse_json_requests

REQUEST_SCHEMA = "request_id string, body string"
#: By default Spark leaves out files a week older than the newest that it has seen.
ANY_AGE = "36500d"


def read_sample_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFileAge", ANY_AGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_request_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REQUEST_SCHEMA).option("maxFileAge", ANY_AGE).json(path)


def _write(scored: DataFrame, path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = scored.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def score_sample_stream(
    samples: DataFrame,
    load: Callable[[], Predictor],
    mean: list[float],
    std: list[float],
    keep: list[str],
    path: str,
    checkpoint: str,
    output: str = "real",
    available_now: bool = False,
) -> StreamingQuery:
    """Append a prediction per arriving sample to ``path``."""
    scored = sane_predictions(score_samples(samples, load, mean, std, keep), output)
    return _write(scored, path, checkpoint, available_now)


def score_request_stream(
    requests: DataFrame,
    load: Callable[[], Predictor],
    mean: list[float],
    std: list[float],
    path: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Append a JSON response per arriving JSON request; a bad request gets an error."""
    parsed = parse_json_requests(requests)
    answers = score_requests(parsed, load, mean, std, ["request_id"])
    return _write(encode_json_responses(answers), path, checkpoint, available_now)
