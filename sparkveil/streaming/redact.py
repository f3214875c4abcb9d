"""Redaction on streams: the batch plan, unchanged, as it is a stateless map; and counts by time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import configuration
from ..functions.spans import unnest
from ..plans.policy import AnalyzerParams, Policy


def read_folder(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """A stream over the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def redact_stream(stream: DataFrame, policies: Sequence[Policy], engine: Engine = Engine(), id_col: str = "doc_id", text_col: str = "text", *, run_secret: bytes, params: AnalyzerParams = AnalyzerParams()) -> DataFrame:
    """``stream`` with entities and redacted text. ``run_secret`` keeps pseudonyms the same over restarts; whoever knows it can link them, so there is no default."""
    if not run_secret:
        raise configuration("a stream needs a run secret of its own")
    return engine.run(stream, policies, params, id_col=id_col, text_col=text_col, run_secret=run_secret)


def window_counts(entities: DataFrame, time_col: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window_start, label, n): entities by label in tumbling windows, closed by a watermark."""
    rows = unnest(entities.withWatermark(time_col, late), [time_col], "entities", "e")
    counts = rows.groupBy(F.window(time_col, width), F.col("e.label").alias("label")).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "label", "n")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work through all that has arrived and stop; the checkpoint makes a restart go on where it stopped."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
