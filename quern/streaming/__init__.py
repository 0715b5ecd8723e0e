"""Streams: event-time windows, sessions and deduplication with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    fields = {f.name: f.dataType.typeName() for f in stream.schema.fields}
    typed = stream.withColumn(time, F.col(time).cast("timestamp")) if fields[time] == "timestamp_ntz" else stream
    return typed.withWatermark(time, late)


def tumbling(stream: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aggregates of tumbling (or, with ``slide``, sliding) windows; rows later than ``late`` drop out."""
    grouped = _timed(stream, time, late).groupBy(F.window(time, width, slide) if slide else F.window(time, width), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in grouped.columns if c != "window"])


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], late: str = "1 hour") -> DataFrame:
    grouped = _timed(stream, time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in grouped.columns if c != "session_window"])


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First row of each key; state lives as long as the watermark."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(keys)
