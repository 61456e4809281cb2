"""The append-only usage log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.sources.logs import parse_usage


def follow(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Spans of files as they arrive below ``path``; each file is read once."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(path)
    return parse_usage(lines)


def by_window(spans: DataFrame, length: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """ms and spans for each step and window of time; rows later than ``late`` are left out, and state is dropped with them."""
    timed = spans.withColumn("time", F.to_timestamp("at")).withWatermark("time", late)
    out = timed.groupBy(F.window("time", length, slide), "step").agg(F.sum("ms").alias("ms"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "step", "ms", "n")


def sessions(spans: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of spans of an actor with no pause of ``gap``."""
    timed = spans.withColumn("time", F.to_timestamp("at")).withWatermark("time", late).withColumn("who", F.coalesce("actor", F.lit("kit")))
    out = timed.groupBy(F.session_window("time", gap), "who").agg(F.sum("ms").alias("ms"), F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("who").alias("actor"), "ms", "n")


def once(spans: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (run, step, sub, part, at) once, however often it was written within the watermark."""
    timed = spans.withColumn("time", F.to_timestamp("at")).withWatermark("time", late)
    return timed.dropDuplicatesWithinWatermark(["run", "step", "sub", "part", "at"])


def append_to(spans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, added as Parquet by version; a restart goes on where the checkpoint stands."""
    return spans.writeStream.format("parquet").partitionBy("version").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
