"""A graph that arrives as a stream of events: windowed edge counts with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def edge_windows(events: DataFrame, window: str = "1 day", late: str = "1 hour", src: str = "src", dst: str = "dst", ts: str = "ts") -> DataFrame:
    """``start, src, dst, w``: edges counted in tumbling windows; rows later than ``late`` behind the newest are dropped.

    Works on a stream and on a table alike.
    """
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("w"))
    return counted.select(F.col("window.start").alias("start"), "src", "dst", "w")


def block_windows(events: DataFrame, assignment: DataFrame, window: str = "1 day", late: str = "1 hour", src: str = "src", dst: str = "dst", ts: str = "ts") -> DataFrame:
    """``start, r, c, w``: the block matrix of each window; the labels are a static table."""
    source, target = assignment.select(F.col("v").alias(src), F.col("b").alias("r")), assignment.select(F.col("v").alias(dst), F.col("b").alias("c"))
    labelled = events.join(source, src).join(target, dst)
    counted = labelled.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), "r", "c").agg(F.count("*").alias("w"))
    return counted.select(F.col("window.start").alias("start"), "r", "c", "w")


def maintain(stream: DataFrame, path: str, checkpoint: str):
    """Write a windowed stream's closed windows as Parquet; the query runs until what is there is done."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
