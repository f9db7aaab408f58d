"""Streaming twins of the usage queries, with event time and watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "60 days"


def source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def once(views: DataFrame) -> DataFrame:
    """Each id once within the watermark; blank visitors left out."""
    known = views.where("visitor_id is not null and trim(visitor_id) != ''")
    return known.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["id"])


def daily(df: DataFrame) -> DataFrame:
    """Rows by day (tumbling windows), for update or complete mode."""
    w = df.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


def by_name(events: DataFrame) -> DataFrame:
    name = F.when(F.coalesce(F.trim("event_name"), F.lit("")) == "", "unknown").otherwise(F.col("event_name"))
    return events.groupBy(name.alias("event_name")).agg(F.count("*").alias("total"), F.approx_count_distinct("visitor_id").alias("visitors"))


def sessions(views: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of visitors, closed once the watermark has passed."""
    w = views.groupBy("visitor_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("views"))
    return w.select("visitor_id", F.col("w.start").alias("started"), "views")


def run_once(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything that is there now, into a table in memory; for small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
