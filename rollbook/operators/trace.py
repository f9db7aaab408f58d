"""Run logs: summaries, rolling latencies, repeats, the folded feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(entries: DataFrame) -> DataFrame:
    """(category, entries, warnings, errors, seconds) of entries (category, level, duration)."""
    n = lambda level: F.count_if(F.col("level") == level)
    return entries.groupBy("category").agg(F.count("*").alias("entries"), n("warn").alias("warnings"), n("error").alias("errors"), F.round(F.sum("duration"), 2).alias("seconds"))


def slowest(entries: DataFrame, top: int = 15) -> DataFrame:
    g = entries.groupBy(F.concat("category", F.lit(": "), "message").alias("what")).agg(F.round(F.sum("duration"), 2).alias("seconds"))
    return g.orderBy(F.desc("seconds"), "what").limit(top)


def rolling_latency(calls: DataFrame, key: str, order: list[str], last: int = 10) -> DataFrame:
    """Sum and count of the last ten durations of each key, from which the mean follows. The window is per key; keys are users or hosts, not the whole table."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)
    return calls.select("id", F.round(F.sum("duration").over(w), 2).alias("seconds"), F.count("*").over(w).alias("calls"))


def repeat_runs(calls: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value, started, n): runs of equal values (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    runs = calls.withColumn("_n", new).withColumn("_run", F.sum("_n").over(w))
    return runs.groupBy(key, "_run", value).agg(F.min("id").alias("started"), F.count("*").alias("n")).drop("_run")


def feed(entries: DataFrame) -> DataFrame:
    """(site, records, done, phase): the highest count seen, its state at completion, the furthest phase of each site's log.

    Entries have (site, message). Counts, completion and phases are read by pattern; the fold is max.
    """
    low = F.lower("message")
    count = F.nullif(F.regexp_extract(low, r"(\d+)\s+(?:members|cards|records)", 1), F.lit("")).cast("bigint")
    phase = F.when(low.contains("enriched"), 3).when(low.contains("filter"), 2).when(low.contains("loaded"), 1).otherwise(0)
    return entries.groupBy("site").agg(F.coalesce(F.max(count), F.lit(0)).alias("records"), F.max(low.contains("enriched").cast("int")).alias("done"), F.max(phase).alias("phase"))
