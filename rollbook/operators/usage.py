"""Usage analytics over page views and events: totals, unique visitors, breakdowns, daily series, recent visitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SINCE = "2025-06-01 00:00:00"
TOP = 50


def _first_delivery(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per id: the first received; ties by content. Min over a struct needs one partial aggregate, no sort."""
    order = F.struct("received_at", *[c for c in cols if c != "id"])
    return df.groupBy("id").agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*")


def ingest_page_views(views: DataFrame) -> DataFrame:
    """Rows as they enter the store: delivered once, visitor known, path with one leading slash."""
    one = _first_delivery(views, ["id", "visitor_id", "path", "ts", "referrer", "user_agent"])
    known = one.where("visitor_id is not null and trim(visitor_id) != ''")
    path = F.concat(F.lit("/"), F.regexp_replace(F.coalesce("path", F.lit("")), "^/+", ""))
    return known.select("id", "visitor_id", path.alias("path"), "ts", F.coalesce("referrer", F.lit("")).alias("referrer"), F.coalesce("user_agent", F.lit("")).alias("user_agent"))


def ingest_events(events: DataFrame) -> DataFrame:
    """As for page views; an event without a name is ``unknown``, broken payloads are null."""
    one = _first_delivery(events, ["id", "visitor_id", "event_name", "event_data", "ts", "page"])
    known = one.where("visitor_id is not null and trim(visitor_id) != ''")
    name = F.when(F.coalesce(F.trim("event_name"), F.lit("")) == "", "unknown").otherwise(F.col("event_name"))
    return known.select("id", "visitor_id", name.alias("event_name"), F.when(F.try_parse_json("event_data").isNotNull(), F.col("event_data")).alias("event_data"), "ts", F.coalesce("page", F.lit("")).alias("page"))


def since(df: DataFrame, bound: str = SINCE) -> DataFrame:
    """Rows not older than the bound; a lower bound only, pushed to the scan."""
    return df.where(F.col("ts") >= F.lit(bound).cast("timestamp"))


def day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def totals(views: DataFrame, events: DataFrame) -> DataFrame:
    v = views.agg(F.count("*").alias("total_page_views"))
    e = events.agg(F.count("*").alias("total_events"))
    return v.crossJoin(e).crossJoin(unique_visitors(views, events))  # three single rows


def unique_visitors(views: DataFrame, events: DataFrame) -> DataFrame:
    return views.select("visitor_id").union(events.select("visitor_id")).agg(F.countDistinct("visitor_id").alias("unique_visitors"))


def views_by_path(views: DataFrame) -> DataFrame:
    return views.groupBy("path").agg(F.count("*").alias("views"))


def events_by_name(events: DataFrame) -> DataFrame:
    return events.groupBy("event_name").agg(F.count("*").alias("total"), F.countDistinct("visitor_id").alias("unique_visitors"))


def daily(df: DataFrame) -> DataFrame:
    return df.groupBy(day("ts").alias("day")).agg(F.count("*").alias("n"))


def recent_visitors(views: DataFrame, events: DataFrame, top: int = TOP) -> DataFrame:
    """The visitors with most page views, ties by id; events are counted before the join, so neither side fans out."""
    v = views.groupBy("visitor_id").agg(F.max("ts").alias("last"), F.count("*").alias("page_views"))
    best = v.orderBy(F.desc("page_views"), "visitor_id").limit(top)
    e = events.groupBy("visitor_id").agg(F.count("*").alias("events"))
    label = F.concat(F.substring("visitor_id", 1, 16), F.lit("..."))
    return best.join(e, "visitor_id", "left").select("visitor_id", label.alias("label"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "page_views", F.coalesce("events", F.lit(0)).alias("events"))


def views_per_visitor(views: DataFrame) -> DataFrame:
    n = F.countDistinct("visitor_id")
    return views.agg(F.when(n > 0, F.round(F.count("*") / n, 6)).otherwise(0.0).alias("avg_views"))


def sessions(views: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions end when a visitor is idle for the gap."""
    w = views.groupBy("visitor_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("views"))
    return w.select("visitor_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "views")
