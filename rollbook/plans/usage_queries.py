"""Queries of usage analytics, run logs and streams, with independent SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators import trace, usage
from rollbook.streaming import usage as stream
from rollbook.work import load


def _views(s: SparkSession, d: str) -> DataFrame:
    return usage.since(usage.ingest_page_views(load(s, d, "page_views")))


def _events(s: SparkSession, d: str) -> DataFrame:
    return usage.since(usage.ingest_events(load(s, d, "site_events")))


def _entries(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 100, "warn").otherwise("info")
    return e.select(F.col("event_id").alias("id"), "user_id", "ts", F.col("event_type").alias("category"), level.alias("level"), F.col("value").alias("duration"), F.col("event_type").alias("message"))


def _log_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of logs among the documents: (doc_id, site, message)."""
    docs = load(s, d, "documents").where("source = 'scrape_log'")
    lines = docs.select("doc_id", "site", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^\d{2}:\d{2}:\d{2}\.\d{3} \["))
    return lines.select("doc_id", "site", F.regexp_replace("line", r"^\S+ \[\w+\] ", "").alias("message"))


def _stream(s: SparkSession, d: str, table: str, step, name: str) -> DataFrame:
    path = f"{d}/{table}.parquet"
    schema = load(s, d, table).schema
    # a table may be one file or a folder of them
    glob = path if s._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(s._jvm.org.apache.hadoop.fs.Path(path)).isDirectory() else re.sub(r"/[^/]+$", "", path)
    df = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if glob == path else f"{table}.parquet").parquet(glob)
    return stream.run_once(step(df), name)


QUERIES = {
    "ingest_page_views": lambda s, d: usage.ingest_page_views(load(s, d, "page_views")).select("id", "visitor_id", "path", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"), "referrer"),
    "ingest_events": lambda s, d: usage.ingest_events(load(s, d, "site_events")).select("id", "visitor_id", "event_name", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"), "page"),
    "stats_totals": lambda s, d: usage.totals(_views(s, d), _events(s, d)),
    "unique_visitors": lambda s, d: usage.unique_visitors(_views(s, d), _events(s, d)),
    "views_by_path": lambda s, d: usage.views_by_path(_views(s, d)),
    "events_by_name": lambda s, d: usage.events_by_name(_events(s, d)),
    "daily_views": lambda s, d: usage.daily(_views(s, d)),
    "daily_events": lambda s, d: usage.daily(_events(s, d)),
    "recent_visitors": lambda s, d: usage.recent_visitors(_views(s, d), _events(s, d)),
    "avg_views_per_visitor": lambda s, d: usage.views_per_visitor(_views(s, d)),
    "sessions": lambda s, d: usage.sessions(_views(s, d)),
    "trace_summary": lambda s, d: trace.summary(_entries(s, d)),
    "trace_slowest": lambda s, d: trace.slowest(_entries(s, d)),
    "rolling_latency": lambda s, d: trace.rolling_latency(_entries(s, d), "user_id", ["ts", "id"]),
    "collapse_repeats": lambda s, d: trace.repeat_runs(_entries(s, d), "user_id", ["ts", "id"], "category"),
    "feed_fold": lambda s, d: trace.feed(_log_lines(s, d)),
    "stream_daily_views": lambda s, d: _stream(s, d, "page_views", lambda df: stream.daily(df.where("visitor_id is not null and trim(visitor_id) != ''")), "stream_daily_views"),
    "stream_events_by_name": lambda s, d: _stream(s, d, "site_events", stream.by_name, "stream_events_by_name").select("event_name", "total"),
}

_V = """with first as (select *, row_number() over (partition by id order by received_at, visitor_id nulls first, path nulls first, ts, referrer nulls first, user_agent nulls first) as rn from page_views),
v as (select id, visitor_id, '/' || regexp_replace(coalesce(path, ''), '^/+', '') as path, ts, coalesce(referrer, '') as referrer from first where rn = 1 and visitor_id is not null and trim(visitor_id, ' ') <> '')"""
_E = """with first as (select *, row_number() over (partition by id order by received_at, visitor_id nulls first, event_name nulls first, event_data nulls first, ts, page nulls first) as rn from site_events),
e as (select id, visitor_id, case when trim(coalesce(event_name, ''), ' ') = '' then 'unknown' else event_name end as event_name, ts, coalesce(page, '') as page from first where rn = 1 and visitor_id is not null and trim(visitor_id, ' ') <> '')"""
_SINCE = f"epoch_us(ts) >= epoch_us(timestamp '{usage.SINCE}')"
_VS = _V + f", vs as (select * from v where {_SINCE})"
_ES = _E + f", es as (select * from e where {_SINCE})"
_BOTH = _VS + ", " + _E.replace("with first", "efirst").replace("from first", "from efirst") + f", es as (select * from e where {_SINCE})"
_SEEN = "strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d %H:%M:%S')"
_DAY = "strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d')"
_T = "with t as (select event_id as id, user_id, ts, event_type as category, value as duration, case when event_type = 'error' then 'error' when value > 100 then 'warn' else 'info' end as level from events)"

SQL = {
    "ingest_page_views": _V + f" select id, visitor_id, path, {_SEEN} as seen, referrer from v",
    "ingest_events": _E + f" select id, visitor_id, event_name, {_SEEN} as seen, page from e",
    "stats_totals": _BOTH + " select (select count(*) from vs) as total_page_views, (select count(*) from es) as total_events, (select count(distinct visitor_id) from (select visitor_id from vs union select visitor_id from es)) as unique_visitors",
    "unique_visitors": _BOTH + " select count(distinct visitor_id) as unique_visitors from (select visitor_id from vs union select visitor_id from es)",
    "views_by_path": _VS + " select path, count(*) as views from vs group by path",
    "events_by_name": _ES + " select event_name, count(*) as total, count(distinct visitor_id) as unique_visitors from es group by event_name",
    "daily_views": _VS + f" select {_DAY} as day, count(*) as n from vs group by 1",
    "daily_events": _ES + f" select {_DAY} as day, count(*) as n from es group by 1",
    "recent_visitors": _BOTH + " select visitor_id, substr(visitor_id, 1, 16) || '...' as label, strftime(make_timestamp(max(epoch_us(ts))), '%Y-%m-%d %H:%M:%S') as last_seen, count(*) as page_views, coalesce((select count(*) from es where es.visitor_id = vs.visitor_id), 0) as events from vs group by visitor_id order by page_views desc, visitor_id limit 50",
    "avg_views_per_visitor": _VS + " select round(count(*) / count(distinct visitor_id), 6) as avg_views from vs",
    "sessions": _VS + ", g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by visitor_id order by ts) < 1800000000 then 0 else 1 end as new from vs), n as (select *, sum(new) over (partition by visitor_id order by ts rows unbounded preceding) as k from g) select visitor_id, strftime(make_timestamp(min(epoch_us(ts))), '%Y-%m-%d %H:%M:%S') as started, count(*) as views from n group by visitor_id, k",
    "trace_summary": _T + " select category, count(*) as entries, count(*) filter (level = 'warn') as warnings, count(*) filter (level = 'error') as errors, round(sum(duration), 2) as seconds from t group by category",
    "trace_slowest": _T + " select category || ': ' || category as what, round(sum(duration), 2) as seconds from t group by 1 order by seconds desc, what limit 15",
    "rolling_latency": _T + " select id, round(sum(duration) over w, 2) as seconds, count(*) over w as calls from t window w as (partition by user_id order by ts, id rows between 9 preceding and current row)",
    "collapse_repeats": _T + ", g as (select *, row_number() over (partition by user_id order by ts, id) - row_number() over (partition by user_id, category order by ts, id) as k from t) select user_id, category, min(id) as started, count(*) as n from g group by user_id, category, k",
    "feed_fold": """with l as (select site, unnest(string_split(text, chr(10))) as line from documents where source = 'scrape_log'),
m as (select site, lower(regexp_replace(line, '^[^ ]+ \\[[a-z]+\\] ', '')) as m from l where regexp_matches(line, '^[0-9]{2}:[0-9]{2}:[0-9]{2}\\.[0-9]{3} \\['))
select site, coalesce(max(try_cast(regexp_extract(m, '([0-9]+)\\s+(?:members|cards|records)', 1) as bigint)), 0) as records, max(case when contains(m, 'enriched') then 1 else 0 end) as done,
max(case when contains(m, 'enriched') then 3 when contains(m, 'filter') then 2 when contains(m, 'loaded') then 1 else 0 end) as phase from m group by site""",
    "stream_daily_views": f"select {_DAY} as day, count(*) as n from page_views where visitor_id is not null and trim(visitor_id, ' ') <> '' group by 1",
    "stream_events_by_name": "select case when trim(coalesce(event_name, ''), ' ') = '' then 'unknown' else event_name end as event_name, count(*) as total from site_events group by 1",
}
