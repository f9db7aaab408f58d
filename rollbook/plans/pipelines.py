"""Whole runs: pages to structured records, records to an enriched export, search hits to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import text as t
from rollbook.operators import clean, discovery, merge, pages

COLUMNS = ["company_name", "phone", "street_address"]


def parse_pages(captured: DataFrame, card: str, fields: dict[str, str]) -> DataFrame:
    """(page_id, pos, tier, COLUMNS): each page's records from its best tier.

    Embedded JSON counts if it holds at least three entities and 0.8 of the cards; then a named table;
    then the learned layout. Later tiers only read the pages that earlier ones left, so the costly
    matching of selectors sees fewer pages.
    """
    structural = pages.repeated_records(captured)
    ld = pages.apply_jsonld(captured).select("page_id", "pos", *COLUMNS)
    n = ld.groupBy("page_id").agg(F.count("*").alias("n")).join(structural, "page_id")
    good = n.where((F.col("n") >= 3) & (F.col("n") >= 0.8 * F.col("records"))).select("page_id")
    first = ld.join(good, "page_id", "left_semi").withColumn("tier", F.lit("jsonld"))
    rest = captured.join(good, "page_id", "left_anti")
    table = pages.apply_headers(rest, COLUMNS)
    named = table.groupBy("page_id").agg(F.count_if(t.filled(F.col("company_name"))).alias("n")).where("n >= 3").select("page_id")
    second = table.join(named, "page_id", "left_semi").withColumn("tier", F.lit("table"))
    last = pages.apply_layout(rest.join(named, "page_id", "left_anti"), card, fields).withColumn("tier", F.lit("layout"))
    return first.unionByName(second).unionByName(last)


def structured(members: DataFrame, expected: DataFrame) -> DataFrame:
    """(source_url, records, cleaned, garbage, partial): the gates of a run, per source, before the export.

    ``expected`` has (source_url, expected_count). A source whose names or contacts are mostly junk is
    garbage; one that yielded far less than its site states is partial.
    """
    kept = clean.clean_business(members).select("member_id")
    per = members.select("source_url", "member_id").join(kept.withColumn("ok", F.lit(1)), "member_id", "left").groupBy("source_url").agg(F.count("*").alias("observed"), F.coalesce(F.sum("ok"), F.lit(0)).alias("cleaned"))
    gates = clean.garbage_gate(members).select("source_url", "garbage")
    counts = per.join(expected.select("source_url", F.col("expected_count").alias("expected")), "source_url", "left")
    partial = clean.count_gate(counts).select("source_url", F.lit(True).alias("partial"))
    return per.join(gates, "source_url").join(partial, "source_url", "left").select("source_url", F.col("observed").alias("records"), "cleaned", "garbage", F.coalesce("partial", F.lit(False)).alias("partial"))


def export(members: DataFrame, gates: DataFrame) -> DataFrame:
    """The final dataset: records of sources that are no garbage, consolidated and in order of names."""
    good = gates.where("not garbage").select("source_url")
    return merge.final_order(merge.consolidate(members.join(good, "source_url", "left_semi"))).drop("sort_key")


def discover(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(url, rank, reason): candidates of a search with the verdict on their page; texts have (url, text, js_shell, contact)."""
    c = discovery.dedup_cap(hits)
    page = texts.select("url", discovery.verdict(F.col("text"), F.col("js_shell"), F.col("contact")).alias("reason"))
    return c.join(page, "url", "left").select("url", "rank", F.coalesce("reason", F.lit("fetch_failed")).alias("reason"))


def enrich(members: DataFrame, registry: DataFrame, vertical: str, states: list[str]) -> DataFrame:
    """(member_id, phone, fax, status): records of one vertical and region, gaps filled from a registry by name and state."""
    near = clean.location_filter(members, states)
    m = near.withColumn("state", t.state_of(F.col("street_address"))).withColumn("k", F.concat_ws("|", t.name_key(F.col("company_name")), "state"))
    r = registry.withColumn("k", F.concat_ws("|", t.name_key(F.col("company_name")), t.state_of(F.col("street_address")))).groupBy("k").agg(F.min_by(F.struct("phone", "fax"), "npi").alias("r"))
    j = m.join(r, "k", "left")
    filled = lambda c: F.coalesce(t.null_if_empty(F.col(c)), F.col(f"r.{c}"))
    got = F.col("r").isNotNull() & ~(t.filled(F.col("phone")) & t.filled(F.col("fax")))
    return j.select("member_id", F.lit(vertical).alias("vertical"), filled("phone").alias("phone"), filled("fax").alias("fax"), F.when(F.coalesce(got, F.lit(False)), "enriched").otherwise("complete").alias("status"))
