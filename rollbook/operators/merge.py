"""Merging records of several sources: consolidation, gap filling, reconciliation, page merges, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import text as t
from rollbook.work import cut

FIELDS = ["company_name", "category", "description", "phone", "fax", "website", "street_address", "mailing_address", "hours", "founded", "source_url"]
PLATFORMS = ["facebook", "linkedin", "instagram", "twitter", "youtube", "yelp", "pinterest", "tiktok"]


def first_filled(c: str, order: Column) -> Column:
    """The value of the first record that has one."""
    return F.min_by(F.when(t.filled(F.col(c)), F.col(c)), F.when(t.filled(F.col(c)), order))


def merge_key(members: DataFrame) -> DataFrame:
    """Adds ``k``: the name; for the nameless a phone, website or first mailbox; null where there is none."""
    name = t.export_key(F.col("company_name"))
    other = F.coalesce(t.null_if_empty(F.col("phone")), t.null_if_empty(F.col("website")), F.get(F.col("contacts"), F.lit(0))["email"])
    return members.withColumn("k", F.when(name != "", name).otherwise(F.concat(F.lit("~anon~"), t.export_key(F.when(other != "", other)))).cast("string")).withColumn(
        "k", F.when((name == "") & ~F.coalesce(other != "", F.lit(False)), None).otherwise(F.col("k"))
    )


def merged_contacts(seqs: Column) -> Column:
    """All contacts of a group in order, each (name, address) once, blanks collapsed."""
    flat = F.flatten(F.transform(F.array_sort(seqs), lambda x: F.coalesce(x["c"], F.array().cast("array<struct<name:string,email:string>>"))))
    tidy = F.transform(flat, lambda x: F.struct(t.null_if_empty(t.ws(x["name"])).alias("name"), t.null_if_empty(t.ws(x["email"])).alias("email")))
    some = F.filter(tidy, lambda x: x["name"].isNotNull() | x["email"].isNotNull())
    keys = F.transform(some, lambda x: F.concat(F.lower(F.coalesce(x["name"], F.lit(""))), F.lit("|"), F.lower(F.coalesce(x["email"], F.lit("")))))
    return F.filter(some, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)


def consolidate(members: DataFrame, order: str = "member_id") -> DataFrame:
    """One record per key: every field from the first record that fills it, lists united in order.

    Aggregates are partial per field, so a key with many rows is reduced before the shuffle; only the
    contacts of a key come together, as they must for the union.
    """
    m = merge_key(members).where("k is not null")
    seq = F.col(order)
    g = m.groupBy("k").agg(
        F.min(order).alias("first_id"), F.count("*").alias("rows"), *[first_filled(c, seq).alias(c) for c in FIELDS],
        F.collect_list(F.struct(seq.alias("s"), F.col("contacts").alias("c"))).alias("cs"),
    )
    tidy = [t.null_if_empty(t.ws(F.col(c))).alias(c) for c in FIELDS]
    return g.select("k", "first_id", "rows", *tidy, merged_contacts(F.col("cs")).alias("contacts"))


def export_metadata(members: DataFrame) -> DataFrame:
    """One row: records in, dropped without identity, merged as duplicates, left."""
    m = merge_key(members).agg(F.count("*").alias("records"), F.count_if(F.col("k").isNull()).alias("dropped_empty"), F.countDistinct("k").alias("total"))
    return m.select("records", "dropped_empty", (F.col("records") - F.col("dropped_empty") - F.col("total")).alias("duplicates_merged"), "total")


def final_order(merged: DataFrame, top: int | None = None) -> DataFrame:
    """The export in order, whole or its ``top`` first records: by name key in code-point order, the nameless at ``~``."""
    key = F.when(t.export_key(F.col("company_name")) == "", "~").otherwise(t.export_key(F.col("company_name")))
    ordered = merged.withColumn("sort_key", key).orderBy("sort_key", "first_id")
    return ordered if top is None else ordered.limit(top)


def positions(ordered: DataFrame) -> DataFrame:
    """Adds ``position``, from 1, to a sorted table. The driver sees one count per partition, no rows."""
    at = cut(ordered.withColumn("_at", F.monotonically_increasing_id()), "export-order")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for k, n in sizes:
        rows.append((k, before))
        before += n
    starts = ordered.sparkSession.createDataFrame(rows, "part long, before long")
    return at.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("position", F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", "_at")


def flatten_record(members: DataFrame) -> DataFrame:
    """One level of columns for tables: lists joined, platforms as columns, nulls as empty strings."""
    s = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    who = lambda f: F.coalesce(F.array_join(F.transform(F.filter("contacts", lambda x: F.coalesce(x[f] != "", F.lit(False))), lambda x: x[f]), "; "), F.lit(""))
    team = F.array_join(F.transform("team", lambda x: F.when(F.coalesce(x["title"] != "", F.lit(False)), F.concat(F.coalesce(x["name"], F.lit("")), F.lit(" ("), x["title"], F.lit(")"))).otherwise(F.coalesce(x["name"], F.lit("")))), "; ")
    return members.select(
        "member_id", *[s(c).alias(c) for c in ("company_name", "category", "website", "phone", "fax")], who("name").alias("contact_name"), who("email").alias("contact_email"),
        *[F.coalesce(F.element_at("social_media", p), F.lit("")).alias(p) for p in PLATFORMS],
        F.coalesce(F.array_join("services", ", "), F.lit("")).alias("services"), F.coalesce(team, F.lit("")).alias("team"), s("founded").alias("founded"),
    )


def used_columns(flat: DataFrame) -> DataFrame:
    """(column, rows): the columns that carry data, with their number of filled rows."""
    cols = [c for c in flat.columns if c != "member_id"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) != "").cast("bigint").alias("n")) for c in cols])
    return flat.select(F.explode(pairs).alias("p")).groupBy("p.column").agg(F.sum("p.n").alias("rows")).where("rows > 0")


def listing_minus_detail(listing: DataFrame, detail: DataFrame) -> DataFrame:
    """Listing rows (id, key) that no detail key equals or extends.

    A detail key of eight or more characters also covers a listing key that it begins with, or that
    begins with it. Prefixes become equal keys: listing keys meet detail keys under the first eight
    characters, and listing keys shorter than that under each prefix of a detail key. No cross join.
    """
    dk = detail.select("key").where("key != ''").distinct()
    equal = listing.join(dk, "key", "left_semi").select("id")
    long = dk.where(F.length("key") >= 8)
    eight = long.select(F.substring("key", 1, 8).alias("p"), F.col("key").alias("d"))
    l8 = listing.where(F.length("key") >= 8).withColumn("p", F.substring("key", 1, 8))
    both = l8.join(eight, "p").where(F.col("key").startswith(F.col("d")) | F.col("d").startswith(F.col("key"))).select("id")
    short = long.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("key")).distinct()
    few = listing.where((F.length("key") < 8) & (F.col("key") != "")).join(short, "key", "left_semi").select("id")
    return listing.join(equal.union(both).union(few).distinct(), "id", "left_anti")


def positional_merge(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """Full outer join on position; the left value unless it is empty. Both have (page, pos, fields)."""
    r = right.select("page", "pos", *[F.col(c).alias(f"r_{c}") for c in fields])
    return left.join(r, ["page", "pos"], "full").select("page", "pos", *[F.coalesce(t.null_if_empty(F.col(c)), F.col(f"r_{c}")).alias(c) for c in fields])


def gap_fill(members: DataFrame, extra: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left join; ``extra`` (unique on the key) fills empty fields only."""
    e = extra.select(key, *[F.col(c).alias(f"e_{c}") for c in fields])
    return members.join(e, key, "left").select("member_id", *[F.coalesce(t.null_if_empty(F.col(c)), F.col(f"e_{c}")).alias(c) for c in fields])


def enrichment_status(members: DataFrame) -> DataFrame:
    """(member_id, status): what enrichment would do with each record."""
    f = lambda c: F.coalesce(t.filled(F.col(c)), F.lit(False))
    mail = F.coalesce(F.exists("contacts", lambda x: F.coalesce(x["email"] != "", F.lit(False))), F.lit(False))
    site = F.trim(F.coalesce("website", F.lit("")))
    status = (
        F.when((F.length(site) > 0) & f("description") & f("phone") & mail, "skipped")
        .when((F.length(site) < 4) | site.startswith("/"), "no_website")
        .when(t.website_normalize(site).isNull(), "failed")
        .otherwise("enriched")
    )
    return members.select("member_id", status.alias("status"))


def merge_pages(pages: DataFrame) -> DataFrame:
    """Pages of one site in order -> one record: later fax and address win, the longest description, first hours and year.

    Every rule is a partial aggregate over (site, pos).
    """
    pos = F.col("pos")
    last = lambda c: F.max_by(F.when(t.filled(F.col(c)), F.col(c)), F.when(t.filled(F.col(c)), pos))
    longest = F.max_by("description", F.when(t.filled(F.col("description")), F.struct(F.length("description").alias("n"), F.negative(pos).alias("p"))))
    return pages.groupBy("site").agg(last("fax").alias("fax"), last("address").alias("address"), longest.alias("description"), first_filled("hours", pos).alias("hours"), first_filled("founded", pos).alias("founded"))


def backfill_website(original: DataFrame, found: DataFrame) -> DataFrame:
    """Websites found for records without one, by record id."""
    f = found.select("member_id", F.col("website").alias("f"))
    return original.join(f, "member_id", "left").select("member_id", F.coalesce(t.null_if_empty(F.trim("website")), F.col("f")).alias("website"))


def latest_layouts(layouts: DataFrame, keep: int = 4) -> DataFrame:
    """(domain, fingerprint, rank): the newest layouts of each domain, the newest of a fingerprint only; rank 1 is primary."""
    new = layouts.groupBy("domain", "fingerprint").agg(F.max("learned_at").alias("learned_at"))
    r = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("learned_at"), "fingerprint"))
    return new.withColumn("rank", r).where(F.col("rank") <= keep).select("domain", "fingerprint", "rank")
