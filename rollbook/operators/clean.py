"""Cleaning and first-wins deduplication of records, for businesses, persons and free-form schemas.

The first record of a key wins. ``min_by`` over the sequence keeps that in one partial aggregate: no
window sorts a hot key's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import rules
from rollbook.functions import text as t


def clean_contacts(c: Column) -> Column:
    """Contacts with a name or address; the first of each address, every address-less name."""
    tidy = F.transform(F.coalesce(c, F.array().cast("array<struct<name:string,email:string>>")), lambda x: F.struct(t.null_if_empty(t.ws(x["name"])).alias("name"), t.null_if_empty(F.regexp_replace(F.lower(x["email"]), r"(?U)^\s+|\s+$", "")).alias("email")))
    some = F.filter(tidy, lambda x: x["name"].isNotNull() | x["email"].isNotNull())
    seen = lambda i: F.exists(F.slice(some, 1, i), lambda y: y["email"] == F.element_at(some, i + 1)["email"])
    return F.filter(some, lambda x, i: x["email"].isNull() | ~F.coalesce(F.when(i > 0, seen(F.greatest(i, F.lit(1)))), F.lit(False)))


def joined(contacts: Column, field: str) -> Column:
    return F.array_join(F.transform(contacts, lambda x: F.coalesce(x[field], F.lit("-"))), "; ")


def named(members: DataFrame) -> DataFrame:
    """Records whose name is a name: not empty, no label, no navigation text."""
    n = t.ws(F.col("company_name"))
    return members.withColumn("company_name", n).where(t.filled(n) & ~t.is_label(n) & ~t.is_false_name(n))


def clean_business(members: DataFrame) -> DataFrame:
    """(member_id, company_name, phone, fax, website, category, street_address, mailing_address, contacts)."""
    m = named(members).withColumn("k", t.name_key(F.col("company_name"))).where("k != ''")
    d = t.digits(F.col("phone"))
    m = m.withColumn("k", F.when(d != "", F.concat("k", F.lit("|"), d)).otherwise(F.col("k")))
    cols = ["member_id", "company_name", "phone", "fax", "website", "category", "street_address", "mailing_address", "contacts"]
    first = m.groupBy("k").agg(F.min_by(F.struct(*cols), "member_id").alias("r")).select("r.*")
    street, mail = (F.regexp_replace(c, r"(?U)^\s+|\s+$", "") for c in ("street_address", "mailing_address"))
    same = (F.col("street_address") != "") & (F.col("mailing_address") != "") & (street == mail)
    return first.select(
        "member_id", "company_name", t.phone_format(F.col("phone")).alias("phone"), t.phone_format(F.col("fax")).alias("fax"),
        t.website_normalize(F.col("website")).alias("website"), t.category_text(F.col("category")).alias("category"),
        "street_address", F.when(~F.coalesce(same, F.lit(False)), F.col("mailing_address")).alias("mailing_address"), clean_contacts(F.col("contacts")).alias("contacts"),
    )


def prune_shared_emails(cleaned: DataFrame, group: str | None = None) -> DataFrame:
    """Blank addresses that at least five records and a fifth of all share; drop contacts left with nothing.

    Thresholds are per ``group`` if one is given. Poisoned addresses are few: each covers a fifth of its
    group, so a group has at most five per contact position of a record.
    """
    base = cleaned.withColumn("_g", F.col(group) if group else F.lit(""))
    total = base.groupBy("_g").agg(F.count("*").alias("_n"))
    each = base.select("_g", "member_id", F.explode(F.array_distinct(F.transform("contacts", lambda x: x["email"]))).alias("e")).where("e is not null")
    bad = each.groupBy("_g", "e").agg(F.count("*").alias("k")).join(total, "_g").where((F.col("k") >= rules.SHARED_EMAIL_RECORDS) & (F.col("k") / F.col("_n") >= rules.SHARED_EMAIL_SHARE))
    bad = bad.groupBy("_g").agg(F.collect_set("e").alias("bad"))
    poisoned = lambda x: F.coalesce(F.array_contains("bad", x["email"]), F.lit(False))
    kept = F.filter("contacts", lambda x: ~(poisoned(x) & x["name"].isNull()))
    blanked = F.transform(kept, lambda x: F.struct(x["name"].alias("name"), F.when(~poisoned(x), x["email"]).alias("email")))
    return base.join(bad, "_g", "left").withColumn("contacts", F.when(F.col("bad").isNull(), F.col("contacts")).otherwise(blanked)).drop("bad", "_g")


def clean_person(people: DataFrame) -> DataFrame:
    """(seq, full_name, email, phone, title) from the same columns: no mail or web address as name, first of name and mail."""
    n = t.ws(F.regexp_replace("full_name", r"(?i)\(\s*link\s+(?:sends\s+e-?mail|is\s+external)\s*\)|\(\s*opens\s+in\s+(?:a\s+)?new\s+(?:tab|window)\s*\)", " "))
    p = people.withColumn("full_name", n).where(t.filled(n) & ~t.is_label(n))
    p = p.where(~F.col("full_name").rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$") & ~F.lower("full_name").rlike(r"^(?:https?://|www\.)"))
    p = p.withColumn("email", t.person_email(F.col("email"))).withColumn("k", t.name_key(F.col("full_name"))).where("k != ''")
    first = p.groupBy("k", F.coalesce("email", F.lit("")).alias("e")).agg(F.min_by(F.struct("seq", "full_name", "email", "phone", "title"), "seq").alias("r")).select("r.*")
    return first.select("seq", "full_name", "email", t.phone_format(F.col("phone")).alias("phone"), t.null_if_empty(t.ws(F.col("title"))).alias("title"))


def clean_dynamic(rows: DataFrame, name: str, roles: dict[str, str]) -> DataFrame:
    """First record of each name; fields normalised by role (phone, url, email), others as they are. Needs ``seq``."""
    n = t.ws(F.col(name))
    r = rows.withColumn(name, n).where(t.filled(n)).withColumn("k", t.name_key(n)).where("k != ''")
    cols = rows.columns
    r = r.groupBy("k").agg(F.min_by(F.struct(*cols), "seq").alias("r")).select("r.*")
    for c, role in roles.items():
        v = F.col(c)
        if role == "phone":
            d = t.digits(v)
            r = r.withColumn(c, F.when((F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1")), t.phone_format(v)).otherwise(v))
        elif role == "url":
            r = r.withColumn(c, F.when(~v.startswith("http") & v.rlike(r"(?U)^[\w.-]+\.[a-z]{2,}"), F.concat(F.lit("https://"), v)).otherwise(v))
        elif role == "email":
            r = r.withColumn(c, F.lower(F.trim(v)))
    return r


def has_contact(prefix: str = "") -> Column:
    """A phone, website, address or mailbox."""
    f = lambda c: t.filled(F.col(prefix + c))
    return f("phone") | f("website") | f("street_address") | f("mailing_address") | F.coalesce(F.exists(prefix + "contacts", lambda x: F.coalesce(x["email"] != "", F.lit(False))), F.lit(False))


def _avg(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("int"))


def garbage_gate(members: DataFrame) -> DataFrame:
    """(source_url, records, garbage): hardly any contact data, or mostly navigation text for names."""
    g = members.groupBy("source_url").agg(F.count("*").alias("records"), _avg(has_contact()).alias("c"), _avg(t.is_false_name(F.col("company_name"))).alias("f"))
    return g.select("source_url", "records", ((F.col("c") < 0.05) | (F.col("f") > 0.3)).alias("garbage"))


def garbage_gate_dynamic(rows: DataFrame, group: str, name: str, others: list[str]) -> DataFrame:
    """(group, records, garbage): fewer than 30 % have an identity and another filled field that is no address of a page."""
    extra = F.lit(False)
    for c in others:
        extra = extra | t.filled(F.col(c).cast("string"))
    g = rows.groupBy(group).agg(F.count("*").alias("records"), _avg(t.filled(F.col(name)) & extra).alias("good"))
    return g.select(group, "records", (F.col("good") < 0.3).alias("garbage"))


SCALARS = ["company_name", "phone", "website", "street_address", "category"]


def extraction_valid(members: DataFrame) -> DataFrame:
    """(source_url, records, valid): names nearly everywhere, or under 70 % of five fields empty."""
    nulls = sum((~F.coalesce(t.filled(F.col(c)), F.lit(False))).cast("int") for c in SCALARS)
    g = members.groupBy("source_url").agg(F.count("*").alias("n"), F.sum(t.filled(F.col("company_name")).cast("int")).alias("named"), F.sum(nulls).alias("nulls"))
    enough = F.coalesce("named", F.lit(0)) >= F.greatest(F.lit(3), F.floor(F.col("n") * 0.8))
    return g.select("source_url", F.col("n").alias("records"), (enough | (F.col("nulls") / (F.col("n") * len(SCALARS)) < rules.NULL_RATIO)).alias("valid"))


def count_gate(counts: DataFrame) -> DataFrame:
    """(source_url, expected, extracted) of the sources that yielded too little; from (source_url, cleaned, expected, observed)."""
    e, c = F.col("expected"), F.col("cleaned")
    sane = (e > 0) & (c >= 3) & (e <= rules.COUNT_GATE_CLAMP * F.greatest("observed", "cleaned"))
    return counts.where(sane & (c < rules.COUNT_GATE_RATIO * e)).select("source_url", e.alias("expected"), c.alias("extracted"))


def name_only(members: DataFrame) -> DataFrame:
    """(source_url, name_only, shallow): share of records with a name and no contact data."""
    f = lambda c: F.coalesce(t.filled(F.col(c)), F.lit(False))
    who = F.coalesce(F.exists("contacts", lambda x: F.coalesce(x["email"] != "", F.lit(False)) | F.coalesce(x["name"] != "", F.lit(False))), F.lit(False))
    only = f("company_name") & ~(f("phone") | f("street_address") | f("mailing_address") | who)
    g = members.groupBy("source_url").agg(F.round(F.avg(only.cast("int")), 6).alias("name_only"))
    return g.withColumn("shallow", F.col("name_only") >= rules.NAME_ONLY_TRIGGER)


def location_filter(members: DataFrame, states: list[str]) -> DataFrame:
    """Records whose address names other states only are dropped; all others stay."""
    addr = F.trim(F.concat_ws(" ", F.coalesce("street_address", F.lit("")), F.coalesce("mailing_address", F.lit(""))))
    known = F.array(*[F.lit(s) for s in rules.STATES])
    zipped = F.array_intersect(F.regexp_extract_all(addr, F.lit(r"\b([A-Z]{2})\s+\d{5}(?:-\d{4})?\b"), F.lit(1)), known)
    last = F.array_intersect(F.array(F.regexp_extract(addr, r",\s*([A-Z]{2})\s*$", 1)), known)
    found = F.when(F.size(zipped) > 0, zipped).otherwise(last)
    return members.where((F.size(found) == 0) | F.arrays_overlap(found, F.array(*[F.lit(s) for s in states])))


def coverage(members: DataFrame) -> DataFrame:
    """One row: how many records carry each kind of field."""
    f = lambda c: F.coalesce(t.filled(F.col(c)), F.lit(False))
    mail = F.coalesce(F.exists("contacts", lambda x: F.coalesce(x["email"] != "", F.lit(False))), F.lit(False))
    who = mail | F.coalesce(F.exists("contacts", lambda x: F.coalesce(x["name"] != "", F.lit(False))), F.lit(False))
    social = F.coalesce(F.exists(F.map_values("social_media"), lambda v: F.coalesce(v != "", F.lit(False))), F.lit(False))
    return members.agg(
        F.count("*").alias("total_members"), *[F.count_if(c).alias(n) for n, c in (
            ("with_name", f("company_name")), ("with_phone", f("phone")), ("with_email", mail), ("with_website", f("website")),
            ("with_address", f("street_address") | f("mailing_address")), ("with_description", f("description")), ("with_category", f("category")),
            ("with_contacts", who), ("with_social", social),
        )]
    )


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled) for any schema."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(t.filled(F.col(c).cast("string")), F.lit(False)).cast("bigint").alias("n")) for c in fields])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.field").agg(F.sum("p.n").alias("filled"))


def sparse_fields(captured: DataFrame, present: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, field): fields that many cards show but few records captured."""
    n = lambda c: F.count_if(F.coalesce(t.filled(F.col(c)), F.lit(False)))
    a = captured.groupBy(group).agg(*[n(c).alias(c) for c in fields])
    b = present.groupBy(group).agg(F.count("*").alias("cards"), *[n(c).alias(f"p_{c}") for c in fields])
    j = a.join(b, group)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("got"), F.col(f"p_{c}").alias("seen")) for c in fields])
    x = j.select(group, "cards", F.explode(rows).alias("r")).select(group, "cards", "r.*")
    return x.where((F.col("seen") >= F.greatest(F.lit(3), 0.2 * F.col("cards"))) & (F.col("got") < 0.5 * F.col("seen"))).select(group, "field")


def field_presence(members: DataFrame, fields: list[str], first: int = 20) -> DataFrame:
    """(source_url, field, present): at least half of a source's first records carry the field."""
    w = Window.partitionBy("source_url").orderBy("member_id")
    head = members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first)
    n = head.groupBy("source_url").agg(*[F.avg(F.coalesce(t.filled(F.col(c)), F.lit(False)).cast("int")).alias(c) for c in fields])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), (F.col(c) >= 0.5).alias("present")) for c in fields])
    return n.select("source_url", F.explode(rows).alias("r")).select("source_url", "r.field", "r.present")
