"""Captured responses and dump files: which are records, which must never be kept, and reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import rules

# Words in a path, and fragments of a query or body, that mark credentials.
AUTH_WORDS = [
    "login", "logon", "signin", "signon", "signup", "auth", "oauth", "authenticate", "authentication", "token", "tokens", "password", "passwords", "passwd",
    "credential", "credentials", "sso", "saml",
]
CREDENTIAL = r"(?i)password|passwd|(?<![a-z0-9])pwd(?![a-z0-9])|secret(?!ar)|api_?key|private_?key|access_token|refresh_token|id_token|client_assertion|(?<![a-z0-9])bearer(?![a-z0-9])|(?<![a-z0-9])t?otp(?![a-z0-9])|(?<![a-z0-9])mfa(?![a-z0-9])"


def credential_shaped(url: Column, body: Column) -> Column:
    """A request that must not be kept; what cannot be told apart counts as one."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(path, r"[^A-Za-z]+", " "), r"(?<=[a-z])(?=[A-Z])", " ")), " ")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    hit = F.arrays_overlap(words, F.array(*[F.lit(w) for w in AUTH_WORDS])) | query.rlike(CREDENTIAL) | F.coalesce(body.rlike(CREDENTIAL), F.lit(False))
    return F.coalesce(hit, F.lit(True))


def dump_members(dumps: DataFrame) -> DataFrame:
    """(dump_id, pos, record): the members of a wrapped dump or a bare list, as JSON text; anything else has none."""
    body = F.regexp_replace("body", r"^[\ufeff\s]+", "")
    f = dumps.select("dump_id", F.try_parse_json(body).alias("v")).where("v is not null")
    return dumps.sparkSession.sql(
        "select f.dump_id, cast(m.pos as int) as pos, to_json(m.value) as record from {f} f, "
        "lateral variant_explode(case when schema_of_variant(f.v) like 'ARRAY%' then f.v else try_variant_get(f.v, '$.members', 'variant') end) m",
        f=f,
    )


def dump_metadata(dumps: DataFrame) -> DataFrame:
    """(dump_id, source_url, total_members, partial); nulls for bare lists."""
    body = F.regexp_replace("body", r"^[\ufeff\s]+", "")
    get = lambda path, kind: F.get_json_object(body, f"$.metadata.{path}").cast(kind)
    return dumps.select("dump_id", get("source_url", "string").alias("meta_source"), get("total_members", "bigint").alias("total_members"), F.coalesce(get("partial", "boolean"), F.lit(False)).alias("partial"))


def resolve_aliases(records: DataFrame) -> DataFrame:
    """(dump_id, pos, fields of the record schema): JSON keys of any case mapped in order of preference.

    The first alias with a value that is no list or object decides, even if it is empty.
    """
    low = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(F.from_json("record", "map<string,string>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    r = records.select("dump_id", "pos", low.alias("m"))
    scalar = lambda k: F.when(~F.element_at("m", k).rlike(r"^\s*[\[{]"), F.trim(F.element_at("m", k)))
    out = [F.nullif(F.coalesce(*[scalar(F.lit(k)) for k in keys]), F.lit("")).alias(f) for f, keys in rules.FIELD_ALIASES.items()]
    return r.select("dump_id", "pos", *out)


def member_lists(records: DataFrame) -> DataFrame:
    """(dump_id, n, member_list): at least three records, half of the first five named, five keys on average."""
    keys = F.transform(F.map_keys(F.from_json("record", "map<string,string>")), lambda k: F.lower(k))
    r = records.select("dump_id", "pos", F.size(keys).alias("k"), F.arrays_overlap(keys, F.array(*[F.lit(k) for k in rules.NAME_KEYS])).cast("int").alias("named"))
    first = F.col("pos") < 5
    g = r.groupBy("dump_id").agg(F.count("*").alias("n"), F.avg(F.when(first, F.col("named"))).alias("named"), F.avg(F.when(first, F.col("k"))).alias("k"))
    return g.select("dump_id", "n", ((F.col("n") >= 3) & (F.col("named") >= 0.5) & (F.col("k") >= 5)).alias("member_list"))
