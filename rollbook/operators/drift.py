"""Schemas that drift between files: one consistent table, and a report of every change.

Tagged-union inference. Each file's parallel record schemas are fused per path; a path keeps the
*set* of JSON types that occur on it instead of widening to one. A canonical field is the union of
the paths that its aliases name; a value goes to the branch of its own type (``_text``, ``_number``,
``_list``, ``_object``, ``_flag``) and to one canonical string. A file is compared with the file
before it of the same source: alternatives that appear, disappear or change are reported.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Keys of dump files by canonical field, lower case, without separators.
ALIASES = {
    "category": ("category", "categories", "catname", "listingtype", "industry", "trade", "businesscategory"),
    "entity_type": ("entitytype", "kind", "recordtype"),
    "name_field": ("namefield", "namecolumn", "identitykey", "namekey"),
}
PLACE = {"category": "members", "entity_type": "metadata", "name_field": "metadata"}


def _canonical(place: Column, key: Column) -> Column:
    bare = F.lower(F.regexp_replace(key, "[-_ .]", ""))
    out = F.lit(None).cast("string")
    for name, keys in ALIASES.items():
        out = F.when((place == PLACE[name]) & bare.isin(*keys), F.lit(name)).otherwise(out)
    return out


def _kind(schema: Column) -> Column:
    """JSON type of a variant's schema string; null for JSON null."""
    return (
        F.when(schema == "VOID", None)
        .when(schema.startswith("ARRAY"), "list")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema == "STRING", "text")
        .when(schema == "BOOLEAN", "flag")
        .otherwise("number")
    )


@pandas_udf(T.StringType())
def _lenient(body: pd.Series) -> pd.Series:
    """Bodies that strict JSON rejects (NaN, repeated keys, control characters), rewritten; null if hopeless."""

    def one(b: str | None) -> str | None:
        try:
            return json.dumps(json.loads(b, strict=False, parse_constant=lambda _: None))
        except (TypeError, ValueError):
            return None

    return body.map(one)


def parsed(dumps: DataFrame) -> DataFrame:
    """One row per ``dump_id`` with the body as a variant; a file delivered again counts once (the first delivery)."""
    one = dumps.groupBy("dump_id").agg(F.min_by(F.struct("source_url", "scraped_at", "body"), F.struct("received_at", "body")).alias("d"))
    body = F.regexp_replace("d.body", r"^[\ufeff\s]+", "")
    v = F.try_parse_json(body)
    got = one.select("dump_id", "d.source_url", "d.scraped_at", body.alias("body"), v.alias("v"))
    return got.withColumn("v", F.when(F.col("v").isNotNull() | F.col("body").isNull(), F.col("v")).otherwise(F.try_parse_json(_lenient(F.when(F.col("v").isNull(), F.col("body")))))).drop("body")


def _entries(files: DataFrame) -> DataFrame:
    """(dump_id, place, rec, key, value): every key of the metadata and of each record."""
    spark = files.sparkSession
    meta = spark.sql(
        "select f.dump_id, 'metadata' as place, 0 as rec, e.key, e.value from {f} f, "
        "lateral variant_explode(case when schema_of_variant(f.v) like 'OBJECT%' then try_variant_get(f.v, '$.metadata', 'variant') end) e where e.key is not null",
        f=files,
    )
    recs = spark.sql(
        "select r.dump_id, 'members' as place, r.pos as rec, e.key, e.value from (select f.dump_id, m.pos, m.value from {f} f, "
        "lateral variant_explode(case when schema_of_variant(f.v) like 'ARRAY%' then f.v else try_variant_get(f.v, '$.members', 'variant') end) m) r, "
        "lateral variant_explode(r.value) e where e.key is not null",
        f=files,
    )
    return meta.unionByName(recs).withColumn("field", _canonical(F.col("place"), F.col("key"))).where("field is not null")


def unified(dumps: DataFrame) -> DataFrame:
    """One consistent table: a row per record and canonical field, with typed branches and a canonical string.

    Objects give their ``name``, ``type`` or ``key`` member as canonical string, lists their elements
    joined by ``; ``. JSON null gives nulls in all branches. Files without records give no rows.
    """
    e = _entries(parsed(dumps))
    schema = F.expr("schema_of_variant(value)")
    text = F.expr("try_variant_get(value, '$', 'string')")
    inner = F.coalesce(*[F.expr(f"try_variant_get(value, '$.{k}', 'string')") for k in ("name", "type", "key", "label", "value")])
    return e.withColumn("json_type", _kind(schema)).select(
        "dump_id", "rec", "field", F.col("key").alias("source_key"), "json_type",
        F.when(F.col("json_type") == "text", text).alias("as_text"),
        F.when(F.col("json_type") == "number", F.expr("try_variant_get(value, '$', 'double')")).alias("as_number"),
        F.when(F.col("json_type") == "flag", F.expr("try_variant_get(value, '$', 'boolean')")).alias("as_flag"),
        F.when(F.col("json_type") == "list", F.expr("try_variant_get(value, '$', 'array<string>')")).alias("as_list"),
        F.when(F.col("json_type") == "object", F.to_json("value")).alias("as_object"),
        F.when(F.col("json_type") == "object", inner).when(F.col("json_type") == "list", F.array_join(F.expr("try_variant_get(value, '$', 'array<string>')"), "; ")).otherwise(text).alias("canonical"),
    )


def _before(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """Adds ``prev``, the struct of ``cols`` of the row before it, without one task per key.

    Rows of a key are ordered inside months; the first row of a month takes the last row of the
    latest month before it, found among one row per key and month.
    """
    month = F.date_trunc("month", F.col(order[0]))
    df = df.withColumn("_m", month)
    w = Window.partitionBy(key, "_m").orderBy(*order)
    last = df.groupBy(key, "_m").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    w2 = Window.partitionBy(key).orderBy("_m")
    carried = last.select(key, "_m", F.lag("_last").over(w2).alias("_carried"))
    out = df.withColumn("_prev", F.lag(F.struct(*cols)).over(w)).join(carried, [key, "_m"])
    return out.withColumn("prev", F.coalesce("_prev", "_carried")).drop("_m", "_prev", "_carried")


def schema_changes(dumps: DataFrame) -> DataFrame:
    """(dump_id, field, change): changes against the file before it in ``scraped_at`` order of its ``source_url``.

    The first file of a source has no changes. A body that is null, empty or no JSON carries no
    field. A change of type needs non-null values in both files. Files of equal time are ordered by
    ``dump_id``; files without a source form one series.
    """
    files = parsed(dumps)
    e = _entries(files).withColumn("kind", _kind(F.expr("schema_of_variant(value)")))
    per = e.groupBy("dump_id", "field").agg(F.sort_array(F.collect_set("key")).alias("keys"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    wide = per.groupBy("dump_id").agg(*[F.first(F.when(F.col("field") == f, F.struct("keys", "kinds")), ignorenulls=True).alias(f) for f in ALIASES])
    base = files.select("dump_id", F.coalesce("source_url", F.lit("")).alias("source_url"), "scraped_at").join(wide, "dump_id", "left")
    seq = _before(base, "source_url", ["scraped_at", "dump_id"], list(ALIASES)).where("prev is not null")
    out = []
    for f in ALIASES:
        now, was = F.col(f), F.col(f"prev.{f}")
        added = F.when(was.isNull() & now.isNotNull(), "added").when(was.isNotNull() & now.isNull(), "removed")
        renamed = F.when(was["keys"] != now["keys"], "renamed")
        retyped = F.when((F.size(was["kinds"]) > 0) & (F.size(now["kinds"]) > 0) & (was["kinds"] != now["kinds"]), "retyped")
        out += [F.when(c.isNotNull(), F.struct(F.lit(f).alias("field"), c.alias("change"))) for c in (added, renamed, retyped)]
    return seq.select("dump_id", F.explode(F.array_compact(F.array(*out))).alias("c")).select("dump_id", "c.field", "c.change")


#: Levels of nesting that get paths of their own; what lies deeper stays in its object or list.
DEPTH = 5


def values(files: DataFrame) -> DataFrame:
    """(dump_id, place, rec, source_path, path, field, json_type, value): every value of the metadata and of each record.

    ``path`` is the source's path in one spelling (lower case, no separators in keys), with ``[]`` for the
    elements of a list; ``field`` is the canonical field of the path, or the path itself.
    """
    spark = files.sparkSession
    level = spark.sql(
        "select dump_id, 'metadata' as place, 0 as rec, '' as source_path, try_variant_get(v, '$.metadata', 'variant') as value from {f} where schema_of_variant(v) like 'OBJECT%' "
        "union all select f.dump_id, 'members', m.pos, '', m.value from {f} f, lateral variant_explode(case when schema_of_variant(f.v) like 'ARRAY%' then f.v else try_variant_get(f.v, '$.members', 'variant') end) m",
        f=files,
    )
    out = None
    for depth in range(DEPTH):
        if depth:
            level = level.where("json_type in ('object', 'list')")
        level = spark.sql(
            "select l.dump_id, l.place, l.rec, case when e.key is null then concat(l.source_path, '[]') when l.source_path = '' then e.key else concat(l.source_path, '.', e.key) end as source_path, e.value from {l} l, lateral variant_explode(l.value) e",
            l=level.where("value is not null"),
        )
        level = level.withColumn("json_type", _kind(F.expr("schema_of_variant(value)")))
        out = level if out is None else out.unionByName(level)
    out = out.withColumn("path", F.lower(F.regexp_replace("source_path", "[-_ ]", "")))
    return out.withColumn("field", F.coalesce(_canonical(F.col("place"), F.col("path")), F.col("path"))).select("dump_id", "place", "rec", "source_path", "path", "field", "json_type", "value")


def unified_paths(dumps: DataFrame) -> DataFrame:
    """One consistent table of all paths: a row per value, with typed branches and a canonical string.

    Objects and lists keep their JSON text besides the rows of what they hold. JSON null gives nulls in all branches.
    """
    e = values(parsed(dumps))
    text = F.expr("try_variant_get(value, '$', 'string')")
    held = F.col("json_type").isin("object", "list")
    return e.select(
        "dump_id", "place", "rec", "field", "source_path", "json_type",
        F.when(F.col("json_type") == "text", text).alias("as_text"), F.when(F.col("json_type") == "number", F.expr("try_variant_get(value, '$', 'double')")).alias("as_number"),
        F.when(F.col("json_type") == "flag", F.expr("try_variant_get(value, '$', 'boolean')")).alias("as_flag"), F.when(held, F.to_json("value")).alias("as_json"),
        F.when(held, F.to_json("value")).otherwise(text).alias("canonical"),
    )


def path_types(dumps: DataFrame) -> DataFrame:
    """(place, field, json_type, values, files): the tagged union of each path over all files; null for JSON null."""
    e = values(parsed(dumps))
    return e.groupBy("place", "field", "json_type").agg(F.count("*").alias("values"), F.countDistinct("dump_id").alias("files"))


def _pairs(files: DataFrame) -> DataFrame:
    """(dump_id, was): each file and the one before it of its source."""
    base = files.select("dump_id", F.coalesce("source_url", F.lit("")).alias("source_url"), "scraped_at")
    seq = _before(base.withColumn("id", F.col("dump_id")), "source_url", ["scraped_at", "dump_id"], ["id"])
    return seq.where("prev is not null").select("dump_id", F.col("prev.id").alias("was"))


def path_changes(dumps: DataFrame) -> DataFrame:
    """(dump_id, place, field, change): ``schema_changes`` for every path, against the file before it of the same source."""
    files = parsed(dumps)
    pairs = _pairs(files)
    per = values(files).groupBy("dump_id", "place", "field").agg(F.sort_array(F.collect_set("source_path")).alias("keys"), F.sort_array(F.collect_set("json_type")).alias("kinds"))
    now = per.join(pairs.select("dump_id"), "dump_id")
    was = per.select(F.col("dump_id").alias("was"), "place", "field", F.col("keys").alias("keys0"), F.col("kinds").alias("kinds0")).join(pairs, "was").drop("was")
    both = now.join(was, ["dump_id", "place", "field"], "full")
    change = F.array_compact(F.array(
        F.when(F.col("keys0").isNull(), "added").when(F.col("keys").isNull(), "removed"), F.when(F.col("keys") != F.col("keys0"), "renamed"),
        F.when((F.size("kinds") > 0) & (F.size("kinds0") > 0) & (F.col("kinds") != F.col("kinds0")), "retyped"),
    ))
    return both.select("dump_id", "place", "field", F.explode(change).alias("change"))


#: Share of the fewer different values that two paths have in common from which on one took the place of the other.
OVERLAP = 0.5


def path_renames(dumps: DataFrame) -> DataFrame:
    """(dump_id, place, old, new, shared, overlap): paths that vanished where another of like values appeared.

    Both have two different scalar values or more; no list of known names takes part.
    """
    files = parsed(dumps)
    pairs = _pairs(files)
    v = values(files).where("json_type in ('text', 'number')").select("dump_id", "place", "path", F.xxhash64("json_type", F.expr("try_variant_get(value, '$', 'string')")).alias("x")).distinct()
    seen = v.select("dump_id", "place", "path").distinct()
    now = v.join(pairs.select("dump_id", "was"), "dump_id")
    was = v.withColumnRenamed("dump_id", "was").join(pairs, "was")
    new = now.join(seen.withColumnRenamed("dump_id", "was"), ["was", "place", "path"], "left_anti").select("dump_id", "place", F.col("path").alias("new"), "x")
    old = was.join(seen, ["dump_id", "place", "path"], "left_anti").select("dump_id", "place", F.col("path").alias("old"), "x")
    met = old.join(new, ["dump_id", "place", "x"]).groupBy("dump_id", "place", "old", "new").agg(F.count("*").alias("shared"))
    size = lambda df, c: df.groupBy("dump_id", "place", c).agg(F.count("*").alias(f"n_{c}"))
    met = met.join(size(old, "old"), ["dump_id", "place", "old"]).join(size(new, "new"), ["dump_id", "place", "new"])
    few = F.least("n_old", "n_new")
    return met.where((few >= 2) & (F.col("shared") >= OVERLAP * few)).select("dump_id", "place", "old", "new", "shared", F.round(F.col("shared") / few, 4).alias("overlap"))
