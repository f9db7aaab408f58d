"""Which rows of ``members`` describe one business, and which contacts are one person.

Rows become profiles (distinct name, phone, fax, website host and place), so plain repeats cost one
profile. A profile takes part in the shards of its phone, fax, place and house number, box, and host
within a place. In each shard the names decide (``names.link_companies``); nameless profiles join a
shard's only business. Clusters of shards and profiles form a bipartite graph whose components are
the businesses: the smallest id spreads over memberships, with pointer jumping, until nothing changes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from rollbook.llm import addresses, names
from rollbook.llm.components import components, linked, stars
from rollbook.llm.pairs import differing
from rollbook.llm.residue import is_residue
from rollbook.work import cut, drop_cut, hashed, look_up


def digits10(c: Column) -> Column:
    """Ten digits of a full phone number that is no dummy; null otherwise. Separators of any kind, a leading 1 and
    extensions are left out."""
    s = F.lower(c)
    s = F.when(s.contains("x"), F.regexp_replace(s, r"(?:ext\.?|extension|x)\s*\d+\s*$", "")).otherwise(s)
    s = F.regexp_replace(s, r"[^0-9a-z]+", "")
    s = F.when(s.startswith("tel"), F.substring(s, 4, 1_000)).otherwise(s)
    s = F.when((F.length(s) == 11) & s.startswith("1"), F.substring(s, 2, 10)).otherwise(s)
    full = (F.length(s) == 10) & (F.translate(s, "0123456789", "") == "")
    dummy = s.isin("1234567890", "0123456789", "9876543210") | (F.substring(s, 4, 5) == "55501") | (s == F.repeat(F.substring(s, 1, 1), F.lit(10)))
    return F.when(full & ~dummy, s)


def host(c: Column) -> Column:
    """Host of a web address, without ``www.``; null for mail addresses, fragments, junk and profile pages."""
    s = F.lower(F.trim(c))
    listed = s.contains("/profile") | s.contains("/listing") | s.contains("/find-a-pro/") | s.contains("/directory/")
    s = F.when(~(listed & s.rlike(r"/(?:profiles?|listings?|find-a-pro|directory)/")), s)  # a page of a directory
    h = F.regexp_extract(s, r"^(?:https?://)?(?:www\.)?((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,})(?::\d+)?(?:[/?#]|$)", 1)
    return F.when(h != "", h)


def domain(h: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(h, ".", -2)


def directory_domains(members: DataFrame) -> DataFrame:
    """Domains of the pages that records were taken from, one row each. Hosts are read once per distinct address."""
    # no filter on the domain: it would be read once per row again
    return members.select("source_url").distinct().select(domain(host(F.col("source_url"))).alias("dom")).distinct()


def known_directories(members: DataFrame) -> DataFrame:
    """(dom, _d): ``directory_domains``, written."""
    return cut(directory_domains(members).withColumn("_d", F.lit(True)), "entity-directories")


def own_host(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with ``host`` set to null where it is a directory's. Directories are few (120 in the test tables), but
    their number is not bounded, so their domains are counted before they are broadcast."""
    flagged = look_up(rows.withColumn("dom", domain(F.col("host"))), known, "dom", "left")
    return flagged.withColumn("host", F.when(F.col("_d").isNull(), F.col("host"))).drop("_d", "dom")


def usable_name(c: Column) -> Column:
    """A name that is no residue, mail address, web address or phone number."""
    s = F.lower(F.trim(c))
    other = s.rlike(r"^\S+@\S+\.\S+$|^(?:https?://|www\.)|^(?:[a-z0-9-]+\.)+(?:example|com|org|net|biz|info|us)(?:/\S*)?$|^tel:|^[-+().\s\d]*(?:(?:ext\.?|x)\s*\d+)?$|^mailto:")
    return c.isNotNull() & c.rlike(r"(?U)[^\s\u200b\ufeff]") & ~other & ~is_residue(c)


_READ = "core string, trade string, cut boolean, place string, spot string, box string"


def featured(table: DataFrame, key: str, extra: list[str] = [], ends: DataFrame | None = None) -> DataFrame:
    """One row per ``key``: phone, fax, host, core, trade, cut, place, spot, box.

    ``spot`` is place and house number, ``box`` place and box number; each is null where not stated.
    Names and addresses are read in one pass over the rows, without a shuffle; only the gazetteer, at
    most 100,000 rows, is learned beforehand (from ``ends`` where they are known) and sent to the executors.
    """
    texts = table.select(F.explode(F.array("street_address", "mailing_address")).alias("s"))
    gazetteer = addresses.learn(texts.where(F.col("s").rlike(r"\d"))) if ends is None else addresses.learned(ends)
    shared = table.sparkSession.sparkContext.broadcast(gazetteer)

    @pandas_udf(_READ)
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        g = addresses.Gazetteer(shared.value)

        def places(street: str | None, mail: str | None) -> tuple:
            a, b = addresses.parse(street, g), addresses.parse(mail, g)
            place = [x[0] if x and x[0] and x[0][0] != "?" else None for x in (a, b)]
            spot = f"{place[0]}|{a[3]}" if a and a[3] and place[0] else None
            box = next((f"{p}|{x[2]}" for x, p in ((b, place[1]), (a, place[0])) if x and x[2] and p), None)
            return place[0] or place[1], spot, box

        for name, street, mail in batches:
            rows = []
            for n, s, m in zip(name, street, mail):
                core, trade, cut = names.company(n) if n else (None, None, None)
                rows.append((core, trade, cut, *places(s, m)) if core else (None, None, None, *places(s, m)))
            yield pd.DataFrame(rows, columns=["core", "trade", "cut", "place", "spot", "box"], dtype=object)

    name = F.when(usable_name(F.col("company_name")), F.col("company_name"))
    stated = lambda c: F.when(F.col(c).rlike(r"\d"), F.col(c))
    base = table.select(key, *extra, name.alias("_n"), stated("street_address").alias("_s"), stated("mailing_address").alias("_m"), digits10(F.col("phone")).alias("phone"), digits10(F.col("fax")).alias("fax"), host(F.col("website")).alias("host"))
    got = base.withColumn("_f", read("_n", "_s", "_m"))
    return got.select(key, *extra, "phone", "fax", "host", "_f.*")


_LINKS = T.StructType([T.StructField("p", T.ArrayType(T.LongType())), T.StructField("c", T.ArrayType(T.LongType()))])
#: Signs between the fields of a profile and between the profiles of a shard; they do not occur in values.
_F, _R = "\x1f", "\x1e"


def packed(*cols: str) -> Column:
    """A profile's fields as one string: whole shards pass to Python as plain strings, which is cheap."""
    return F.concat_ws(_F, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def unpacked(shard: str) -> list[list]:
    return [[int(r[0]), *[x or None for x in r[1:]]] for r in (x.split(_F) for x in shard.split(_R))]


#: Shards of one business follow each other, often with the same names.
_link_companies = lru_cache(maxsize=1_000)(lambda keys: names.link_companies(list(keys)))


def _cluster(shard: str) -> list[tuple[int, int]]:
    """(profile, cluster) in one shard: by name; nameless profiles join by phone or host, or the only cluster."""
    rows = [(p, core, trade or "", cut == "true", phone, host) for p, core, trade, cut, phone, host in unpacked(shard)]
    keys = sorted({r[1:4] for r in rows if r[1]})
    where = dict(zip(keys, _link_companies(tuple(keys)))) if keys else {}
    out, empty = [], []
    phones: dict[int, set] = {}
    hosts: dict[int, set] = {}
    for r in rows:
        if r[1]:
            c = where[r[1:4]]
            out.append((r[0], c))
            phones.setdefault(c, set()).add(r[4])
            hosts.setdefault(c, set()).add(r[5])
        else:
            empty.append(r)
    clusters = sorted(set(where.values()))
    new = len(keys)
    for k, r in enumerate(empty):
        fits = [c for c in clusters if (r[4] and r[4] in phones[c]) or (r[5] and r[5] in hosts[c])]
        both = [c for c in fits if r[4] and r[4] in phones[c] and r[5] and r[5] in hosts[c]]
        fits = both or fits
        if not fits and len(clusters) == 1:
            known = phones[clusters[0]] - {None}
            if not (r[4] and known and r[4] not in known) or (r[5] and r[5] in hosts[clusters[0]]):
                fits = clusters
        if len(fits) == 1:
            out.append((r[0], fits[0]))
        elif not clusters:
            out.append((r[0], new))
        else:
            out.append((r[0], new + 1 + k))
    return out


def _split(pairs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    return [p for p, _ in pairs], [c for _, c in pairs]


def _rooted(pairs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """(members, the smallest member of each one's cluster), without the smallest themselves."""
    low: dict[int, int] = {}
    for p, c in pairs:
        low[c] = min(p, low.get(c, p))
    return _split([(p, low[c]) for p, c in pairs if p != low[c]])


@pandas_udf(_LINKS)
def _cluster_udf(shards: pd.Series) -> pd.DataFrame:
    got = [_rooted(_cluster(s)) for s in shards]
    return pd.DataFrame({"p": [g[0] for g in got], "c": [g[1] for g in got]})


FEATURES = ["core", "trade", "cut", "phone", "fax", "host", "place", "spot", "box"]


def member_features(members: DataFrame, extra: list[str] = [], known: DataFrame | None = None) -> DataFrame:
    """(member_id, *extra, *FEATURES, h, k) of all rows, written once; ``h`` and ``k`` are hashes of the features, 128 bits
    together."""
    ends = None
    if known is None:  # pages and ends of addresses are read in one pass
        text = lambda page, c: F.struct(F.lit(page).alias("page"), c.alias("e"))
        each = members.select(F.explode(F.array(text(True, F.col("source_url")), *[text(False, addresses.ending(F.col(c))) for c in ("street_address", "mailing_address")])).alias("x"))
        seen = cut(each.select("x.*").groupBy("page", "e").agg(F.count("*").alias("m")), "entity-texts")
        known, ends = known_directories(seen.where("page").select(F.col("e").alias("source_url"))), seen.where("not page").select("e", "m")
    own = own_host(featured(members, "member_id", extra, ends), known)
    return cut(own.select("member_id", *extra, *FEATURES).withColumns({"h": F.xxhash64(*FEATURES), "k": F.xxhash64(F.lit(1), *FEATURES)}), "entity-rows")


def _bare(*cols: str) -> Column:
    return F.coalesce(*cols).isNull()


def profile_groups(rows: DataFrame) -> DataFrame:
    """(h, k, p, rows, c): the smallest ``member_id`` and the rows of each profile, and the number of its business, which is
    the ``member_id`` of some row of it.

    Profiles with nothing to link by have no row. All keys are numbers while profiles meet; names are only
    fetched for the shards whose profiles differ.
    """
    profiles = rows.where(~_bare("phone", "fax", "host", "spot", "box")).groupBy("h", "k", *FEATURES).agg(F.min("member_id").alias("p"), F.count("*").alias("rows"))
    profiles = cut(profiles, "entity-profiles")
    tag = lambda t, *c: F.when(F.concat(*c).isNotNull(), F.xxhash64(F.lit(t), *c))
    keys = F.array_compact(F.array(tag("p", F.col("phone")), tag("p", F.col("fax")), tag("s", F.col("spot")), tag("b", F.col("box")), tag("h", F.col("host"), F.col("place"))))
    core = F.when(F.col("core").isNotNull(), F.xxhash64("core"))
    wide = profiles.select("p", core.alias("nm"), F.explode(F.array_distinct(keys)).alias("key"))
    whole = wide.groupBy("key").agg(F.count("*").alias("n"), F.count("nm").alias("named"), F.min("nm").alias("lo"), F.max("nm").alias("hi"), F.min("p").alias("q"), F.bit_xor(F.xxhash64("p")).alias("all"), F.bit_xor(F.xxhash64(F.lit(1), "p")).alias("all2"))
    # of shards of the same profiles one will do
    whole = whole.where("n > 1").groupBy("n", "q", "all", "all2").agg(F.min("key").alias("key"), F.min("named").alias("named"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    alike = F.coalesce((F.col("n") == F.col("named")) & (F.col("lo") == F.col("hi")), F.lit(False))
    some = cut(wide.select("p", "key").join(hashed(whole.select("key", "q", F.when(~alike, F.col("n")).alias("n"))), "key"), "entity-shards")
    # a profile has at most five keys, so no task gets many shards of one ``q``
    # shards of one core need no comparison
    pairs = some.where("n is null and p > q").select("p", "q")
    item = profiles.select("p", F.concat_ws(_F, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("p", "core", "trade", "cut", "phone", "host")]).alias("item"))
    small = some.where(F.col("n") <= names.SHARD).select("p", "q", "key").join(hashed(item), "p").repartition("q").groupBy("q", "key").agg(F.array_join(F.collect_list("item"), _R).alias("s"))
    near = small.select(_cluster_udf("s").alias("l")).select(F.explode(F.arrays_zip("l.p", "l.c")).alias("z"))
    pairs = pairs.unionByName(near.select(F.col("z.p").alias("p"), F.col("z.c").alias("q")))
    large = some.where(F.col("n") > names.SHARD).select("p", "key")
    if not large.isEmpty():
        pairs = pairs.unionByName(stars(cut(_large_shards(large.join(item, "p")), "entity-large")))
    pairs = cut(pairs, "entity-links")
    drop_cut(some)
    labels = linked(pairs, "entity-labels")
    placed = ~_bare("phone", "fax", "spot", "box")
    known = cut(profiles.select("h", "k", "p", "rows", "host", placed.alias("placed")).join(hashed(labels), "p", "left").withColumn("c", F.coalesce("c", "p")), "entity-known")
    drop_cut(pairs)
    # profiles known by their host alone join the host's business if it has only one
    lost = known.where("host is not null and not placed")
    if not lost.isEmpty():
        ones = known.where("host is not null and placed").groupBy("host").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
        kin = lost.groupBy("host").agg(F.min("c").alias("kin")).join(ones, "host", "left")
        to = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNull(), F.col("kin")).otherwise(F.col("c"))
        known = known.where("host is null or placed").select("h", "k", "p", "rows", "c").unionByName(lost.join(kin, "host").select("h", "k", "p", "rows", to.alias("c")))
    return known.select("h", "k", "p", "rows", "c")


def profile_businesses(rows: DataFrame) -> DataFrame:
    """(h, k, business, n): the smallest ``member_id`` of the business of each profile, and the rows of that business."""
    known = profile_groups(rows)
    firms = known.groupBy("c").agg(F.min("p").alias("business"), F.sum("rows").alias("n"))
    return known.select("h", "k", "c").join(firms, "c").select("h", "k", "business", "n")


def businesses(members: DataFrame, rows: DataFrame | None = None, smallest: bool = True) -> DataFrame:
    """(member_id, business, named): the smallest ``member_id`` of each row's business, and whether the row has a usable name;
    also ``s`` where ``rows`` have it. Where only the grouping counts, ``smallest`` is false: a business has the
    ``member_id`` of any of its rows.

    Rows with nothing to link by are businesses of their own. Namesakes and branches in other places
    stay apart: names only count within shared evidence.
    """
    rows = member_features(members) if rows is None else rows
    by = profile_businesses(rows).drop("n") if smallest else profile_groups(rows).select("h", "k", F.col("c").alias("business"))
    done = rows.select("member_id", "h", "k", *[c for c in rows.columns if c == "s"], F.col("core").isNotNull().alias("named")).join(hashed(by), ["h", "k"], "left")
    return done.drop("h", "k").withColumn("business", F.coalesce("business", "member_id"))


def _grouped(linked: DataFrame, *keys: str) -> DataFrame:
    """(p, g): memberships from the clusters ``l`` of each shard."""
    z = linked.select(*keys, F.explode(F.arrays_zip("l.p", "l.c")).alias("z"))
    return z.select(F.col("z.p").alias("p"), F.xxhash64(*keys, "z.c").alias("g"))


@pandas_udf(T.ArrayType(T.StringType()))
def _shard_keys(core: pd.Series, cut: pd.Series) -> pd.Series:
    return pd.Series([[k for k in names.shard_keys(c, x) if k[0] != "i"] for c, x in zip(core, cut)], dtype=object)


@pandas_udf(T.ArrayType(T.StringType()))
def _initial_keys(core: pd.Series) -> pd.Series:
    return core.map(names.initial_keys)


def _shared_only(pairs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    size = Counter(c for _, c in pairs)
    return _split([x for x in pairs if size[x[1]] > 1])


@pandas_udf(_LINKS)
def _alike_udf(sub: pd.Series, shards: pd.Series) -> pd.DataFrame:
    got = []
    for kind, s in zip(sub, shards):
        rows = unpacked(s)
        got.append(_shared_only(list(zip([r[0] for r in rows], names.link_alike([(r[1], r[2] == "true") for r in rows], kind[0])))))
    return pd.DataFrame({"p": [g[0] for g in got], "c": [g[1] for g in got]})


@pandas_udf(_LINKS)
def _initials_udf(shards: pd.Series) -> pd.DataFrame:
    got = []
    for s in shards:
        rows = sorted(((core, trade or "", cut == "true"), c) for c, core, trade, cut in unpacked(s))
        sets = names.Sets(len(rows))
        for i, j in names.link_initials([n for n, _ in rows], [c for _, c in rows]):
            sets.join(i, j)
        got.append(_shared_only(list(zip([c for _, c in rows], sets.all()))))
    return pd.DataFrame({"p": [g[0] for g in got], "c": [g[1] for g in got]})


def _large_shards(shards: DataFrame) -> DataFrame:
    """(p, g): what ``_cluster`` gives, for shards of many names, whose rows never come together.

    Pairs of names meet in sub-shards; initials and nameless profiles are judged over the clusters that
    these make together.
    """
    f = F.split("item", _F)
    at = lambda k: F.nullif(F.get(f, F.lit(k)), F.lit(""))
    rows = shards.select("key", "p", at(1).alias("core"), at(2).alias("trade"), (F.get(f, F.lit(3)) == "true").alias("cut"), at(4).alias("phone"), at(5).alias("host"))
    named = rows.where("core is not null")
    cores = cut(named.groupBy("key", "core").agg(F.max("cut").alias("cut")).withColumn("id", F.xxhash64("key", "core")), "entity-cores")
    subs = cores.select("key", packed("id", "core", "cut").alias("item"), F.explode(_shard_keys("core", "cut")).alias("sub"))
    subs = subs.groupBy("key", "sub").agg(F.count("*").alias("n"), F.array_join(F.collect_list("item"), _R).alias("s")).where("n > 1")
    member = cut(_grouped(subs.select("key", "sub", _alike_udf("sub", "s").alias("l")), "key", "sub"), "entity-alike")
    alike = components(member, "entity-alike-labels").select(F.col("p").alias("id"), "c")
    drop_cut(member)
    labels = cut(cores.join(alike, "id", "left").select("key", "core", F.coalesce("c", "id").alias("c")), "entity-core-labels")
    triples = named.select("key", "core", "trade", "cut").distinct().join(labels, ["key", "core"])
    short = triples.select("key", packed("c", "core", "trade", "cut").alias("item"), F.explode(_initial_keys("core")).alias("sub"))
    short = short.groupBy("key", "sub").agg(F.count("*").alias("n"), F.array_join(F.collect_list("item"), _R).alias("s")).where("n > 1")
    member = cut(_grouped(short.select("key", "sub", _initials_udf("s").alias("l")), "key", "sub").distinct(), "entity-initials")
    merged = components(member, "entity-initials-labels").select(F.col("p").alias("c"), F.col("c").alias("to"))
    drop_cut(member)
    found = cut(named.join(labels, ["key", "core"]).join(merged, "c", "left").select("key", "p", "phone", "host", F.coalesce("to", "c").alias("c")), "entity-found")
    # a nameless profile joins the cluster of its phone and host, or of either, if there is only one
    lost = rows.where("core is null").select("key", "p", "phone", "host")
    phones = found.where("phone is not null").select("key", "phone", "c").distinct()
    hosts = found.where("host is not null").select("key", "host", "c").distinct()
    count = lambda df, n, *k: df.groupBy(*k).agg(F.count("*").alias(f"n_{n}"), F.min("c").alias(n))
    both = lost.select("key", "phone", "host").distinct().join(hosts, ["key", "host"]).join(phones, ["key", "phone", "c"])
    only = found.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("phone").alias("known"))
    fits = lost.join(count(phones, "a", "key", "phone"), ["key", "phone"], "left").join(count(hosts, "b", "key", "host"), ["key", "host"], "left")
    fits = fits.join(count(both, "ab", "key", "phone", "host"), ["key", "phone", "host"], "left").join(only, "key").fillna(0, ["n_a", "n_b", "n_ab"])
    to = F.when(F.col("n_ab") > 0, F.when(F.col("n_ab") == 1, F.col("ab"))).when(F.col("n_a") + F.col("n_b") == 1, F.coalesce("a", "b"))
    to = to.when((F.col("n_a") + F.col("n_b") == 0) & (F.col("lo") == F.col("hi")) & (F.col("phone").isNull() | F.col("known").isNull()), F.col("lo"))
    joined = fits.select("key", "p", to.alias("c")).where("c is not null")
    return found.select("key", "p", "c").unionByName(joined).select("p", F.xxhash64("key", "c").alias("g"))


def _cluster_people(shard: str) -> list[tuple[int, int]]:
    rows = [(q, (first or "", last or "", gen or "")) for q, first, last, gen in unpacked(shard)]
    keys = sorted({k for _, k in rows})
    where = dict(zip(keys, names.link_persons(keys)))
    return [(q, where[k]) for q, k in rows]


@pandas_udf(_LINKS)
def _people_udf(shards: pd.Series) -> pd.DataFrame:
    got = [_rooted(_cluster_people(s)) for s in shards]
    return pd.DataFrame({"p": [g[0] for g in got], "c": [g[1] for g in got]})


@pandas_udf(T.ArrayType(T.StringType()))
def _last_keys(last: pd.Series) -> pd.Series:
    return last.map(names.last_keys)


@pandas_udf(_LINKS)
def _lasts_udf(shards: pd.Series) -> pd.DataFrame:
    got = []
    for s in shards:
        rows = unpacked(s)
        near, sets = names.near_lasts([r[1] or "" for r in rows]), names.Sets(len(rows))
        for i, js in enumerate(near):
            for j in js:
                sets.join(i, j)
        got.append(_shared_only(list(zip([r[0] for r in rows], sets.all()))))
    return pd.DataFrame({"p": [g[0] for g in got], "c": [g[1] for g in got]})


def _large_people(shards: DataFrame) -> DataFrame:
    """(p, q): what ``_cluster_people`` gives, for shards of many people; q is the smallest of p's cluster.

    People meet by near last names or in swapped order only, so those that are connected by these are
    linked in one call, with all their rivals.
    """
    f = F.split("item", _F)
    rows = shards.select("key", "item", "last", F.get(f, F.lit(1)).alias("first"), F.get(f, F.lit(3)).alias("gen"), F.xxhash64("key", "last").alias("node"))
    lasts = rows.select("key", "last", "node").distinct()
    subs = lasts.select("key", packed("node", "last").alias("it"), F.explode(_last_keys("last")).alias("sub"))
    subs = subs.groupBy("key", "sub").agg(F.count("*").alias("n"), F.array_join(F.collect_list("it"), _R).alias("s")).where("n > 1")
    near = _grouped(subs.select("key", "sub", _lasts_udf("s").alias("l")), "key", "sub")
    swap = rows.groupBy("key", F.least("first", "last").alias("a"), F.greatest("first", "last").alias("b"), "gen").agg(F.collect_set("node").alias("nodes"))
    swap = swap.where(F.size("nodes") > 1).select(F.explode("nodes").alias("p"), F.xxhash64("key", "a", "b", "gen").alias("g"))
    member = cut(near.unionByName(swap), "person-near")
    part = components(member, "person-near-labels").select(F.col("p").alias("node"), "c")
    drop_cut(member)
    met = rows.join(part, "node", "left").groupBy(F.coalesce("c", "node").alias("c")).agg(F.array_join(F.collect_list("item"), _R).alias("s"))
    z = met.select(_people_udf("s").alias("l")).select(F.explode(F.arrays_zip("l.p", "l.c")).alias("z"))
    return z.select(F.col("z.p").alias("p"), F.col("z.c").alias("q"))


# Mailboxes that belong to no one person.
SHARED_BOXES = ("info", "office", "contact", "sales", "admin", "hello", "mail", "support", "help", "team", "service", "services", "hr", "jobs", "billing", "enquiries", "inquiries")


@pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in ("first", "last", "gen")]))
def _person(names_: pd.Series) -> pd.DataFrame:
    none = (None, None, None)
    return pd.DataFrame([p if (p := names.person(n)) and p[0] and p[1] else none for n in names_], columns=["first", "last", "gen"], dtype=object)


def persons(members: DataFrame, business: DataFrame) -> DataFrame:
    """(member_id, pos, s, person): contacts with a name that is no residue, the name's number, and a number for each person.

    Contacts of one business are linked by name; across businesses only by a mailbox of their own
    together with the name. Contacts whose name has no two parts are persons of their own.
    """
    flat = members.select("member_id", F.posexplode("contacts").alias("pos", "c")).select("member_id", "pos", "c.name", F.lower("c.email").alias("email"))
    marked = F.col("email").contains("mailto:") | F.col("email").rlike(r"[?\s]")
    flat = flat.withColumn("email", F.when(marked, F.regexp_replace(F.regexp_replace("email", r"^\s*mailto:", ""), r"\?.*$|\s+", "")).otherwise(F.col("email")))
    flat = flat.where("name is not null and trim(name) != ''").withColumn("_n", _person("name"))
    box = F.when(F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[a-z]+$") & ~F.substring_index("email", "@", 1).isin(*SHARED_BOXES), F.xxhash64("email"))
    sound = ~F.col("name").rlike(r"[{}\[\]<>%*@_~$#&]") | ~is_residue(F.col("name"))
    flat = flat.select("member_id", "pos", F.xxhash64("name").alias("s"), sound.alias("sound"), box.alias("box"), "_n.*")
    rows = cut(flat.join(hashed(business.select("member_id", "business")), "member_id").withColumn("q", F.xxhash64("business", "box", "first", "last", "gen")), "person-rows")
    people = cut(rows.where("first is not null").groupBy("q", "business", "box", "first", "last", "gen").agg(F.lit(1).alias("one")).drop("one"), "person-people")
    tag = lambda t, c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(t), c))
    wide = people.select("q", F.xxhash64("first", "last", "gen").alias("nm"), F.explode(F.array_compact(F.array(tag("b", "business"), tag("e", "box")))).alias("key"))
    whole = wide.groupBy("key").agg(F.count("*").alias("n"), F.min("nm").alias("lo"), F.max("nm").alias("hi"), F.min("q").alias("low")).where("n > 1")
    some = cut(wide.select("q", "key").join(hashed(whole.select("key", "low", F.when(F.col("lo") != F.col("hi"), F.col("n")).alias("n"))), "key"), "person-shards")
    pairs = some.where("n is null and q > low").select(F.col("q").alias("p"), F.col("low").alias("q"))
    item = people.select("q", "last", packed("q", "first", "last", "gen").alias("item"))
    small = some.where(F.col("n") <= names.SHARD).select("q", "key").join(hashed(item), "q").groupBy("key").agg(F.array_join(F.collect_list("item"), _R).alias("s"))
    near = small.select(_people_udf("s").alias("l")).select(F.explode(F.arrays_zip("l.p", "l.c")).alias("z"))
    pairs = pairs.unionByName(near.select(F.col("z.p").alias("p"), F.col("z.c").alias("q")))
    large = some.where(F.col("n") > names.SHARD).select("q", "key")
    if not large.isEmpty():
        pairs = pairs.unionByName(_large_people(large.join(item, "q")))
    pairs = cut(pairs, "person-links")
    drop_cut(some)
    comp = linked(pairs, "person-labels").select(F.col("p").alias("q"), F.col("c").alias("person"))
    drop_cut(pairs)
    person = F.coalesce("person", F.when(F.col("first").isNotNull(), F.col("q")), F.xxhash64("member_id", "pos"))
    return rows.where("sound").select("member_id", "pos", "s", "first", "q").join(hashed(comp), "q", "left").select("member_id", "pos", "s", person.alias("person"))


def variants(members: DataFrame, business: DataFrame) -> DataFrame:
    """(field, member_id_a, pos_a, member_id_b, pos_b): pairs of different strings for one business or person.

    Names cut off count. Blank names, residues, and company names that are a mail address, web address
    or phone number have no pairs. Repeated rows pair where their strings differ.
    """
    if "s" not in business.columns:
        business = business.join(members.select("member_id", F.xxhash64("company_name").alias("s")), "member_id")
    firm = business.where("named").select(F.col("business").alias("g"), "s", F.lit(-1).alias("pos"), "member_id")
    who = persons(members, business).select(F.col("person").alias("g"), "s", "pos", "member_id")
    # a person's number may be a business's too
    both = firm.unionByName(who).withColumn("g", F.xxhash64("g", F.col("pos") < 0))
    got = differing(both, ("member_id", "pos"), "p3-strings").where("a < b")
    field = F.when(F.col("a.pos") < 0, "company_name").otherwise("contacts.name").alias("field")
    return got.select(field, F.col("a.member_id").alias("member_id_a"), F.greatest("a.pos", F.lit(0)).alias("pos_a"), F.col("b.member_id").alias("member_id_b"), F.greatest("b.pos", F.lit(0)).alias("pos_b"))
