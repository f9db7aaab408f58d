"""Candidates of a search: skipping, deduplication with a cap per domain, matching, verification, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import rules
from rollbook.functions import text as t

# Phrases of directory pages, walls, parked domains and data brokers.
STRONG_PHRASES = [
    "member directory", "members directory", "find a member", "find a doctor", "find an attorney", "find a provider", "find a dentist", "find a lawyer",
    "member listing", "member list", "our members", "search the directory", "browse members", "directory search", "provider directory", "provider search",
    "physician directory", "physician finder", "results per page",
]
WEAK_WORDS = [
    "member", "members", "directory", "directories", "listing", "listings", "results", "company", "companies", "provider", "providers", "doctor", "doctors",
    "dentist", "dentists", "restaurant", "restaurants", "attorney", "attorneys", "lawyer", "lawyers", "contractor", "contractors", "vendor", "vendors",
    "association", "associations", "chamber", "chambers", "registry", "registries", "roster", "rosters",
]
WALL_PHRASES = [
    "please log in", "please sign in", "log in to view", "sign in to view", "log in to access", "sign in to access", "log in to see", "sign in to see",
    "must be logged in", "must sign in", "members only", "subscribers only", "subscriber only", "subscribe to view", "subscribe to read",
]
PARKED_PHRASES = [
    "this domain is for sale", "this domain may be for sale", "buy this domain", "domain is available for purchase", "domain for sale", "inquire about this domain",
    "interested in this domain", "godaddy coming soon", "domain parking", "domain has expired", "premium domain for sale",
]
BROKER_PHRASES = [
    "sign up for free to view", "sign up for free to see", "unlock accurate emails", "unlock contact data", "find more accurate contact", "verified email format",
    "ideal prospects with", "looking for contact data", "trying to find reliable", "company overview page for more information", "'s company overview page",
]
REGIONS = {
    "midwest": "IL OH MI IN WI MN IA MO KS NE SD ND", "northeast": "NY NJ PA MA CT RI NH VT ME", "southeast": "FL GA AL MS SC NC TN KY VA WV AR LA",
    "southwest": "TX OK NM AZ", "west coast": "CA OR WA", "west": "CA OR WA NV ID UT AZ MT WY CO", "northwest": "WA OR ID MT",
    "new england": "ME NH VT MA CT RI", "south": "TX FL GA AL MS SC NC TN KY VA AR LA OK", "pacific northwest": "WA OR ID",
}


def skippable(url: Column) -> Column:
    """Domains, path prefixes, dated paths and file endings that are never a directory."""
    host, path = t.host_of(url), F.lower(t.path_of(url))
    bad_path = path.rlike("^(?:" + "|".join(rules.SKIP_PREFIXES) + ")") | path.rlike("/20[12][0-9]/") | path.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in rules.SKIP_ENDINGS) + ")$")
    return host.isNull() | t.in_domains(host, rules.SKIP_DOMAINS) | bad_path


def dedup_cap(hits: DataFrame) -> DataFrame:
    """(url, title, via_query, rank): search hits in order of rank, one per page, at most two pages per domain.

    Hits have (query_idx, query, rank, url, title). A page is its host and path; its first arrival gives
    address and title, its best rank gives rank and query. Pages of a domain are capped by arrival: the
    two earliest are found by aggregation (two rounds of ``min``), not by ranking a domain's rows in one task.
    """
    h = hits.where(F.col("url").startswith("http") & ~skippable(F.col("url")) & (F.col("rank") < rules.RESULTS_PER_QUERY))
    h = h.withColumn("domain", t.host_of(F.col("url"))).withColumn("page", F.lower(F.regexp_replace(t.path_of(F.col("url")), "/+$", "")))
    arrival, better = F.struct("query_idx", "rank", "url"), F.struct("rank", "query_idx")
    p = h.groupBy("domain", "page").agg(F.min(arrival).alias("a"), F.min_by(F.struct("url", "title"), arrival).alias("f"), F.min("rank").alias("rank"), F.min_by("query", better).alias("via_query"))
    first = p.groupBy("domain").agg(F.min("a").alias("a1"))
    rest = p.join(first, "domain").where(F.col("a") != F.col("a1"))
    second = rest.groupBy("domain").agg(F.min("a").alias("a2"))
    kept = p.join(first, "domain").join(second, "domain", "left").where((F.col("a") == F.col("a1")) | F.coalesce(F.col("a") == F.col("a2"), F.lit(False)))
    return kept.select("f.url", "f.title", "via_query", "rank", F.col("a.query_idx").alias("query_idx"))


def keyword_pass(text: Column) -> Column:
    """One strong phrase, or two different whole words of a directory."""
    low = F.lower(text)
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z]+", " "), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")), " ")
    return t.any_word(low, STRONG_PHRASES) | (F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in WEAK_WORDS]))) >= 2)


def verdict(text: Column, js_shell: Column, contact: Column) -> Column:
    """Why a page is rejected, in order of cost; ``js_rendered`` and ``passed`` are no rejections."""
    low = F.lower(text)
    return (
        F.when((F.length(text) < 1500) & js_shell, "js_rendered").when(F.length(text) < 1500, "thin_content").when(t.any_word(low, PARKED_PHRASES), "parked_domain")
        .when(t.any_word(low, WALL_PHRASES), "login_wall").when(t.any_word(low, BROKER_PHRASES), "data_broker_profile")
        .when(~keyword_pass(text), "no_directory_signals").when(~contact, "no_member_content").otherwise("passed")
    )


def tally(pages: DataFrame, reason: str = "reason") -> DataFrame:
    return pages.groupBy(reason).agg(F.count("*").alias("n"))


def website_match(records: DataFrame, results: DataFrame) -> DataFrame:
    """(id, site): the first search result whose host carries a distinctive word of the name.

    ``records`` has (id, name, source_root), ``results`` (id, rank, href). Words under five letters count
    at the start of the host or after a digit; names of trade words only need two of them.
    """
    dom = F.regexp_replace("host", "[-.]", "")
    r = results.withColumn("host", t.host_of(F.col("href"))).where(F.col("host").isNotNull() & ~t.in_domains(F.col("host"), rules.SKIP_DOMAINS)).withColumn("dom", dom)
    generic = F.array(*[F.lit(w) for w in rules.INDUSTRY_WORDS])
    n = records.withColumn("w", t.company_words(F.col("name")))
    n = n.withColumn("distinctive", F.filter(F.array_except("w", generic), lambda x: F.length(x) >= 3)).withColumn("generic", F.filter(F.array_intersect("w", generic), lambda x: F.length(x) >= 3))
    j = n.join(r, "id").where(F.col("source_root").isNull() | (t.host_root(F.col("host")) != F.col("source_root")))
    hit = lambda w: F.col("dom").contains(w) & ((F.length(w) >= 5) | F.col("dom").startswith(w) | F.regexp_replace(F.col("dom"), F.concat(F.lit(r"[0-9]"), w), "#").contains("#"))
    ok = F.when(F.size("distinctive") > 0, F.exists("distinctive", hit)).otherwise(F.size(F.filter("generic", hit)) >= 2)
    return j.where(ok).groupBy("id").agg(F.min_by(F.regexp_extract("href", r"^(https?://[^/?#]+)", 1), "rank").alias("site"))


def verified_pick(facts: DataFrame) -> DataFrame:
    """(id, href, score): among the first three viable results the best by page signals, if it reaches three points."""
    w = Window.partitionBy("id").orderBy("rank")
    first = facts.withColumn("k", F.row_number().over(w)).where("k <= 3")
    score = 2 * F.col("has_phone").cast("int") + 2 * F.col("has_email").cast("int") + F.col("has_location").cast("int") + F.col("has_name").cast("int")
    bonus = F.when(F.col("k") == 1, 0.5).when(F.col("k") == 2, 0.25).otherwise(0.0)
    s = first.withColumn("score", score).where("score >= 3").withColumn("o", F.col("score") + bonus)
    return s.groupBy("id").agg(F.max_by(F.struct("href", "score"), F.struct("o", F.negative("rank").alias("r"))).alias("b")).select("id", "b.href", "b.score")


def states_of_region(phrase: Column) -> Column:
    """States of the longest region named in a phrase; null if none is."""
    low, out = F.lower(phrase), F.lit(None).cast("string")
    for name in sorted(REGIONS, key=len):
        out = F.when(low.contains(name), F.lit(REGIONS[name])).otherwise(out)
    return out


def fallback_urls(plans: DataFrame) -> DataFrame:
    """(plan, label, url) search addresses of four directories for plans (plan, industry, city, state) with an industry and a state."""
    ok = plans.where((F.trim("industry") != "") & F.col("state").rlike("^[A-Za-z]{2}$")).withColumn("state", F.upper("state"))
    place = F.when(F.coalesce("city", F.lit("")) != "", F.concat_ws(", ", "city", "state")).otherwise(F.col("state"))
    q = lambda c: F.url_encode(c)
    urls = {
        "YellowPages": F.concat(F.lit("https://www.yellowpages.com/search?search_terms="), q("industry"), F.lit("&geo_location_terms="), q(place)),
        "Manta": F.concat(F.lit("https://www.manta.com/search?search="), q("industry"), F.lit("&search_location="), q(place)),
        "Cylex": F.concat(F.lit("https://www.cylex.us.com/s?q="), q("industry"), F.lit("&c="), q(F.coalesce("city", F.lit("")))),
        "ChamberOfCommerce": F.concat(F.lit("https://www.chamberofcommerce.com/search?what="), q("industry"), F.lit("&where="), q(place)),
    }
    return ok.select("plan", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), u.alias("url")) for k, u in urls.items()])).alias("u")).select("plan", "u.label", "u.url")
