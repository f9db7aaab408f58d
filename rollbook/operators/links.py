"""Groups among the links of pages: detail pages, categories, pagers, parameters that can be enumerated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import rules
from rollbook.functions import text as t

# Request parameters by what they mean.
PAGE_PARAMS = ["page", "pg", "pagenum", "pagenumber", "offset", "start", "skip", "p"]
TERM_PARAMS = ["q", "query", "search", "keyword", "keywords", "term", "name", "category", "cat", "type", "specialty", "industry"]
LETTER_PARAMS = ["letter", "alpha", "startswith", "char"]


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of pages (page_id, html), in order."""
    hrefs = F.regexp_extract_all("html", F.lit("(?i)<a\\b[^>]*\\bhref\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))


def usable(href: Column) -> Column:
    return F.coalesce(~href.rlike(r"(?i)^(?:mailto:|tel:|#|javascript:)") & (href != ""), F.lit(False))


def detail_groups(links: DataFrame) -> DataFrame:
    """(site, template, pages, score) of the best group of detail pages of each site; links have (site, pos, href)."""
    last = F.regexp_extract(F.regexp_replace(t.path_of(F.col("href")), "/+$", ""), r"([^/]*)$", 1)
    l = links.where(usable(F.col("href")) & ~last.startswith("-") & ~last.rlike(r"(?i)^(?:page|pg|p)[-_]?\d+$")).withColumn("template", t.url_template(F.col("href"))).where(F.col("template").contains("{ID}"))  # noqa: E741
    g = l.groupBy("site", "template").agg(F.countDistinct("href").alias("pages"), F.min("pos").alias("first")).where("pages >= 3")
    low = F.lower("template")
    count = lambda words: sum(low.contains(w).cast("int") for w in words)
    g = g.withColumn("score", F.col("pages") + 10 * count(rules.DETAIL_WORDS) - 15 * count(rules.OTHER_PAGE_WORDS)).where("score > 0")
    best = g.groupBy("site").agg(F.max_by(F.struct("template", "pages", "score"), F.struct("score", F.negative("first").alias("f"), "template")).alias("b"))
    return best.select("site", "b.template", "b.pages", "b.score")


def pager_param(links: DataFrame) -> DataFrame:
    """(site, param, last): the query parameter that pages through a listing; links share the listing's path."""
    q = F.regexp_extract("href", r"\?([^#]*)", 1)
    kv = F.transform(F.filter(F.split(q, "&"), lambda x: x.rlike(r"^[^=]+=\d{1,9}$")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring_index(x, "=", -1).cast("bigint").alias("v")))
    e = links.where(usable(F.col("href"))).select("site", F.explode(kv).alias("p"))
    g = e.groupBy("site", F.col("p.k").alias("param")).agg(F.max("p.v").alias("last"), F.countDistinct("p.v").alias("n"), F.max((F.col("p.v") == 2).cast("int")).alias("two"), F.max((F.col("p.v") == 3).cast("int")).alias("three"))
    named = F.lower("param").contains("page") | F.lower("param").contains("pg")
    g = g.where((F.col("two") == 1) & (F.col("n") >= 2)).withColumn("named", named.cast("int")).where((F.col("named") == 1) | ((F.col("three") == 1) & (F.col("last") <= 200)))
    return g.groupBy("site").agg(F.max_by(F.struct("param", "last"), F.struct("named", "n", "param")).alias("b")).select("site", "b.param", "b.last")


def path_pager(links: DataFrame) -> DataFrame:
    """(site, prefix, suffix, last): addresses that differ by a page number in their path."""
    rx = r"(?i)^(.*(?:(?:page|pg|paging)[^A-Za-z0-9]*|(?<![A-Za-z0-9])p))(\d{1,5})([^?#]*(?:\?[^#]*)?)"
    e = links.where(usable(F.col("href")) & F.col("href").rlike(rx)).select("site", F.regexp_extract("href", rx, 1).alias("prefix"), F.regexp_extract("href", rx, 2).cast("int").alias("n"), F.regexp_extract("href", rx, 3).alias("suffix"))
    g = e.where("n between 1 and 10000").groupBy("site", "prefix", "suffix").agg(F.countDistinct("n").alias("k"), F.max("n").alias("last"), F.max((F.col("n") == 2).cast("int")).alias("two")).where("two = 1 and k >= 2")
    return g.groupBy("site").agg(F.max_by(F.struct("prefix", "suffix", "last"), F.struct("k", "prefix", "suffix")).alias("b")).select("site", "b.prefix", "b.suffix", "b.last")


def category_groups(links: DataFrame, low: int = 3, high: int = 200) -> DataFrame:
    """(site, prefix, links, score): groups of links below one path with mostly different texts; links have (site, href, text)."""
    prefix = F.regexp_extract("href", r"^(.*/)[^/]+/?$", 1)
    g = links.where(usable(F.col("href"))).groupBy("site", prefix.alias("prefix")).agg(F.countDistinct("href").alias("n"), F.countDistinct("text").alias("texts"), F.avg(F.length("text")).alias("len"))
    g = g.where(F.col("n").between(low, high) & (F.col("texts") >= 0.7 * F.col("n")) & (F.col("prefix") != ""))
    kw = F.lower("prefix").rlike("categor|industr|director|type|specialt|service").cast("int")
    return g.select("site", "prefix", F.col("n").alias("links"), (F.least("n", F.lit(30)) + 20 * kw + 10 * (F.col("len") < 30).cast("int")).alias("score"))


def nav_filter(links: DataFrame) -> DataFrame:
    """(site, href, pos): the first of each address that could be navigated to.

    Links have (site, pos, href, text). Mail, phone, fragments, documents, the page itself and links without
    a text of at most 200 characters are left out.
    """
    h, n = F.col("href"), F.trim("text")
    bad = h.rlike("^(?:mailto:|tel:|#)") | F.lower(h).rlike(r"\.(?:pdf|docx?|xlsx?|zip)$") | (~h.startswith("javascript:") & (F.regexp_replace(h, "/+$", "") == F.regexp_replace("site", "/+$", "")))
    ok = (h != "") & ~bad & (n != "") & (F.length(n) <= 200)
    return links.where(F.coalesce(ok, F.lit(False))).groupBy("site", "href").agg(F.min("pos").alias("pos"))


def enumerable_params(urls: DataFrame) -> DataFrame:
    """(url, param, kind): parameters that count pages, carry a term or a letter."""
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    e = urls.select("url", F.explode(F.filter(F.split(q, "&"), lambda x: x != "")).alias("kv")).select("url", F.substring_index("kv", "=", 1).alias("param"), F.trim(F.regexp_extract("kv", "=(.*)$", 1)).alias("v")).distinct()
    low = F.lower("param")
    kind = F.when(low.isin(*LETTER_PARAMS) | (low.isin(*TERM_PARAMS) & F.col("v").rlike("^[A-Za-z0-9]$")), "letter").when(low.isin(*PAGE_PARAMS), "page").when(low.isin(*TERM_PARAMS), "term")
    return e.select("url", "param", kind.alias("kind")).where("kind is not null").distinct()


def same_site(base: Column, href: Column) -> Column:
    """Same host or a subdomain of it, ``www.`` aside."""
    a, b = t.host_of(base), t.host_of(href)
    return F.coalesce((a == b) | b.endswith(F.concat(F.lit("."), a)), F.lit(False))
