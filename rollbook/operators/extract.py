"""Values out of texts, requests and payloads, and the plans built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import rules
from rollbook.functions import text as t

# Labels before values, annotations of links, social platforms, sections of a site.
LABELS = r"(?i)^(?:phone|tel|telephone|fax|email|e-mail|website|web|url|address|street address|mailing address|category|type|specialty)\s*:\s*"
ANNOTATIONS = r"(?i)\(\s*link\s+(?:sends\s+e-?mail|is\s+external)\s*\)|\(\s*opens\s+in\s+(?:a\s+)?new\s+(?:tab|window)\s*\)"
SOCIAL = {
    "facebook.com": "facebook", "fb.com": "facebook", "linkedin.com": "linkedin", "twitter.com": "twitter", "x.com": "twitter", "instagram.com": "instagram",
    "youtube.com": "youtube", "tiktok.com": "tiktok", "pinterest.com": "pinterest", "yelp.com": "yelp",
}
SECTIONS = {
    "contact": (["contact", "contact-us", "contactus", "get-in-touch"], ["contact us", "contact", "get in touch", "reach us"]),
    "about": (["about", "about-us", "aboutus", "who-we-are", "our-story", "our-company"], ["about us", "about", "who we are", "our story", "our company", "learn more about"]),
    "team": (["team", "our-team", "staff", "leadership", "people", "meet-the-team"], ["our team", "meet the team", "staff", "leadership", "our people"]),
    "services": (["services", "what-we-do", "our-services", "capabilities", "solutions"], ["services", "what we do", "our services", "capabilities"]),
}
# Trades by registry taxonomy.
TAXONOMIES = {
    "dentist": "Dentist", "dental": "Dentist", "orthodontist": "Orthodontics and Dentofacial Orthopedics", "endodontist": "Endodontics", "periodontist": "Periodontics",
    "oral surgeon": "Oral & Maxillofacial Surgery", "chiropractor": "Chiropractor", "optometrist": "Optometrist", "podiatrist": "Podiatrist",
    "physical therapist": "Physical Therapist", "physical therapy": "Physical Therapist", "occupational therapist": "Occupational Therapist",
    "speech therapist": "Speech-Language Pathologist", "speech language pathologist": "Speech-Language Pathologist", "psychologist": "Psychologist",
    "acupuncturist": "Acupuncturist", "dietitian": "Dietitian, Registered", "audiologist": "Audiologist", "midwife": "Midwife",
    "nurse practitioner": "Nurse Practitioner", "pharmacist": "Pharmacist", "clinical social worker": "Social Worker, Clinical", "naturopath": "Naturopath",
    "massage therapist": "Massage Therapist",
}
SIZE_PARAMS = ["limit", "pagesize", "per_page", "perpage", "size", "count", "rows"]
CURSOR_PARAMS = ["cursor", "pagetoken", "page_token", "after", "continuation", "continuationtoken"]
NOT_STATES = ["PO", "US", "ST", "DR", "RD", "CT", "LN", "PL", "SW", "NW", "NE", "SE"]


def without_label(c: Column) -> Column:
    """Value without a field label in front."""
    return F.regexp_replace(c, LABELS, "")


def without_annotations(c: Column) -> Column:
    """Value without what systems append to link texts."""
    return F.trim(F.regexp_replace(c, ANNOTATIONS, ""))


def phone_phrase(c: Column) -> Column:
    """The number as a quoted search phrase; null unless it has ten digits."""
    d = t.digits(c)
    ok = (F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1"))
    return F.when(ok, F.concat(F.lit('"'), t.phone_format(c), F.lit('"')))


def search_location(c: Column) -> Column:
    """Place words of an address for a search: parts that are no street, box or postcode; else a state code."""
    parts = F.transform(F.split(c, ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    left = F.filter(parts, lambda x: ~x.rlike(r"^\d") & ~x.rlike(r"(?i)^p\.?o\.?\s*box"))
    codes = F.filter(F.regexp_extract_all(c, F.lit(r"\b([A-Z]{2})\b"), F.lit(1)), lambda x: ~x.isin(*NOT_STATES))
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(F.size(left) > 0, F.array_join(left, " ")).otherwise(F.coalesce(F.get(codes, F.lit(0)), F.lit("")))


def social_platform(url: Column) -> Column:
    """Platform of a profile address by exact host or subdomain."""
    h, out = t.host_of(url), F.lit(None).cast("string")
    for d, p in reversed(SOCIAL.items()):
        out = F.when((h == d) | h.endswith("." + d), p).otherwise(out)
    return out


def sections(links: DataFrame) -> DataFrame:
    """(site, section, href): the first link of each site to its contact, about, team and services pages; links have (site, pos, href, text)."""
    path = F.regexp_replace(F.lower(t.path_of(F.col("href"))), "/+$", "")
    hits = []
    for name, (parts, words) in SECTIONS.items():
        hit = t.any_word(path, parts) | t.any_word(F.lower("text"), words)
        hits.append(F.when(F.coalesce(hit, F.lit(False)), F.lit(name)))
    e = links.where(t.host_of(F.col("href")) == t.host_of(F.col("site"))).select("site", "pos", "href", F.explode(F.array_compact(F.array(*hits))).alias("section"))
    return e.groupBy("site", "section").agg(F.min_by("href", F.struct("pos", "href")).alias("href"))


def taxonomy(c: Column) -> Column:
    """Registry taxonomy of a trade: as it is, without a plural s, else the first known trade inside it."""
    s = t.ws(F.lower(c))
    table = F.create_map(*[F.lit(x) for kv in TAXONOMIES.items() for x in kv])
    inside = F.lit(None).cast("string")
    for k, v in reversed(TAXONOMIES.items()):
        inside = F.when(s.contains(k), v).otherwise(inside)
    return F.coalesce(table[s], F.when(s.endswith("s"), table[F.regexp_replace(s, "s$", "")]), inside)


def page_size(url: Column) -> Column:
    """First positive size-like parameter of a request, else 20."""
    kv = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    ns = F.transform(F.filter(kv, lambda x: F.lower(F.substring_index(x, "=", 1)).isin(*SIZE_PARAMS)), lambda x: F.regexp_extract(x, r"=\s*(\d{1,9})\s*$", 1).try_cast("int"))
    return F.coalesce(F.get(F.filter(ns, lambda n: n > 0), F.lit(0)), F.lit(20))


def cursor_param(key: Column, url: Column) -> Column:
    """Request parameter that carries a cursor: one that is there, else derived from the key of the response."""
    names = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    there = F.get(F.filter(names, lambda x: F.lower(x).isin(*CURSOR_PARAMS)), F.lit(0))
    bare = F.regexp_replace(F.replace(F.lower(key), F.lit("-"), F.lit("_")), "^next_?", "")
    return F.coalesce(there, F.when(bare.isin("pagetoken", "page_token"), "pageToken").when(bare.isin("cursor", "endcursor", "page"), "cursor").otherwise(key))


def continuation(payload: Column) -> Column:
    """Handle of the next page in a payload's top level or one below; null at the end."""
    keys = ["next", "nextPage", "next_page", "nextPageToken", "next_page_token", "nextPageUrl", "next_page_url", "cursor", "nextCursor", "next_cursor", "after", "endCursor", "continuation", "continuationToken"]
    at = [F.get_json_object(payload, f"$.{k}") for k in keys] + [F.get_json_object(payload, f"$.{p}.{k}") for p in ("paging", "pageInfo", "meta", "pagination", "links") for k in keys]
    clean = lambda x: F.when((F.trim(x) != "") & ~F.lower(F.trim(x)).isin("0", "false", "true", "null", "none") & ~F.trim(x).rlike(r"^[\[{]"), F.trim(x))
    return F.coalesce(*[clean(x) for x in at])


def with_param(url: Column, name: str, value: Column) -> Column:
    """The address with one query parameter set, the others as they are."""
    q = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: (x != "") & (F.substring_index(x, "=", 1) != name))
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), F.array_join(F.concat(q, F.array(F.concat(F.lit(name + "="), value.cast("string")))), "&"), F.regexp_extract(url, r"(#.*)?$", 1))


def next_requests(captures: DataFrame, cap: int = 30, stretch: float = 1.2) -> DataFrame:
    """(url, page, request): requests that page through captured listings.

    Captures have (url, param, records, expected): a request whose ``param`` counts pages, what it yielded, and
    the total its site states. Pages run until the stated total, stretched a little, is covered, else to the cap.
    """
    size = F.greatest(F.col("records"), F.lit(1))
    pages = F.when(F.col("expected") > 0, F.ceil(F.col("expected") * stretch / size)).otherwise(cap).cast("int")
    p = captures.where("records > 0").withColumn("page", F.explode(F.sequence(F.lit(2), F.greatest(pages, F.lit(2)))))
    q = F.regexp_replace("url", r"([?&])page=\d+", "$1page=")
    return p.where(F.col("page") <= pages).select("url", "page", F.regexp_replace(q, "page=", F.concat(F.lit("page="), F.col("page").cast("string"))).alias("request"))


def queries_of_plan(plans: DataFrame) -> DataFrame:
    """(plan, query): a plan's own queries and up to three for its platforms; plans have (plan, queries, platforms, industry)."""
    dork = lambda p: F.when(p.contains("."), F.concat(F.lit("site:"), p, F.lit(" "), F.col("industry"))).when(F.col("industry") != "", F.concat(F.lit("site:"), p, F.lit("app.com "), F.col("industry"))).otherwise("")
    every = F.concat("queries", F.transform(F.slice("platforms", 1, 3), lambda p: F.trim(dork(p))))
    return plans.select("plan", F.posexplode(F.filter(every, lambda x: F.trim(x) != "")).alias("pos", "query"))


def shallow(records: DataFrame) -> DataFrame:
    """(site, shallow): fewer than a fifth of the records carry anything to reach the firm by."""
    f = lambda c: F.coalesce(t.filled(F.trim(c)), F.lit(False))
    hit = f("phone") | f("website") | f("fax") | f("street_address")
    return records.groupBy(F.col("source_url").alias("site")).agg((F.avg(hit.cast("int")) < 0.2).alias("shallow"))


def many_entries(docs: DataFrame) -> DataFrame:
    """(doc_id, phones): different numbers (last ten digits) in texts; three or more speak for a listing."""
    rx = r"(?<!\d)(?:\+?1[\s.\-]?)?(?:\(\d{3}\)[\s.\-]?|\d{3}[\s.\-])\d{3}[\s.\-]?\d{4}(?!\d)"
    nums = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(rx), F.lit(0)), lambda x: F.substring(F.regexp_replace(x, r"\D", ""), -10, 10)))
    return docs.select("doc_id", F.size(nums).alias("phones"))


def starts_with(names: DataFrame) -> DataFrame:
    """(site, letter, prefix_search): of results to a one-letter search, over 80 % begin with it; names have (site, letter, name)."""
    ok = names.where(F.length("name").between(3, 199))
    return ok.groupBy("site", "letter").agg(((F.count("*") >= 3) & (F.avg(F.lower("name").startswith(F.col("letter")).cast("int")) > 0.8)).alias("prefix_search"))


def count_evidence(notes: DataFrame) -> DataFrame:
    """(site, expected, observed): largest stated totals and observed counts."""
    return notes.groupBy("site").agg(F.max("expected").alias("expected"), F.max("observed").alias("observed"))


def needs_enrichment(members: DataFrame) -> DataFrame:
    """(member_id, needs): no website, or one but no description, phone or mailbox."""
    f = lambda c: F.coalesce(t.filled(F.col(c)), F.lit(False))
    mail = F.coalesce(F.exists("contacts", lambda x: F.coalesce(x["email"] != "", F.lit(False))), F.lit(False))
    site = F.coalesce(F.trim("website") != "", F.lit(False))
    return members.select("member_id", (~site | ~(f("description") & f("phone") & mail)).alias("needs"))


def dump_catalog(dumps: DataFrame) -> DataFrame:
    """(file_name, members, no_phone, no_website): structured dumps with their missing fields."""
    body = F.regexp_replace("body", r"^[\ufeff\s]+", "")
    rec = "array<struct<phone:string,website:string>>"
    ms = F.when(body.startswith("["), F.from_json(body, rec)).otherwise(F.from_json(F.get_json_object(body, "$.members"), rec))
    miss = lambda f: F.size(F.filter("m", lambda x: F.coalesce(x[f], F.lit("")) == ""))
    d = dumps.where(F.col("file_name").endswith("_structured.json") & ~F.col("file_name").contains("_detail_structured")).select("dump_id", "file_name", ms.alias("m")).where("m is not null")
    return d.select("dump_id", "file_name", F.size("m").alias("members"), miss("phone").alias("no_phone"), miss("website").alias("no_website"))


def registry_pages(rows: DataFrame, page: int = 200, ceiling: int = 1000) -> DataFrame:
    """(query, rows, hit_ceiling): rows that a paged registry yields per query before its ceiling; rows have (query, id)."""
    g = rows.groupBy("query").agg(F.countDistinct("id").alias("n"))
    most = ceiling + page
    return g.select("query", F.least("n", F.lit(most)).alias("rows"), (F.col("n") > most).alias("hit_ceiling"))


# Classes that only stripe rows, inputs that name no goal, phrases of a sign-in page, words of directory data.
ZEBRA = ["odd", "even", "alt", "alternate", "alternating", "stripe", "striped", "zebra", "row0", "row1", "row2"]
TRIVIAL = ["hi", "hello", "hey", "yo", "sup", "test", "testing", "hello world", "what", "huh", "ok", "okay", "help", "thanks", "thank you", "bye", "yes", "no"]
SIGN_IN = ["sign in", "log in", "login", "username", "members only", "member login", "member sign in", "forgot password", "forgot your password", "click here for login", "portal login"]
DIRECTORY_WORDS = [
    "member", "user", "directory", "contact", "company", "listing", "organization", "vendor", "supplier", "contractor", "provider", "business", "firm", "result",
    "roster", "doctor", "physician", "dentist", "attorney", "lawyer", "restaurant", "clinic", "specialist", "consultant", "therapist",
]


def striped(c: Column) -> Column:
    """A class string of nothing but stripes."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*ZEBRA))


def trivial(c: Column) -> Column:
    """An input that names no goal."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"^[?.!,'\" ]+|[?.!,'\" ]+$", "")
    return (F.length(s) < 2) | s.isin(*TRIVIAL)


def sign_in_page(html: Column) -> Column:
    """A password field and at least two phrases of a sign-in page."""
    low = F.lower(html)
    return low.rlike("type=[\"']password[\"']") & (sum(low.contains(p).cast("int") for p in SIGN_IN) >= 2)


def plurals(words: Column) -> Column:
    """A word and its plural."""
    many = F.when(words.rlike("[aeiou]y$"), F.concat(words, F.lit("s"))).when(words.rlike(".y$"), F.concat(F.regexp_replace(words, "y$", ""), F.lit("ies"))).when(words.endswith("s"), F.concat(words, F.lit("es"))).otherwise(F.concat(words, F.lit("s")))
    return F.array(words, many)


def panel_html(c: Column) -> Column:
    """The page part of a partial update ``length|#||type|length|updatePanel|id|html``; the text itself if it has no such form."""
    p = F.split(c, r"\|", 8)
    return F.when(F.size(p) >= 8, p[7]).otherwise(c)


def unwrapped(href: Column) -> Column:
    """Target of a search result's redirect; null where there is none."""
    uddg = F.regexp_extract(href, r"uddg=([^&]*)", 1)
    b64 = F.translate(F.regexp_extract(href, r"^https://www\.bing\.com/ck/.*[?&]u=a1([A-Za-z0-9_-]+)", 1), "-_", "+/")
    padded = F.rpad(b64, (F.ceil(F.length(b64) / 4) * 4).cast("int"), "=")
    return F.when(uddg != "", F.try_url_decode(uddg)).when(b64 != "", F.decode(F.unbase64(padded), "utf-8")).when(href.startswith("http") & ~href.startswith("https://www.bing.com/ck/"), href)


def resolved(base: Column, href: Column) -> Column:
    """Absolute address of a link on a page; null for other schemes."""
    root, folder = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    out = F.when(href.rlike("(?i)^(?:mailto:|tel:|javascript:|#|data:|blob:)") | (href == ""), None).when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href))
    return out.when(href.rlike("^[a-z][a-z0-9+.-]*:"), None).when(href.startswith("/"), F.concat(root, href)).when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href)).otherwise(F.concat(folder, href))


def registry_address(line: Column, more: Column, city: Column, state: Column, code: Column) -> Column:
    """Parts of a registry address that are there, in one line."""
    tail = F.trim(F.concat_ws(" ", F.trim(state), F.trim(code)))
    return t.null_if_empty(F.concat_ws(", ", *[t.null_if_empty(F.trim(c)) for c in (line, more, city)], t.null_if_empty(tail)))


def head_tail(c: Column, n: int = 1000) -> Column:
    """First and last characters of a long text, blanks collapsed."""
    s = t.ws(c)
    return F.when(F.length(s) <= 2 * n, s).otherwise(F.concat(F.substring(s, 1, n), F.lit(" … "), F.substring(s, -n, n)))


def stayed(start: Column, now: Column) -> Column:
    """Still on the listing: the same path, a numbered page below it, or at most one segment below its parent."""
    a, b = F.regexp_replace(t.path_of(start), "/+$", ""), F.regexp_replace(t.path_of(now), "/+$", "")
    parent = F.regexp_replace(a, "/[^/]*$", "")
    below = F.regexp_replace(F.substring(b, F.length(parent) + 1, F.lit(10_000)), "^/+|/+$", "")
    depth = F.when(below == "", 0).otherwise(F.size(F.split(below, "/")))
    page = b.startswith(F.concat(a, F.lit("/"))) & F.regexp_extract(b, "([^/]*)$", 1).rlike(r"(?i)(?:page|pg)[-_]?\d+$")
    return (a == "") | (a == b) | page | F.when(parent == "", b.startswith(F.concat(a, F.lit("/")))).otherwise(b.startswith(parent) & (depth <= 1))
