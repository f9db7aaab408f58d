"""Decisions on records, pages, plans and runs: rules on columns, picks as aggregates, nothing collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import rules
from rollbook.functions import text as t
from rollbook.operators import extract

# Phrases around a search box that speak for and against a member search, texts of its button, names of its field.
SEARCH_FOR = [
    "member directory", "find a member", "search members", "member search", "find a doctor", "doctor search", "physician directory", "physician search", "find an attorney",
    "attorney search", "lawyer directory", "find a restaurant", "restaurant search", "find a provider", "provider directory", "provider search", "company search",
    "business directory", "business search", "search by name", "search by company", "search by keyword", "browse members", "member listing", "directory search",
    "find a dentist", "dentist search", "clinic search", "search our directory", "search the directory",
]
SEARCH_AGAINST = [
    "newsletter", "subscribe", "email signup", "join our mailing list", "enter your email", "sign up for", "signup", "username", "password", "sign in", "log in", "login",
    "forgot password", "forgot your password", "remember me", "contact us", "send message", "get in touch", "your message", "search site", "search website", "search blog",
    "search articles", "search products", "search shop", "product search", "request a quote", "get a quote", "request quote", "register", "create account", "new account",
]
BUTTON_FOR = ["search", "find", "continue", "go", "submit", "search directory", "find members", "find a member", "find a doctor", "find an attorney"]
BUTTON_AGAINST = ["send", "subscribe", "sign up", "signup", "sign in", "log in", "login", "register", "contact", "reset password", "request quote", "get quote"]
FIELD_FOR = ["search", "find", "keyword", "directory", "member", "company", "doctor", "provider", "attorney", "restaurant"]
# Parts of a path that lead to a directory.
LANDING_PATHS = [
    "/member-directory", "/memberdirectory", "/members", "/member-search", "/membersearch", "/directory", "/find-a-", "/findadoctor", "/find-doctor", "/provider-search",
    "/providersearch", "/member-list", "/memberlist", "/search-members", "/searchmembers", "/browse",
]
LANDING_TEXT = r"(?i)\bmember\s+directory\b|\bmember\s+search\b|\bmember\s+list(?:ing)?\b|\bfind\s+an?\s+\w+|\bbrowse\s+members?\b|\bour\s+members?\b|\bsearch\s+(?:the\s+)?directory\b|\bdirectory\s+search\b|\bprovider\s+search\b"


def _any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def has_data_roles(roles: Column) -> Column:
    """A schema that finds more than names and links; one of these alone is a list of links."""
    return F.exists(roles, lambda r: ~r.isin("identity", "url"))


def search_score(context: Column, button: Column, field: Column) -> Column:
    """How likely an input searches members: +15 once for a phrase that speaks for it, -15 for each against it
    (a phrase inside a longer one counts once), the button +5 and -15, the field's own names +5."""
    hits = F.filter(F.array(*map(F.lit, SEARCH_AGAINST)), lambda p: F.contains(context, p))
    against = F.size(F.filter(hits, lambda p: ~F.exists(hits, lambda q: (q != p) & F.contains(q, p))))
    points = lambda c, n: F.when(c, n).otherwise(0)
    return points(_any(context, SEARCH_FOR), 15) - 15 * against + points(_any(button, BUTTON_FOR), 5) - points(_any(button, BUTTON_AGAINST), 15) + points(_any(field, FIELD_FOR), 5)


def page_class(hard_skip: Column, text: Column, js: Column, cards: Column, landing: Column, many: Column, contact: Column) -> Column:
    """DIRECTORY, WEBSITE or REJECT with the reason, by the first fact that decides."""
    return (
        F.when(hard_skip, "REJECT hard_skip").when(text.isNull(), "REJECT no_page").when(js, "DIRECTORY rendered").when(cards, "DIRECTORY cards")
        .when(landing, "DIRECTORY landing").when(many, "DIRECTORY entries").when(contact, "WEBSITE").otherwise("REJECT no_contact")
    )


def enumeration_useful(pages: DataFrame) -> DataFrame:
    """(site, sampled, useful) of pages (site, pos, signal, big, cards): two of the first eight pages have a signal, and
    half of the big ones among the first six (two at least) have cards."""
    first = F.row_number().over(Window.partitionBy("site").orderBy("pos"))
    p = pages.withColumn("r", first).where("r <= 8")  # limited per site before the shuffle
    checked = F.count_if((F.col("r") <= 6) & F.col("big"))
    carded = F.count_if((F.col("r") <= 6) & F.col("big") & F.col("cards"))
    need = F.when(checked > 0, F.greatest(F.lit(2), F.floor(checked * 0.5 + 0.5))).otherwise(1)
    return p.groupBy("site").agg(F.count("*").alias("sampled"), ((F.count_if("signal") >= 2) & (carded >= need)).alias("useful"))


def registry_best(records: DataFrame, results: DataFrame) -> DataFrame:
    """(id, npi): of the results (key, pos, npi, taxonomy) for a record (id, key, hint) the first whose taxonomy has a
    word of the hint with more than three letters, else the first."""
    words = F.filter(F.split(F.lower(F.coalesce("hint", F.lit(""))), r"\s+"), lambda w: F.length(w) > 3)
    miss = ~F.exists(words, lambda w: F.contains(F.lower(F.coalesce("taxonomy", F.lit(""))), w))
    return records.join(results, "key").groupBy("id").agg(F.min_by("npi", F.struct(miss, "pos")).alias("npi"))


def preferred_pick(results: DataFrame, domains: DataFrame) -> DataFrame:
    """(id, href): of results (id, query_idx, rank, href) the first among the first five of each query, queries in
    order, whose host is one of ``domains`` (domain) or below it."""
    host = F.regexp_replace(F.lower(F.regexp_extract("href", r"^https?://([^/?#:]+)", 1)), r"^www\.", "")
    parts = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = results.where("rank < 5").select("id", "query_idx", "rank", "href", F.explode(tails).alias("domain"))
    return each.join(domains, "domain", "left_semi").groupBy("id").agg(F.min_by("href", F.struct("query_idx", "rank", "href")).alias("href"))


def landing_links(links: DataFrame) -> DataFrame:
    """(site, href): the first link of each site whose text or path leads to a directory."""
    low = F.lower("href")
    path = t.path_of(low)
    fits = ~low.rlike(r"^(?:mailto:|tel:|#|javascript:)") & (F.coalesce(F.col("text").rlike(LANDING_TEXT), F.lit(False)) | _any(path, LANDING_PATHS))
    return links.where(fits).groupBy("site").agg(F.min_by(low, F.struct("pos", "href")).alias("href"))


def partition_choice(options: Column, matched: Column, narrowing: Column, unfiltered: Column) -> Column:
    """What to do with a form: enumerate the options that match the intent (a strict subset), leave a known narrowing
    filter, find out that it narrows, or enumerate all."""
    return F.when((matched > 0) & (matched < options), "intent").when(narrowing, "defer").when(unfiltered >= 5, "narrowing").otherwise("enumerate")


def stale(had_selector: Column, live: Column, url: Column, was_url: Column, size: Column, was_size: Column) -> Column:
    """A page profile to derive again: its selector finds fewer than three, or without one the page moved or grew or shrank by over a fifth."""
    changed = (url != was_url) | (F.abs(size - was_size) / F.greatest(was_size, F.lit(1)) > 0.2)
    return F.when(live >= 3, False).when(had_selector, True).otherwise(changed)


def plan_normal(queries: Column, question: Column, options: Column, ambiguous: Column, api: Column, coverage: Column) -> list[Column]:
    """fallback, ambiguous, options, api, coverage of a search plan as it may be used."""
    two = F.coalesce(F.size(options) == 2, F.lit(False))
    low = F.lower(coverage)
    return [
        (F.coalesce(F.size(queries), F.lit(0)) <= 0).alias("fallback"), (F.coalesce(ambiguous, F.lit(False)) & (F.trim(F.coalesce(question, F.lit(""))) != "") & two).alias("ambiguous"),
        F.when(two, options).otherwise(F.array().cast("array<string>")).alias("options"), F.when(api == "npi", api).alias("api"), F.when(low.isin("all", "targeted"), low).otherwise("targeted").alias("coverage"),
    ]


def intent_flat(actionable: Column, coverage: Column, canonical: Column, aliases: Column, scope: Column) -> Column:
    """The intent of a plan as one struct; null where there is nothing to narrow by."""
    name = F.trim(F.coalesce(canonical, F.lit("")))
    kept = F.filter(F.transform(aliases, lambda a: F.trim(F.coalesce(a, F.lit("")))), lambda a: a != "")
    breadth = F.lower(F.coalesce(scope, F.lit("inclusive")))
    ok = F.coalesce(actionable, F.lit(False)) & (F.lower(F.coalesce(coverage, F.lit("targeted"))) != "all") & (name != "")
    return F.when(ok, F.struct(name.alias("canonical"), kept.alias("aliases"), F.when(breadth.isin("specialist", "inclusive"), breadth).otherwise("inclusive").alias("scope")))


def api_route(term: Column, state: Column) -> Column:
    """``taxonomy|STATE`` where a registry can serve the term: it names a taxonomy and the state has two letters."""
    st = F.upper(F.trim(F.coalesce(state, F.lit(""))))
    name = extract.taxonomy(term)
    return F.when(st.rlike(r"^[A-Z]{2}$") & name.isNotNull(), F.concat(name, F.lit("|"), st))


def page_signals(text: Column, phone: Column, emails: Column, address: Column, words: Column, heading: Column) -> list[Column]:
    """has_phone, has_email, has_location, has_name: what of a record a page shows."""
    low = F.lower(F.coalesce(text, F.lit("")))
    d = t.digits(phone)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    place = F.filter(F.split(F.lower(extract.search_location(address)), " "), lambda w: w != "")
    mail = F.exists(emails, lambda e: F.contains(e, F.lit("@")) & ~F.substring_index(e, "@", -1).isin(*rules.FREE_MAIL) & F.contains(low, e))
    return [
        F.coalesce((F.length(d) == 10) & F.contains(t.digits(text), d), F.lit(False)).alias("has_phone"), F.coalesce(mail, F.lit(False)).alias("has_email"),
        F.coalesce((F.size(place) >= 2) & F.forall(place, lambda w: F.contains(low, w)), F.lit(False)).alias("has_location"),
        F.coalesce(F.exists(words, lambda w: (F.length(w) >= 4) & F.contains(F.lower(heading), w)), F.lit(False)).alias("has_name"),
    ]


def richest(entities: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, order, n): the entity of each key with most fields, the first on a tie."""
    n = sum((F.when(t.filled(F.col(f)), 1).otherwise(0) for f in fields), F.lit(0))
    best = entities.select(key, order, n.alias("n")).groupBy(key).agg(F.max_by(F.struct(order, "n"), F.struct("n", F.negative(order))).alias("b"))
    return best.select(key, f"b.{order}", "b.n")


def alphabet_plan(counts: DataFrame) -> DataFrame:
    """(site, letter, n, paginate): queries a to z and 0 to 9 that find something, from (site, letter, n); from eight on they have pages."""
    known = counts.where(F.col("letter").rlike("^[a-z0-9]$") & (F.col("n") > 0))
    return known.select("site", "letter", "n", (F.col("n") >= 8).alias("paginate"))


def picked(reply: Column, n: Column, cap: int) -> Column:
    """Numbers from 1 to ``n`` that a reply ``{"keep": [...]}`` names, once each and at most ``cap``; all where it can't be read."""
    keep = F.from_json(reply, "keep array<int>")["keep"]
    ok = F.slice(F.array_distinct(F.filter(keep, lambda i: (i >= 1) & (i <= n))), 1, cap)
    return F.when(keep.isNotNull(), ok).otherwise(F.sequence(F.lit(1), n))


def longest_words(words: Column, most: int = 4) -> Column:
    """The longest words, the first on a tie."""
    keyed = F.transform(words, lambda w, i: F.struct(F.negative(F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: x["w"])


def search_cascade(name: Column, location: Column, category: Column, words: Column, phone: Column) -> Column:
    """Queries in order: the exact name with place and category, the longest words with them, the phone number."""
    short = F.when(F.length(category) < 40, category)
    clean = F.trim(F.regexp_replace(name, '"', ""))
    q1 = F.concat_ws(" ", F.when(clean != "", F.concat(F.lit('"'), clean, F.lit('"'))), F.nullif(location, F.lit("")), F.nullif(short, F.lit("")))
    q2 = F.concat_ws(" ", longest_words(words), F.nullif(location, F.lit("")), F.nullif(short, F.lit("")))
    return F.array_compact(F.array(F.nullif(q1, F.lit("")), F.when((q2 != "") & (q2 != q1), q2), extract.phone_phrase(phone)))


def first_match(results: DataFrame, most: int = 3) -> DataFrame:
    """(id, query_idx, href): the match of the first query that has one, from (id, query_idx, rank, href)."""
    return results.where(F.col("query_idx") < most).groupBy("id").agg(F.min_by(F.struct("query_idx", "href"), F.struct("query_idx", "rank", "href")).alias("m")).select("id", "m.*")


def batch_rows(links: DataFrame, counts: DataFrame) -> DataFrame:
    """(index, link, success, records, error) of links (index, raw) against records found per link (link, records); a
    bad address is a failed row."""
    link = t.url_clean(F.col("raw"))
    rows = links.where(F.coalesce(F.trim("raw"), F.lit("")) != "").withColumn("link", link).join(counts, "link", "left")
    n = F.coalesce("records", F.lit(0))
    return rows.select("index", F.coalesce("link", "raw").alias("link"), (n > 0).alias("success"), n.alias("records"), F.when(F.col("link").isNull(), "bad address").alias("error"))


def detail_urls(records: DataFrame) -> DataFrame:
    """(site, uid, url): pages of the records of shallow lists, from (site, pos, uid, contact): fewer than a fifth of the
    first twenty records have contact data."""
    first = records.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).where("r <= 20")
    shallow = first.groupBy("site").agg(F.avg(F.col("contact").cast("int")).alias("share")).where("share < 0.2").select("site")
    uids = records.join(shallow, "site", "left_semi").where("uid is not null").select("site", "uid").distinct()
    return uids.select("site", "uid", F.concat(F.regexp_replace(F.substring_index("site", "#", 1), "/+$", ""), F.lit("#!biz/id/"), F.col("uid").cast("string")).alias("url"))


def crawl_choice(wanted: Column, crawlable: Column, missing: Column, name_only: Column, intent: Column) -> Column:
    """Whether to read detail pages: yes without wishes or for bare names with an intent; no where they can't help; else ask."""
    bare = name_only >= rules.NAME_ONLY_TRIGGER
    return (
        F.when(wanted == 0, "crawl: everything").when(bare & intent, "crawl: names only").when((crawlable == 0) & ~bare, "skip: not on pages")
        .when((missing == 0) & ~bare, "skip: found already").otherwise("ask")
    )


def page_choice(needs_navigation: Column, url: Column, landing: Column, aggregators: list[str]) -> list[Column]:
    """mode and hint: navigate where the page needs it or belongs to an aggregator; a landing link only on the same site."""
    agg = t.in_domains(t.host_of(url), aggregators)
    same = t.host_root(t.host_of(url)) == t.host_root(t.host_of(landing))
    return [F.when(needs_navigation | agg, "auto").otherwise("direct").alias("mode"), F.when(same & ~agg, landing).alias("hint")]


def dump_name(industry: Column, states: Column) -> Column:
    """File name of a run: the industry in up to 40 characters, and up to three states."""
    slug = F.substring(F.replace(F.coalesce(F.nullif(industry, F.lit("")), F.lit("results")), F.lit(" "), F.lit("_")), 1, 40)
    return F.concat_ws("_", slug, F.filter(F.slice(F.coalesce(states, F.array()), 1, 3), lambda s: s != ""))


# Messages that a feed leaves out, and how it words others.
QUIET = r"(?i)^AI says: (?:STAY|NONE)|^RESPONSE: \[|^Now on:|^Current URL:|^Depth |^Idle timer|^Timer |^Waiting for|^Page text sample"
WORDED = [
    (r"(?i)^JSON member list from .+?: (\d+) entries", "→ Captured {} member records (JSON)"), (r"(?i)^Extracted (\d+) members", "→ Extracted {} members"), (r"(?i)^Pagination.*page (\d+)", "→ Page {}..."),
    (r"(?i)^Scroll.*?(\d+) results", "→ Scrolling... {} results found"), (r"(?i)^Trying '(.+?)'", '→ Searching: "{}"'), (r"(?i)^Saving (\d+)", "→ Saving {} records..."),
    (r"(?i)^\[403\] (.+)", "⚠ Blocked (403): {} — retrying"), (r"(?i)^\[429\] (.+)", "⚠ Rate limited (429): {}"), (r"(?i)^Done! (\d+) records", "✓ Done — {} records processed"),
]


def feed_line(message: Column) -> Column:
    """A run's message as the feed shows it; null where it is left out. The first rule that fits words it."""
    s = F.trim(message)
    out = F.when((F.length(s) < 3) | s.rlike(QUIET), None)
    for rx, form in WORDED:
        before, after = form.split("{}")
        out = out.when(s.rlike(rx), F.concat(F.lit(before), F.regexp_extract(s, rx, 1), F.lit(after)))
    return out.otherwise(s)


def body_fields(body: Column) -> Column:
    """The scalar fields of a request body (JSON object or form) as a map of strings; empty where it can't be read."""
    s = F.trim(F.coalesce(body, F.lit("")))
    as_json = F.map_filter(F.from_json(s, "map<string,string>"), lambda k, v: v.isNotNull() & ~v.rlike(r"^[{\[]"))
    pairs = F.filter(F.split(s, "&"), lambda p: p.contains("="))
    word = lambda c: F.try_url_decode(c)
    entries = F.transform(pairs, lambda p: F.struct(word(F.substring_index(p, "=", 1)).alias("k"), word(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda o: o["k"] == e["k"]))
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(s.rlike(r"^[{\[]"), as_json).otherwise(F.map_from_entries(first)), empty)


def trace_entry(kind: str, category: Column, message: Column, at: Column, began: Column, reason: Column | None = None, seconds: Column | None = None) -> list[Column]:
    """time, kind, category, level, message, decision, reason, duration_s of one entry of a run's trace."""
    none = F.lit(None).cast("string")
    why = F.nullif(reason, F.lit("")) if reason is not None else none
    said = F.concat(F.lit("DECISION: "), message, F.coalesce(F.concat(F.lit(" — "), why), F.lit(""))) if kind == "decision" else message
    return [
        F.round((F.unix_micros(at) - F.unix_micros(began)) / 1e6, 2).alias("time"), F.lit(kind).alias("kind"), category.alias("category"), F.lit("info").alias("level"), said.alias("message"),
        (message if kind == "decision" else none).alias("decision"), why.alias("reason"), (F.round(seconds, 2) if seconds is not None else F.lit(None).cast("double")).alias("duration_s"),
    ]


def passed_through(counts: DataFrame, directories: DataFrame) -> DataFrame:
    """(source_url, records, skipped, enriched): records of other things than businesses go on as they are and count as not enriched."""
    other = F.coalesce(F.col("entity_type") != "business", F.lit(False))
    d = counts.join(directories.select("source_url", "entity_type"), "source_url", "left")
    return d.select("source_url", "records", other.alias("skipped"), F.when(other, 0).otherwise(F.col("enriched")).alias("enriched"))
