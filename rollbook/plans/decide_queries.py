"""Queries of the decisions on records, pages, plans and runs, with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import rules
from rollbook.functions import text as t
from rollbook.operators import decide, drift, extract, intent
from rollbook.plans import extract_queries, record_queries, web_queries
from rollbook.work import load


def _m(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "members")


def _one(*make):
    return lambda s, d: _m(s, d).select("member_id", *[c for f in make for c in (f() if isinstance(f(), list) else [f()])])


def _roles() -> F.Column:
    each = [("company_name", "identity"), ("website", "url"), ("phone", "phone"), ("street_address", "location"), ("category", "category")]
    return F.array_compact(F.array(*[F.when(t.filled(F.col(c)), F.lit(r)) for c, r in each]))


_PHONES = web_queries._PHONE
_MAIL = web_queries._EMAIL


def _facts(s, d):
    """Documents as pages: distinct phone numbers, mail, size, texts that lead to a directory."""
    docs = load(s, d, "documents")
    tails = F.transform(F.regexp_extract_all("text", F.lit(f"({_PHONES})"), F.lit(1)), lambda p: F.right(F.regexp_replace(p, "[^0-9]", ""), F.lit(10)))
    return docs.withColumn("phones", F.coalesce(F.size(F.array_distinct(tails)), F.lit(0))).withColumn("mail", F.coalesce(F.col("text").rlike(_MAIL), F.lit(False)))


def _pages(s, d):
    low = F.lower("text")
    words = sum((low.contains(w).cast("int") for w in ("member", "directory", "contact", "phone")), F.lit(0))
    p = _facts(s, d).where("site is not null and text is not null and length(text) > 0")
    big = F.length("text") >= 300
    return p.select("site", F.col("doc_id").alias("pos"), ((F.col("phones") > 0) | F.col("mail") | (big & (words >= 2))).alias("signal"), big.alias("big"), (F.col("phones") >= 1).alias("cards"))


def _registry(s, d):
    key = lambda c: F.lower(t.ws(F.col(c)))
    recs = _m(s, d).where("company_name is not null").select(F.col("member_id").alias("id"), key("company_name").alias("key"), F.col("category").alias("hint"))
    res = load(s, d, "registry_members").where("company_name is not null").select(key("company_name").alias("key"), F.col("npi").alias("pos"), "npi", F.col("category").alias("taxonomy"))
    return decide.registry_best(recs, res)


def _results(s, d):
    h = _m(s, d).where("website is not null")
    return h.select((F.col("member_id") % 400).alias("id"), (F.col("member_id") % 3).cast("int").alias("query_idx"), (F.floor(F.col("member_id") / 400) % 12).alias("rank"), F.col("website").alias("href"))


def _preferred(s, d):
    dom = load(s, d, "directories").select(F.regexp_replace(t.host_of(F.col("source_url")), r"^www\.", "").alias("domain")).where("domain is not null").distinct()
    return decide.preferred_pick(_results(s, d), dom)


def _links(s, d):
    m = _m(s, d).where("source_url is not null and company_name is not null")
    return m.select(F.lower(F.substring("company_name", 1, 1)).alias("site"), F.col("member_id").alias("pos"), F.col("category").alias("text"), F.col("source_url").alias("href"))


def _forms(s, d):
    m = _m(s, d).where("source_url is not null").groupBy("source_url").agg(F.countDistinct("category").alias("options"), F.countDistinct(F.when(F.col("category").rlike("(?i)dent|roof"), F.col("category"))).alias("matched"), F.count("*").alias("cards"))
    return m.join(load(s, d, "directories"), "source_url").select("source_url", decide.partition_choice(F.col("options"), F.col("matched"), F.col("expected_count").isNull(), F.col("cards")).alias("choice"))


def _profiles(s, d):
    v = load(s, d, "documents").where("site is not null and fetched_at is not null").select("doc_id", "site", "fetched_at", "page_url", "n_chars", (F.col("doc_id") % 5).alias("live"))
    v = v.where("page_url is not null and n_chars is not null")
    p = drift._before(v, "site", ["fetched_at", "doc_id"], ["page_url", "n_chars", "live"]).where("prev is not null")
    return p.select("doc_id", decide.stale(F.col("prev.live") >= 3, F.col("live"), F.col("page_url"), F.col("prev.page_url"), F.col("n_chars"), F.col("prev.n_chars")).alias("stale"))


def _customers(s, d):
    c = load(s, d, "customer")
    return c.withColumn("words", F.split("c_name", "#"))


def _plans(s, d):
    c = _customers(s, d)
    opts = F.when(F.col("c_nationkey") % 4 < 3, F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (F.col("c_nationkey") % 4 + 1).cast("int")))
    api = F.when(F.col("c_mktsegment") == "BUILDING", "npi").otherwise(F.lower("c_mktsegment"))
    cover = F.when(F.col("c_custkey") % 3 == 0, "ALL").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    return c.select("c_custkey", *decide.plan_normal(F.when(F.col("c_acctbal") > 0, F.array("c_name")), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).otherwise(F.lit(" ")), opts, F.col("c_acctbal") < 5000, api, cover))


def _intents(s, d):
    c = _customers(s, d)
    got = decide.intent_flat(F.col("c_acctbal") > 0, F.when(F.col("c_custkey") % 4 == 0, F.lit("All")), F.concat(F.lit(" "), F.lower("c_mktsegment")), F.array(F.lit(" "), F.col("c_name"), F.lit(None).cast("string")), F.when(F.col("c_custkey") % 3 == 0, "Specialist").when(F.col("c_custkey") % 3 == 1, "wide"))
    return c.select("c_custkey", got["canonical"].alias("canonical"), F.array_join(got["aliases"], "|").alias("aliases"), got["scope"].alias("scope"))


def _signals(s, d):
    """Each document against the member of its number."""
    m = _m(s, d).select(F.col("member_id").alias("doc_id"), "phone", "street_address", "company_name", F.transform(F.filter("contacts", lambda c: c["email"].isNotNull()), lambda c: F.lower(F.trim(c["email"]))).alias("emails"))
    j = load(s, d, "documents").select("doc_id", "text").join(m, "doc_id")
    return j.select("doc_id", *decide.page_signals(F.col("text"), F.col("phone"), F.col("emails"), F.col("street_address"), t.company_words(F.col("company_name")), F.substring("text", 1, 80)))


def _letters(s, d):
    m = _m(s, d).where("source_url is not null and company_name is not null")
    return decide.alphabet_plan(m.groupBy(F.col("source_url").alias("site"), F.lower(F.substring("company_name", 1, 1)).alias("letter")).agg(F.count("*").alias("n")))


_REPLY = "case when member_id % 7 = 0 then '[oops' when member_id % 7 = 1 then '{\"other\": 1}' else concat('{\"keep\": [', member_id % 9, ', ', member_id % 5, ', ', member_id % 9, ', ', member_id % 4 + 1, ']}') end"


def _cascade(s, d):
    q = decide.search_cascade(F.col("company_name"), extract.search_location(F.col("street_address")), F.col("category"), t.company_words(F.col("company_name")), F.col("phone"))
    return _m(s, d).where("company_name is not null").select("member_id", F.posexplode(q).alias("attempt", "query"))


def _batch(s, d):
    counts = _m(s, d).where("source_url is not null").groupBy(t.url_clean(F.col("source_url")).alias("link")).agg(F.count("*").alias("records"))
    links = _m(s, d).select(F.col("member_id").alias("index"), F.when(F.col("member_id") % 3 == 0, F.col("source_url")).otherwise(F.col("website")).alias("raw"))
    return decide.batch_rows(links, counts)


def _uids(s, d):
    m = _m(s, d).where("source_url is not null")
    return decide.detail_urls(m.select(F.col("source_url").alias("site"), F.col("member_id").alias("pos"), F.when(F.col("member_id") % 3 > 0, F.floor(F.col("member_id") / 2)).alias("uid"), t.filled(F.col("fax")).alias("contact")))


def _crawls(s, d):
    m = _m(s, d).where("source_url is not null").groupBy("source_url").agg(
        F.avg((~t.filled(F.col("fax")) & ~t.filled(F.col("founded"))).cast("int")).alias("name_only"), F.countDistinct("category").alias("k"), F.count("*").alias("n")
    )
    return m.select("source_url", decide.crawl_choice(F.col("k") % 4, F.col("k") % 3, F.col("n") % 3, F.round("name_only", 6), F.col("n") % 2 == 0).alias("choice"))


def _modes(s, d):
    p = _facts(s, d).where("page_url is not null")
    landing = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://"), "site", F.lit("/members"))).otherwise("https://elsewhere.example/members")
    return p.select("doc_id", *decide.page_choice(F.col("phones") == 0, F.col("page_url"), landing, ["yelp.com"]))


def _names(s, d):
    st = F.upper(F.regexp_extract("street_address", r",\s*([A-Za-z]{2})\s+\d{5}", 1))
    m = _m(s, d).where("category is not null").select("category", F.nullif(st, F.lit("")).alias("st"))
    g = m.groupBy("category").agg(F.array_sort(F.collect_set("st")).alias("states"))  # states are few
    return g.select("category", decide.dump_name(F.lower("category"), F.col("states")).alias("name"))


_LINES = [
    "concat('Saving ', member_id, ' members')", "concat('  Depth ', member_id)", "concat('[403] ', coalesce(website, 'nowhere'))", "concat('Trying ''', coalesce(category, 'all'), '''')",
    "concat('Pagination: at page ', member_id % 40)", "coalesce(company_name, '')", "concat('Done! ', member_id, ' records')",
]
_LINE = "case member_id % 7 " + " ".join(f"when {i} then {x}" for i, x in enumerate(_LINES)) + " end"


def _trace(s, d):
    e = load(s, d, "site_events").where("ts is not null and visitor_id is not null")
    began = e.groupBy("visitor_id").agg(F.min("ts").alias("began"))
    e = e.join(began, "visitor_id")
    args = (F.coalesce("event_name", F.lit("NONE")), F.coalesce("page", F.lit("-")), F.col("ts"), F.col("began"))
    kinds = [e.where("id % 3 = 0").select("id", *decide.trace_entry("action", *args)), e.where("id % 3 = 1").select("id", *decide.trace_entry("decision", *args, reason=F.col("event_name")))]
    kinds.append(e.where("id % 3 = 2").select("id", *decide.trace_entry("span", *args, seconds=(F.col("id") % 1000) / 7.0)))
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).distinct()


def _passed(s, d):
    c = _m(s, d).where("source_url is not null").groupBy("source_url").agg(F.count("*").alias("records"), F.count_if(F.col("enrichment_status") == "enriched").alias("enriched"))
    return decide.passed_through(c, load(s, d, "directories"))


def _classes(s, d):
    p = _facts(s, d)
    skip = F.coalesce(F.col("site").startswith("www."), F.lit(False))
    landing = F.coalesce(F.col("text").rlike(decide.LANDING_TEXT), F.lit(False))
    return p.select("doc_id", decide.page_class(skip, F.col("text"), F.length("text") < 20, F.col("phones") >= 6, landing, F.col("phones") >= 3, (F.col("phones") > 0) | F.col("mail")).alias("class"))


def _boxes(s, d):
    p = load(s, d, "documents").where("text is not null")
    return p.select("doc_id", decide.search_score(F.lower("text"), F.coalesce("source", F.lit("")), F.coalesce(F.lower("site"), F.lit(""))).alias("score"))


_BODY = "case member_id % 3 when 0 then concat('page=', member_id, '&q=', coalesce(lower(substr(category, 1, 4)), ''), '&page=9&flag') when 1 then concat('{\"page\": ', member_id, ', \"letter\": \"a\", \"deep\": {\"x\": 1}, \"none\": null}') else '{broken' end"


def _bodies(s, d):
    return _m(s, d).select("member_id", F.explode(decide.body_fields(F.expr(_BODY))).alias("name", "value"))


QUERIES = {
    "schema_has_data": _one(lambda: decide.has_data_roles(_roles()).alias("out")),
    "search_box_score": _boxes,
    "page_class": _classes,
    "enumeration_useful": lambda s, d: decide.enumeration_useful(_pages(s, d)),
    "registry_best": _registry,
    "preferred_pick": _preferred,
    "landing_links": lambda s, d: decide.landing_links(_links(s, d)),
    "partition_choice": _forms,
    "profile_stale": _profiles,
    "plan_normal": lambda s, d: _plans(s, d).withColumn("options", F.array_join("options", "|")),
    "intent_flat": _intents,
    "api_route": _one(lambda: decide.api_route(F.regexp_replace("category", "Dental Care", "Dentist"), F.regexp_extract("street_address", r",\s*([A-Za-z]{2,3})\s+\d{5}", 1)).alias("out")),
    "page_signals": _signals,
    "richest_record": lambda s, d: decide.richest(_m(s, d).where("source_url is not null"), "source_url", "member_id", ["company_name", "phone", "fax", "website", "street_address", "mailing_address", "description", "category", "founded", "hours"]),
    "alphabet_plan": _letters,
    "picked_numbers": _one(lambda: F.array_join(decide.picked(F.expr(_REPLY), F.lit(6), 3), ",").alias("out")),
    "search_cascade": _cascade,
    "first_match": lambda s, d: decide.first_match(_results(s, d).where("href like 'http%'")),
    "batch_rows": _batch,
    "detail_urls": _uids,
    "crawl_choice": _crawls,
    "page_choice": _modes,
    "dump_name": _names,
    "feed_line": _one(lambda: decide.feed_line(F.expr(_LINE)).alias("out")),
    "trace_entries": _trace,
    "passed_through": _passed,
    "vertical_tally": lambda s, d: _m(s, d).where("website is null or trim(website) = ''").groupBy(intent.vertical(F.col("category"), F.col("company_name")).alias("vertical")).agg(F.count("*").alias("n")),
    "body_fields": _bodies,
}

_SP = record_queries._SP
_FILL = lambda c: f"coalesce(trim({c}, ' ') <> '', false)"
_TAILS = f"list_distinct(list_transform(regexp_extract_all(text, '{_PHONES}'), lambda p: right(regexp_replace(p, '[^0-9]', '', 'g'), 10)))"
_DOCS = f"with p as (select *, coalesce(len({_TAILS}), 0) as phones, coalesce(regexp_matches(text, '{_MAIL}'), false) as mail from documents)"
_L = "[" + ", ".join(f"'{p}'" for p in decide.SEARCH_AGAINST) + "]"
_HAS = lambda c, ps: "(" + " or ".join(f"contains({c}, '{p}')" for p in ps) + ")"
_KEYED = lambda c: f"lower({record_queries._ws(c)})"
_RES = "select member_id % 400 as id, (member_id % 3)::int as query_idx, (member_id // 400) % 12 as rank, website as href from members where website is not null"
_DHOST = "regexp_replace(regexp_replace(lower(regexp_extract({}, '^https?://([^/?#:]+)', 1)), '^www\\.', ''), '^$', '')"
_WORDS = record_queries.SQL["company_words"].replace("select member_id, array_to_string(", "").rsplit(", ' ') as out", 1)[0]
_LOC = f"case when coalesce(street_address, '') = '' then '' when len({extract_queries._LEFT}) > 0 then array_to_string({extract_queries._LEFT}, ' ') else coalesce({extract_queries._CODES}, '') end"
_D10 = extract_queries._D10
_FREE = record_queries._in(rules.FREE_MAIL)
_CLEAN = record_queries.SQL["url_clean"]

SQL = {
    "schema_has_data": f"select member_id, {_FILL('phone')} or {_FILL('street_address')} or {_FILL('category')} as out from members",
    "search_box_score": f"with h as (select doc_id, lower(text) as c, coalesce(source, '') as b, lower(coalesce(site, '')) as f, list_filter({_L}, lambda p: contains(lower(text), p)) as hits from documents where text is not null) select doc_id, (case when {_HAS('c', decide.SEARCH_FOR)} then 15 else 0 end - 15 * len(list_filter(hits, lambda p: len(list_filter(hits, lambda q: q <> p and contains(q, p))) = 0)) + case when {_HAS('b', decide.BUTTON_FOR)} then 5 else 0 end - case when {_HAS('b', decide.BUTTON_AGAINST)} then 15 else 0 end + case when {_HAS('f', decide.FIELD_FOR)} then 5 else 0 end)::int as score from h",
    "page_class": _DOCS + " select doc_id, case when coalesce(starts_with(site, 'www.'), false) then 'REJECT hard_skip' when text is null then 'REJECT no_page' when length(text) < 20 then 'DIRECTORY rendered' when phones >= 6 then 'DIRECTORY cards' when regexp_matches(text, '" + decide.LANDING_TEXT + "') then 'DIRECTORY landing' when phones >= 3 then 'DIRECTORY entries' when phones > 0 or mail then 'WEBSITE' else 'REJECT no_contact' end as class from p",
    "enumeration_useful": _DOCS + ", q as (select site, phones > 0 or mail or (length(text) >= 300 and contains(lower(text), 'member')::int + contains(lower(text), 'directory')::int + contains(lower(text), 'contact')::int + contains(lower(text), 'phone')::int >= 2) as signal, length(text) >= 300 as big, phones >= 1 as cards, row_number() over (partition by site order by doc_id) as r from p where site is not null and text is not null and length(text) > 0), g as (select site, count(*) as sampled, count(*) filter (signal) as sig, count(*) filter (r <= 6 and big) as checked, count(*) filter (r <= 6 and big and cards) as carded from q where r <= 8 group by 1) select site, sampled, sig >= 2 and carded >= case when checked > 0 then greatest(2, floor(checked * 0.5 + 0.5)) else 1 end as useful from g",
    "registry_best": f"with m as (select member_id as id, {_KEYED('company_name')} as key, list_filter(regexp_split_to_array(lower(coalesce(category, '')), '\\s+'), lambda w: length(w) > 3) as ws from members where company_name is not null), r as (select {_KEYED('company_name')} as key, npi, lower(coalesce(category, '')) as tax from registry_members where company_name is not null), j as (select id, npi, len(list_filter(ws, lambda w: contains(tax, w))) = 0 as miss from m join r using (key)) select id, npi from j qualify row_number() over (partition by id order by miss, npi) = 1",
    "preferred_pick": f"with d as (select distinct regexp_replace({record_queries._SRC}, '^www\\.', '') as domain from directories), r as (select *, {_DHOST.format('href')} as host from ({_RES}) where (rank < 5)), k as (select r.* from r where exists (select 1 from d where r.host = d.domain or ends_with(r.host, '.' || d.domain))) select id, href from k qualify row_number() over (partition by id order by query_idx, rank, href) = 1",
    "landing_links": "with l as (select lower(substr(company_name, 1, 1)) as site, member_id as pos, category as text, lower(source_url) as href, source_url from members where source_url is not null and company_name is not null), f as (select * from l where not regexp_matches(href, '^(?:mailto:|tel:|#|javascript:)') and (coalesce(regexp_matches(text, '" + decide.LANDING_TEXT + "'), false) or " + _HAS("regexp_extract(href, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)", decide.LANDING_PATHS) + ")) select site, href from f qualify row_number() over (partition by site order by pos, source_url) = 1",
    "partition_choice": "with f as (select source_url, count(distinct category) as o, count(distinct category) filter (regexp_matches(category, '(?i)dent|roof')) as k, count(*) as n from members group by 1) select source_url, case when k > 0 and k < o then 'intent' when expected_count is null then 'defer' when n >= 5 then 'narrowing' else 'enumerate' end as choice from f join directories using (source_url)",
    "profile_stale": "with v as (select doc_id, page_url, n_chars, doc_id % 5 as live, lag(page_url) over w as u, lag(n_chars) over w as n, lag(doc_id % 5) over w as l from documents where site is not null and fetched_at is not null and page_url is not null and n_chars is not null window w as (partition by site order by fetched_at, doc_id)) select doc_id, case when live >= 3 then false when l >= 3 then true else page_url <> u or abs(n_chars - n)::double / greatest(n, 1) > 0.2 end as stale from v where u is not null",
    "plan_normal": "select c_custkey, c_acctbal <= 0 as fallback, c_acctbal < 5000 and c_custkey % 5 > 0 and c_nationkey % 4 = 1 as ambiguous, case when c_nationkey % 4 = 1 then 'a|b' else '' end as options, case when c_mktsegment = 'BUILDING' then 'npi' end as api, case when c_custkey % 3 = 0 then 'all' else 'targeted' end as coverage from customer",
    "intent_flat": "select c_custkey, case when k then lower(c_mktsegment) end as canonical, case when k then c_name end as aliases, case when k then case when c_custkey % 3 = 0 then 'specialist' else 'inclusive' end end as scope from (select *, c_acctbal > 0 and c_custkey % 4 <> 0 as k from customer)",
    "api_route": f"with r as (select member_id, trim(regexp_replace(lower(replace(category, 'Dental Care', 'Dentist')), '{_SP}+', ' ', 'g'), ' ') as c, upper(regexp_extract(street_address, ',\\s*([A-Za-z]{{2,3}})\\s+\\d{{5}}', 1)) as st from members) select member_id, case when length(st) = 2 then {extract_queries._TAX} || '|' || st end as out from r",
    "page_signals": f"with j as (select d.doc_id, lower(coalesce(text, '')) as low, regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g') as dg, substr(lower(text), 1, 80) as head, m.* from documents d join members m on m.member_id = d.doc_id), k as (select *, {_WORDS} as ws, list_filter(string_split(lower({_LOC}), ' '), lambda x: x <> '') as place from j) select doc_id, coalesce(contains(dg, {_D10}), false) as has_phone, coalesce(list_bool_or(list_transform(contacts, lambda x: coalesce(contains(x.email, '@') and not (string_split(lower(trim(x.email, ' ')), '@')[-1] in {_FREE}) and contains(low, lower(trim(x.email, ' '))), false))), false) as has_email, coalesce(len(place) >= 2 and len(list_filter(place, lambda x: not contains(low, x))) = 0, false) as has_location, coalesce(len(list_filter(ws, lambda x: length(x) >= 4 and contains(head, x))) > 0, false) as has_name from k",
    "richest_record": "with n as (select source_url, member_id, " + " + ".join(f"{record_queries._filled(c)}::int" for c in ("company_name", "phone", "fax", "website", "street_address", "mailing_address", "description", "category", "founded", "hours")) + " as n from members where source_url is not null) select source_url, member_id, n from n qualify row_number() over (partition by source_url order by n desc, member_id) = 1",
    "alphabet_plan": "select source_url as site, lower(substr(company_name, 1, 1)) as letter, count(*) as n, count(*) >= 8 as paginate from members where source_url is not null and company_name is not null group by 1, 2 having regexp_full_match(letter, '[a-z0-9]')",
    "picked_numbers": "with k as (select member_id, [member_id % 9, member_id % 5, member_id % 9, member_id % 4 + 1] as k from members), f as (select member_id, list_filter(k, lambda x, i: x between 1 and 6 and list_position(k, x) = i) as f from k) select member_id, case when member_id % 7 in (0, 1) then '1,2,3,4,5,6' else array_to_string(f[1:3], ',') end as out from f",
    "search_cascade": f"with a as (select member_id, trim(replace(company_name, '\"', ''), ' ') as nm, {_LOC} as loc, case when length(category) < 40 then category end as cat, {_WORDS} as ws, {_D10} as d from members where company_name is not null), w as (select member_id, list(w order by length(w) desc, i) as ws from (select member_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from a) group by 1), q as (select a.member_id, nullif(concat_ws(' ', case when nm <> '' then '\"' || nm || '\"' end, nullif(loc, ''), nullif(cat, '')), '') as q1, nullif(concat_ws(' ', nullif(array_to_string(coalesce(w.ws, [])[1:4], ' '), ''), nullif(loc, ''), nullif(cat, '')), '') as q2, case when d is not null then '\"(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) || '\"' end as q3 from a left join w using (member_id)), l as (select member_id, list_filter([q1, case when q2 is distinct from q1 then q2 end, q3], lambda x: x is not null) as l from q) select member_id, (i - 1)::int as attempt, l[i] as query from (select member_id, l, unnest(range(1, len(l) + 1)) as i from l)",
    "first_match": f"select id, query_idx, href from ({_RES}) where href like 'http%' qualify row_number() over (partition by id order by query_idx, rank, href) = 1",
    "batch_rows": f"with l as (select member_id, case when member_id % 3 = 0 then source_url else website end as raw from members), c as ({_CLEAN.replace('from members', 'from (select member_id, raw as website from l)')}), k as (select out as link, count(*) as records from ({_CLEAN.replace('from members', 'from (select member_id, source_url as website from members where source_url is not null)')}) group by 1) select member_id as index, coalesce(c.out, raw) as link, coalesce(records, 0) > 0 as success, coalesce(records, 0) as records, case when c.out is null then 'bad address' end as error from l join c using (member_id) left join k on k.link = c.out where trim(coalesce(raw, ''), ' ') <> ''",
    "detail_urls": f"with f as (select source_url, {_FILL('fax')} as c, row_number() over (partition by source_url order by member_id) as r from members where source_url is not null), s as (select source_url from f where r <= 20 group by 1 having avg(c::int) < 0.2) select distinct source_url as site, member_id // 2 as uid, regexp_replace(string_split(source_url, '#')[1], '/+$', '') || '#!biz/id/' || (member_id // 2) as url from members join s using (source_url) where member_id % 3 > 0",
    "crawl_choice": f"with f as (select source_url, round(avg((not {_FILL('fax')} and not {_FILL('founded')})::int), 6) >= {rules.NAME_ONLY_TRIGGER} as bare, count(distinct category) as k, count(*) as n from members where source_url is not null group by 1) select source_url, case when k % 4 = 0 then 'crawl: everything' when bare and n % 2 = 0 then 'crawl: names only' when k % 3 = 0 and not bare then 'skip: not on pages' when n % 3 = 0 and not bare then 'skip: found already' else 'ask' end as choice from f",
    "page_choice": _DOCS + ", u as (select doc_id, phones, site, page_url, " + record_queries._HOST.replace("U", "page_url") + " as h from p where page_url is not null) select doc_id, case when phones = 0 or coalesce(h = 'yelp.com' or ends_with(h, '.yelp.com'), false) then 'auto' else 'direct' end as mode, case when doc_id % 2 = 0 and array_to_string(string_split(h, '.')[-2:], '.') = array_to_string(string_split(lower(site), '.')[-2:], '.') then 'https://' || site || '/members' when doc_id % 2 = 1 and array_to_string(string_split(h, '.')[-2:], '.') = 'elsewhere.example' then 'https://elsewhere.example/members' end as hint from u",
    "dump_name": "with g as (select category, list_sort(list_distinct(list(nullif(upper(regexp_extract(street_address, ',\\s*([A-Za-z]{2})\\s+\\d{5}', 1)), '')))) as st from members where category is not null group by 1) select category, array_to_string(list_concat([substr(replace(coalesce(nullif(lower(category), ''), 'results'), ' ', '_'), 1, 40)], coalesce(st, [])[1:3]), '_') as name from g",
    "feed_line": """select member_id, case member_id % 7 when 0 then '→ Saving ' || member_id || ' records...'
        when 2 then case when trim(website, ' ') = '' then '[403]' else '⚠ Blocked (403): ' || rtrim(coalesce(website, 'nowhere'), ' ') || ' — retrying' end
        when 3 then case when category = '' or regexp_matches(category, '[\n\r]') then 'Trying \'\'' || category || '\'\'' else '→ Searching: "' || regexp_extract(coalesce(category, 'all') || '\'\'', '^(.[^\'\']*)', 1) || '"' end
        when 4 then '→ Page ' || (member_id % 40) || '...' when 5 then case when length(trim(company_name, ' ')) >= 3 then trim(company_name, ' ') end
        when 6 then '✓ Done — ' || member_id || ' records processed' end as out from members""",
    "trace_entries": "with e as (select distinct id, coalesce(event_name, 'NONE') as c, coalesce(page, '-') as p, event_name, (epoch_us(ts) - min(epoch_us(ts)) over (partition by visitor_id)) / 1e6 as t from site_events where ts is not null and visitor_id is not null) select distinct id, round(t, 2) as time, ['action', 'decision', 'span'][id % 3 + 1] as kind, c as category, 'info' as level, case when id % 3 = 1 then 'DECISION: ' || p || coalesce(' — ' || nullif(event_name, ''), '') else p end as message, case when id % 3 = 1 then p end as decision, case when id % 3 = 1 then nullif(event_name, '') end as reason, case when id % 3 = 2 then round((id % 1000) / 7.0, 2) end as duration_s from e",
    "passed_through": "select source_url, count(*) as records, coalesce(any_value(entity_type) <> 'business', false) as skipped, case when coalesce(any_value(entity_type) <> 'business', false) then 0 else count(*) filter (enrichment_status = 'enriched') end as enriched from members left join directories using (source_url) where source_url is not null group by 1",
    "vertical_tally": "select vertical, count(*) as n from (select " + record_queries._VERT + " as vertical from (select lower(coalesce(category, '')) as c, trim(coalesce(company_name, ''), ' ') as n from members where website is null or trim(website, ' ') = '')) group by 1",
    "body_fields": "select member_id, unnest(['page', 'q']) as name, unnest([member_id::varchar, coalesce(lower(substr(category, 1, 4)), '')]) as value from members where member_id % 3 = 0 union all select member_id, unnest(['page', 'letter']), unnest([member_id::varchar, 'a']) from members where member_id % 3 = 1",
}
