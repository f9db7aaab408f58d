"""Queries of discovery, links, captures and pages, with independent SQL.

Links come from the tables' own addresses. Pages are rendered from members' rows (``render``), so what the
page operators read back can be stated in SQL over the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import rules
from rollbook.functions import text as t
from rollbook.operators import discovery, intent, links, pages
from rollbook.sources import captures
from rollbook.work import load


def _m(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "members")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents")


def _hits(s: SparkSession, d: str) -> DataFrame:
    """Websites of members as search hits of five queries."""
    m = _m(s, d).where("website is not null").select((F.col("member_id") % 5).alias("query_idx"), F.floor(F.col("member_id") / 5).alias("n"), F.col("website").alias("url"), F.col("company_name").alias("title"))
    return m.select("query_idx", F.concat(F.lit("q"), "query_idx").alias("query"), (F.col("n") % 30).alias("rank"), "url", "title")


def _urls(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).where("page_url is not null").select("site", F.col("doc_id").alias("pos"), F.col("page_url").alias("href"))


def _listing_urls(s: SparkSession, d: str) -> DataFrame:
    """Listing pages named in members: as they are, and as numbered pages of them."""
    m = _m(s, d).where("source_url is not null")
    page = F.concat("source_url", F.lit("?page="), (F.col("member_id") % 7 + 1).cast("string"))
    return m.select(F.col("source_url").alias("site"), F.col("member_id").alias("pos"), page.alias("href"))


def _path_urls(s: SparkSession, d: str) -> DataFrame:
    m = _m(s, d).where("source_url is not null")
    return m.select(F.col("source_url").alias("site"), F.col("member_id").alias("pos"), F.concat("source_url", F.lit("/page/"), (F.col("member_id") % 9 + 1).cast("string"), F.lit("/all")).alias("href"))


def _records(s: SparkSession, d: str) -> DataFrame:
    return captures.dump_members(load(s, d, "dump_files").select("dump_id", "body").distinct())


def esc(c: Column) -> Column:
    """Text as HTML."""
    return F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def render(rows: DataFrame, group: int = 20) -> DataFrame:
    """(page_id, html): pages of up to ``group`` cards, a table, embedded JSON and a form, from named members' rows."""
    r = rows.where("company_name is not null and trim(company_name) != ''").select(
        F.floor(F.col("member_id") / group).alias("page_id"), "member_id", t.ws(F.col("company_name")).alias("name"), t.ws(F.coalesce("phone", F.lit(""))).alias("phone"), t.ws(F.coalesce("street_address", F.lit(""))).alias("address")
    )
    card = F.concat(F.lit('<div class="card"><h3>'), esc(F.col("name")), F.lit('</h3><p class="addr">'), esc(F.col("address")), F.lit('</p><a class="tel" href="tel:'), esc(F.col("phone")), F.lit('">Call '), esc(F.col("name")), F.lit("</a></div>"))
    row = F.concat(F.lit("<tr><td>"), esc(F.col("name")), F.lit("<td>"), esc(F.col("phone")), F.lit("</tr>"))
    ent = F.to_json(F.struct(F.lit("LocalBusiness").alias("@type"), F.col("name"), F.col("phone").alias("telephone"), F.col("address")))
    g = r.groupBy("page_id").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_id", x.alias("x")))), lambda y: y["x"]), sep).alias(n) for n, x, sep in (("cards", card, ""), ("rows", row, ""), ("ents", F.replace(ent, F.lit("</"), F.lit("<\\/")), ","))])
    html = F.concat(
        F.lit('<html><head><script>var x = "<div>";</script><script type="application/ld+json">{"@graph": ['), "ents", F.lit(']}</script></head><body><nav><a href="/a">Home</a></nav><div id="list">'), "cards",
        F.lit("</div><table><tr><th>Company Name<th>Phone</tr>"), "rows",
        F.lit('</table><form method="get"><select name="state"><option value="">Any</option><option>AZ<option>ID<option>NV<option>OR<option>UT<option>WA</select></form></body></html>'),
    )
    return g.select("page_id", html.alias("html"))


def _match(s: SparkSession, d: str) -> DataFrame:
    m = _m(s, d)
    recs = m.where("company_name is not null").select(F.col("member_id").alias("id"), F.col("company_name").alias("name"), t.host_root(t.host_of(F.col("source_url"))).alias("source_root"))
    res = m.where("website like 'http%'").select(F.col("member_id").alias("id"), F.lit(0).alias("rank"), F.lower("website").alias("href"))
    return discovery.website_match(recs, res)


def _facts(s: SparkSession, d: str) -> DataFrame:
    m = _m(s, d).where("website is not null")
    return m.select((F.col("member_id") % 500).alias("id"), F.col("member_id").alias("rank"), F.col("website").alias("href"), F.col("phone").isNotNull().alias("has_phone"), (F.size("contacts") > 0).alias("has_email"), F.col("street_address").isNotNull().alias("has_location"), F.col("company_name").isNotNull().alias("has_name"))


def _plans(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "nation").select(F.col("n_nationkey").alias("plan"), F.lower("n_name").alias("industry"), F.lit("").alias("city"), F.substring("n_name", 1, 2).alias("state"))


def _categories(s: SparkSession, d: str) -> DataFrame:
    return _m(s, d).where("category is not null and source_url is not null").select(F.col("source_url").alias("site"), F.col("member_id").alias("pos"), F.col("category").alias("text"))


_EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
_PHONE = r"(?:\+?1[\s.\-]?)?(?:\(\d{3}\)[\s.\-]?|\d{3}[\s.\-])\d{3}[\s.\-]?\d{4}"


def _doc_emails(s: SparkSession, d: str) -> DataFrame:
    """Mail addresses of documents: lower case, ranked by how well they reach someone, ten at most."""
    e = _docs(s, d).where(F.col("text").contains("@")).select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0)), lambda x: F.lower(x)))).alias("email"))
    prefix = F.substring_index("email", "@", 1)
    e = e.where(~prefix.isin(*rules.EMAIL_JUNK)).withColumn("tier", t.email_tier(prefix))
    g = e.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("tier", "email"))), 1, 10).alias("top"))
    return g.select("doc_id", F.array_join(F.transform("top", lambda x: x["email"]), "; ").alias("emails"))


def _doc_phones(s: SparkSession, d: str) -> DataFrame:
    """The first five different numbers of documents."""
    p = _docs(s, d).where(F.col("text").rlike(r"\d{3}")).select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(rf"(?<!\d)(?:{_PHONE})(?!\d)"), F.lit(0)), lambda x: F.regexp_replace(x, r"\D", "")).alias("p"))
    return p.where(F.size("p") > 0).select("doc_id", F.array_join(F.slice(F.array_distinct("p"), 1, 5), "; ").alias("phones"))


def stated_count(text: Column) -> Column:
    """The largest total that a page states in a status line; null if none."""
    nouns = "results?|members?|companies?|listings?|records?|providers?|businesses?|profiles?|cards|total"
    rx = rf"(?:results?\s*(?:found)?\s*:\s*|(?:showing|displaying|loaded,)\s+|of\s+|total\s*(?:{nouns})?\s*:\s*)(\d[\d,]*)(?:\s+(?:{nouns}))"
    return F.array_max(F.transform(F.regexp_extract_all(F.lower(text), F.lit(rx), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("bigint")))


QUERIES = {
    "candidate_dedup_cap": lambda s, d: discovery.dedup_cap(_hits(s, d)).drop("title"),
    "url_skip": lambda s, d: _m(s, d).where("website is not null").select("member_id", F.coalesce(discovery.skippable(F.col("website")), F.lit(True)).alias("skip")),
    "domain_membership": lambda s, d: _m(s, d).select("member_id", t.in_domains(t.host_of(F.col("source_url")), ["example", "google.com"]).alias("listed")),
    "keyword_pass": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", discovery.keyword_pass(F.col("text")).alias("pass")),
    "preflight": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", discovery.verdict(F.col("text"), F.lit(False), F.col("text").rlike(r"\d{3}-\d{4}")).alias("reason")),
    "reject_tally": lambda s, d: discovery.tally(_docs(s, d).where("text is not null").select(discovery.verdict(F.col("text"), F.lit(False), F.col("text").rlike(r"\d{3}-\d{4}")).alias("reason"))),
    "website_match": _match,
    "verified_pick": lambda s, d: discovery.verified_pick(_facts(s, d)),
    "fallback_urls": lambda s, d: discovery.fallback_urls(_plans(s, d)),
    "region_states": lambda s, d: load(s, d, "region").select("r_regionkey", discovery.states_of_region(F.concat(F.lit("firms of the "), F.element_at(F.array(*[F.lit(x) for x in sorted(discovery.REGIONS)]), F.col("r_regionkey") + 1))).alias("states")),
    "intent_categories": lambda s, d: intent.categories_by_intent(_categories(s, d), ["Plumb", "drain"], 3),
    "url_template": lambda s, d: _urls(s, d).select("pos", t.url_template(F.col("href")).alias("template")),
    "url_uid": lambda s, d: _urls(s, d).select("pos", t.url_uid(F.col("href")).alias("uid")),
    "same_site": lambda s, d: _m(s, d).where("website is not null and source_url is not null").select("member_id", links.same_site(F.col("source_url"), F.col("website")).alias("same")),
    "link_templates": lambda s, d: links.detail_groups(_m(s, d).where("website like 'http%'").select(F.lit("all").alias("site"), F.col("member_id").alias("pos"), F.concat(F.lit("https://x.example/members/"), "member_id").alias("href"))),
    "pager_param": lambda s, d: links.pager_param(_listing_urls(s, d)),
    "path_pager": lambda s, d: links.path_pager(_path_urls(s, d)),
    "category_groups": lambda s, d: links.category_groups(_m(s, d).where("category is not null and source_url is not null").select(F.col("source_url").alias("site"), F.concat("source_url", F.lit("/category/"), F.lower(F.regexp_replace("category", "[^A-Za-z]+", "-"))).alias("href"), F.col("category").alias("text"))),
    "nav_filter": lambda s, d: links.nav_filter(_listing_urls(s, d).withColumn("text", F.when(F.col("pos") % 4 > 0, F.col("href")))),
    "enumerable_params": lambda s, d: links.enumerable_params(_listing_urls(s, d).select(F.concat("href", F.lit("&q="), F.substring("href", 13, 1), F.lit("&letter=a")).alias("url"))),
    "dump_reader": _records,
    "dump_metadata": lambda s, d: captures.dump_metadata(load(s, d, "dump_files").select("dump_id", "body").distinct()),
    "member_list_test": lambda s, d: captures.member_lists(_records(s, d)),
    "member_count": lambda s, d: captures.member_lists(_records(s, d)).agg(F.sum("n").alias("records"), F.count_if("member_list").alias("lists")),
    "alias_resolve": lambda s, d: captures.resolve_aliases(_records(s, d)),
    "credential_scrub": lambda s, d: _m(s, d).where("source_url is not null").select("member_id", captures.credential_shaped(F.concat("source_url", F.when(F.col("member_id") % 3 == 0, "/api/auth/login").when(F.col("member_id") % 3 == 1, "?access_token=1").otherwise("?q=secretary")), F.lit(None).cast("string")).alias("refused")),
    "doc_emails": _doc_emails,
    "doc_phones": _doc_phones,
    "stated_count": lambda s, d: _docs(s, d).where("source = 'scrape_log' and text is not null").select("doc_id", stated_count(F.col("text")).alias("count")),
    "founded_year": lambda s, d: _m(s, d).where("description is not null").select("member_id", F.expr("try_cast(nullif(regexp_extract(description, '(?i)(?:founded|established|since|est\\\\.?)\\\\s*(?:in\\\\s+)?(\\\\d{4})', 1), '') as int)").alias("year")).where("year between 1800 and 2026"),
    "log_category": lambda s, d: _docs(s, d).where("source = 'scrape_log' and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "m")).select("doc_id", "line", t.log_category(F.col("m")).alias("category")),
    "page_links": lambda s, d: links.page_links(render(_m(s, d))).groupBy("page_id").agg(F.count("*").alias("links")),
    "apply_schema": lambda s, d: pages.apply_layout(render(_m(s, d)), "#list > .card", {"name": "h3", "address": ".addr", "phone": "a.tel@href"}),
    "header_table": lambda s, d: pages.apply_headers(render(_m(s, d)), ["company_name", "phone"]),
    "jsonld": lambda s, d: pages.apply_jsonld(render(_m(s, d))).groupBy("page_id").agg(F.count("*").alias("entities")),
    "repeated_records": lambda s, d: pages.repeated_records(render(_m(s, d))),
    "visible_text": lambda s, d: pages.visible_text(render(_m(s, d))),
    "main_text": lambda s, d: pages.main_text(render(_m(s, d))),
    "form_values": lambda s, d: pages.apply_forms(render(_m(s, d))),
}

_HOST = "nullif(regexp_replace(lower(regexp_extract(U, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www\\.', '', 'g'), '')"
_PATH = "regexp_extract(U, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _host(u: str) -> str:
    return _HOST.replace("U", u)


def _path(u: str) -> str:
    return _PATH.replace("U", u)


def _skip(u: str) -> str:
    h, p = _host(u), f"lower({_path(u)})"
    doms = " or ".join(f"{h} = '{x}' or ends_with({h}, '.{x}')" for x in rules.SKIP_DOMAINS)
    pre = " or ".join(f"starts_with({p}, '{x}')" for x in rules.SKIP_PREFIXES)
    end = " or ".join(f"ends_with({p}, '{x}')" for x in rules.SKIP_ENDINGS)
    return f"({h} is null or {doms} or {pre} or regexp_matches({p}, '/20[12][0-9]/') or {end})"


def _any(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_SP = "[\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'), ' ')"


# camel-case words fall apart without look-around: mark the borders first
_WORDS = "string_split(lower(regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), ' ')"
_PASS = f"({_any('lower(text)', discovery.STRONG_PHRASES)} or len(list_intersect({_WORDS}, [{', '.join(chr(39) + w + chr(39) for w in discovery.WEAK_WORDS)}])) >= 2)"
_VERDICT = f"case when length(text) < 1500 then 'thin_content' when {_any('lower(text)', discovery.PARKED_PHRASES)} then 'parked_domain' when {_any('lower(text)', discovery.WALL_PHRASES)} then 'login_wall' when {_any('lower(text)', discovery.BROKER_PHRASES)} then 'data_broker_profile' when not {_PASS} then 'no_directory_signals' when not regexp_matches(text, '\\d{{3}}-\\d{{4}}') then 'no_member_content' else 'passed' end"
_HITS = "with m as (select member_id % 5 as query_idx, member_id // 5 as n, website as url from members where website is not null), h0 as (select query_idx, 'q' || query_idx as query, n % 30 as rank, url from m)"
_LIST = "with l as (select source_url as site, member_id as pos, source_url || '?page=' || (member_id % 7 + 1) as href from members where source_url is not null)"
_ABS = "regexp_matches(site, '^[A-Za-z]')"
_NAMED = f"with r as (select member_id // 20 as page_id, member_id, {_ws('company_name')} as name, {_ws('coalesce(phone, chr(32))')} as phone, {_ws('coalesce(street_address, chr(32))')} as address from members where company_name is not null and trim(company_name, ' ') <> ''), p as (select *, row_number() over (partition by page_id order by member_id) - 1 as pos from r)"
_DUMPS = "with d as (select distinct dump_id, ltrim(replace(body, chr(65279), '')) as b from dump_files), j as (select dump_id, b::json as j from d), m as (select dump_id, case when json_type(j) = 'ARRAY' then j else j->'members' end as l from j)"
_REC = _DUMPS + ", r as (select dump_id, i as pos, l->i as rec from (select dump_id, l, unnest(range(0, json_array_length(l)::bigint)) as i from m))"


def _alias(keys: list[str]) -> str:
    """The first alias, by lower-cased key, that holds a scalar."""
    one = lambda k: f"list_filter(kv, lambda x: x.k = '{k}')[-1].v"
    return "nullif(coalesce(" + ", ".join(one(k) for k in keys) + "), '')"


_KV = _REC + ", kv as (select dump_id, pos, list_filter(list_transform(json_keys(rec), lambda k: {'k': lower(k), 'v': case when json_type(rec->k) in ('ARRAY', 'OBJECT', 'NULL') then null else trim(rec->>k, ' ') end}), lambda x: x.v is not null) as kv from r)"
_MATCH_WORDS = "list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(company_name), '[^\\pL\\pM\\pN_]', ' ', 'g'), ' '), '\\s+'), lambda x: x not in (" + ", ".join(f"'{w}'" for w in rules.BUSINESS_SUFFIXES) + ") and (length(x) >= 3 or regexp_matches(x, '^\\d{2,}$'))))"
_GENERIC = "(" + ", ".join(f"'{w}'" for w in rules.INDUSTRY_WORDS) + ")"
_HIT = "contains(dom, w) and (length(w) >= 5 or starts_with(dom, w) or regexp_matches(dom, '[0-9]' || w))"
_TIER = "case when p in ('info','contact','hello','inquiries','inquiry') then 0 when p in ('office','sales','general') then 1 when p in ('admin','support','help') then 2 when p in (" + ", ".join(f"'{w}'" for w in rules.EMAIL_LOW) + ") then 8 when regexp_matches(p, '[._]') then 3 when regexp_matches(p, '^[a-z]{3,}$') then 4 else 9 end"
_LOG = "case " + " ".join(f"when {_any('l', words)} then '{name}'" for name, words in rules.LOG_CATEGORIES) + " else 'LOG' end"

SQL = {
    "candidate_dedup_cap": _HITS + f", h as (select *, {_host('url')} as domain, lower(regexp_replace({_path('url')}, '/+$', '')) as page from h0 where starts_with(url, 'http') and rank < 25 and not {_skip('url')}), p as (select domain, page, min({{'q': query_idx, 'r': rank, 'u': url}}) as a, arg_min(query, {{'r': rank, 'q': query_idx}}) as via_query, min(rank) as rank from h group by 1, 2), k as (select *, row_number() over (partition by domain order by a) as n from p) select a.u as url, via_query, rank, a.q as query_idx from k where n <= 2",
    "url_skip": f"select member_id, {_skip('website')} as skip from members where website is not null",
    "domain_membership": f"select member_id, ({_host('source_url')} = 'example' or ends_with({_host('source_url')}, '.example') or {_host('source_url')} = 'google.com' or ends_with({_host('source_url')}, '.google.com')) as listed from members",
    "keyword_pass": f"select doc_id, {_PASS} as pass from documents where text is not null",
    "preflight": f"select doc_id, {_VERDICT} as reason from documents where text is not null",
    "reject_tally": f"select {_VERDICT} as reason, count(*) as n from documents where text is not null group by 1",
    "website_match": f"with j as (select member_id as id, lower(website) as href, {_MATCH_WORDS} as w, {_host('source_url')} as sh, {_host('lower(website)')} as host from members where company_name is not null and website like 'http%'), k as (select *, replace(replace(host, '-', ''), '.', '') as dom, case when length(sh) - length(replace(sh, '.', '')) >= 2 then regexp_extract(sh, '([^.]*\\.[^.]*)$', 1) else sh end as sr, case when length(host) - length(replace(host, '.', '')) >= 2 then regexp_extract(host, '([^.]*\\.[^.]*)$', 1) else host end as hr, list_filter(w, lambda x: x not in {_GENERIC} and length(x) >= 3) as di, list_filter(w, lambda x: x in {_GENERIC} and length(x) >= 3) as ge from j where host is not null and not {_skip('href').replace('or regexp_matches', 'or 1 = 0 and regexp_matches')}) select id, regexp_extract(href, '^(https?://[^/?#]+)', 1) as site from k where (sr is null or hr <> sr) and case when len(di) > 0 then len(list_filter(di, lambda w: {_HIT})) > 0 else len(list_filter(ge, lambda w: {_HIT})) >= 2 end",
    "verified_pick": "with f as (select member_id % 500 as id, member_id as rank, website as href, 2 * (phone is not null)::int + 2 * (coalesce(len(contacts), 0) > 0)::int + (street_address is not null)::int + (company_name is not null)::int as score from members where website is not null), k as (select *, row_number() over (partition by id order by rank) as k from f), s as (select *, score + case k when 1 then 0.5 when 2 then 0.25 else 0 end as o from k where k <= 3 and score >= 3), b as (select *, row_number() over (partition by id order by o desc, rank) as r from s) select id, href, score from b where r = 1",
    "fallback_urls": "with p as (select n_nationkey as plan, replace(lower(n_name), ' ', '+') as i, upper(substr(n_name, 1, 2)) as s from nation where regexp_matches(substr(n_name, 1, 2), '^[A-Za-z]{2}$')) select plan, 'YellowPages' as label, 'https://www.yellowpages.com/search?search_terms=' || i || '&geo_location_terms=' || s as url from p union all select plan, 'Manta', 'https://www.manta.com/search?search=' || i || '&search_location=' || s from p union all select plan, 'Cylex', 'https://www.cylex.us.com/s?q=' || i || '&c=' from p union all select plan, 'ChamberOfCommerce', 'https://www.chamberofcommerce.com/search?what=' || i || '&where=' || s from p",
    "intent_categories": "with c as (select source_url as site, member_id as pos, category as text, contains(lower(category), 'plumb') or contains(lower(category), 'drain') as hit from members where category is not null and source_url is not null), r as (select *, row_number() over (partition by site, hit order by pos, text) as r, max(hit) over (partition by site) as anyhit from c) select site, pos, text from r where not anyhit or (hit and r <= 3)",
    "same_site": f"select member_id, coalesce({_host('source_url')} = {_host('website')} or ends_with({_host('website')}, '.' || {_host('source_url')}), false) as same from members where website is not null and source_url is not null",
    "url_uid": "select doc_id as pos, coalesce(nullif(regexp_extract(page_url, '[/#]([0-9a-f]{24})(?:/|$)', 1), ''), nullif(regexp_extract(page_url, '(?i)[?&]\\w*id\\w*=(\\d+)', 1), ''), regexp_extract(page_url, '/(\\d{3,})(?:/|$|\\?)', 1)) as uid from documents where page_url is not null",
    "link_templates": "with u as (select distinct member_id from members where website like 'http%' and member_id >= 100) select 'all' as site, 'https://x.example/members/{ID}' as template, count(*) as pages, count(*) + 10 as score from u having count(*) >= 3",
    "pager_param": _LIST + f", v as (select site, member_id_page as v from (select site, regexp_extract(href, 'page=(\\d+)$', 1)::bigint as member_id_page from l where href <> '' and not starts_with(href, '#'))) select site, 'page' as param, max(v) as last from v group by site having count(distinct v) >= 2 and bool_or(v = 2)",
    "path_pager": "with l as (select source_url as site, source_url || '/page/' as prefix, member_id % 9 + 1 as n from members where source_url is not null and not starts_with(source_url, '#')), g as (select site, prefix, max(n)::int as last from l group by 1, 2 having count(distinct n) >= 2 and bool_or(n = 2)) select site, prefix, '/all' as suffix, last from g",
    "nav_filter": _LIST + " select site, href, min(pos) as pos from l where pos % 4 > 0 and not starts_with(href, '#') group by 1, 2",
    "category_groups": "with l as (select source_url as site, source_url || '/category/' || lower(regexp_replace(category, '[^A-Za-z]+', '-', 'g')) as href, category as text from members where category is not null and source_url is not null), u as (select *, regexp_extract(href, '^(.*/)[^/]+/?$', 1) as prefix from l where not starts_with(href, '#')), g as (select site, prefix, count(distinct href) as n, count(distinct text) as x, avg(length(text)) as len from u group by 1, 2) select site, prefix, n as links, least(n, 30) + 20 * regexp_matches(lower(prefix), 'categor|industr|director|type|specialt|service')::int + 10 * (len < 30)::int as score from g where n between 3 and 200 and x >= 0.7 * n and prefix <> ''",
    "enumerable_params": _LIST + ", u as (select distinct href || '&q=' || substr(href, 13, 1) || '&letter=a' as url, substr(href, 13, 1) as q from l) select url, 'page' as param, 'page' as kind from u union all select url, 'letter', 'letter' from u union all select url, 'q', case when regexp_matches(q, '^[A-Za-z0-9]$') then 'letter' else 'term' end from u",
    "dump_metadata": _DUMPS + " select dump_id, j->'metadata'->>'source_url' as meta_source, (j->'metadata'->>'total_members')::bigint as total_members, coalesce((j->'metadata'->>'partial')::boolean, false) as partial from j",
    "member_list_test": _REC + f", k as (select dump_id, pos, len(json_keys(rec)) as k, len(list_filter(json_keys(rec), lambda x: lower(x) in ({', '.join(chr(39) + w + chr(39) for w in rules.NAME_KEYS)}))) > 0 as named from r) select dump_id, count(*) as n, count(*) >= 3 and avg(named::int) filter (pos < 5) >= 0.5 and avg(k) filter (pos < 5) >= 5 as member_list from k group by 1",
    "member_count": _REC + f", k as (select dump_id, pos, len(json_keys(rec)) as k, len(list_filter(json_keys(rec), lambda x: lower(x) in ({', '.join(chr(39) + w + chr(39) for w in rules.NAME_KEYS)}))) > 0 as named from r), g as (select dump_id, count(*) as n, count(*) >= 3 and avg(named::int) filter (pos < 5) >= 0.5 and avg(k) filter (pos < 5) >= 5 as ok from k group by 1) select sum(n)::bigint as records, count(*) filter (ok) as lists from g",
    "alias_resolve": _KV + " select dump_id, pos::int as pos, " + ", ".join(f"{_alias(keys)} as {f}" for f, keys in rules.FIELD_ALIASES.items()) + " from kv",
    "credential_scrub": "select member_id, member_id % 3 <> 2 as refused from members where source_url is not null and regexp_matches(source_url, '^https?://') union all select member_id, member_id % 3 = 1 or (member_id % 3 = 0 and regexp_matches(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://')) as refused from members where source_url is not null and not regexp_matches(source_url, '^https?://')",
    "doc_emails": "with e as (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b'), lambda x: lower(x)))) as email from documents where text like '%@%'), p as (select doc_id, email, split_part(email, '@', 1) as p from e), r as (select doc_id, email, row_number() over (partition by doc_id order by " + _TIER + ", encode(email)) as r from p where p not in (" + ", ".join(f"'{w}'" for w in rules.EMAIL_JUNK) + ")) select doc_id, string_agg(email, '; ' order by r) as emails from r where r <= 10 group by 1",
    "founded_year": "with y as (select member_id, try_cast(nullif(regexp_extract(description, '(?i)(?:founded|established|since|est\\.?)\\s*(?:in\\s+)?(\\d{4})', 1), '') as int) as year from members) select * from y where year between 1800 and 2026",
    "log_category": "with l as (select doc_id, string_split(text, chr(10)) as ls from documents where source = 'scrape_log' and text is not null), m as (select doc_id, unnest(range(0, len(ls)))::int as line, ls from l), n as (select doc_id, line, lower(trim(ls[line + 1], ' ')) as l from m) select doc_id, line, " + _LOG + " as category from n",
    "page_links": _NAMED + " select page_id, count(*) + 1 as links from p where phone is not null group by 1",
    "apply_schema": _NAMED + " select page_id, pos::int as pos, name, address, phone from p",
    "header_table": _NAMED + " select page_id, pos::int as pos, name as company_name, phone from p",
    "jsonld": _NAMED + " select page_id, count(distinct lower(name)) filter (phone <> '' or address <> '') as entities from p group by 1 having entities > 0",
    "form_values": _NAMED + ", v as (select ['AZ', 'ID', 'NV', 'OR', 'UT', 'WA'] as v) select distinct page_id, i::int as pos, 'state' as param, v[i + 1] as value from p, v, unnest(range(0, 6)) as t(i)",
    "region_states": "select r_regionkey, case r_regionkey when 0 then 'IL OH MI IN WI MN IA MO KS NE SD ND' when 1 then 'ME NH VT MA CT RI' when 2 then 'NY NJ PA MA CT RI NH VT ME' when 3 then 'WA OR ID MT' when 4 then 'WA OR ID' end as states from region",
}
