"""Queries of the extractors and planners, with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import extract
from rollbook.functions import rules
from rollbook.plans import pipelines, record_queries, web_queries
from rollbook.work import load


def _m(s, d):
    return load(s, d, "members")


def _one(make):
    return lambda s, d: _m(s, d).select("member_id", make().alias("out"))


_LABELLED = "concat(case member_id % 4 when 0 then 'Phone: ' when 1 then 'Studio: ' when 2 then 'E-Mail :' else '' end, company_name, case member_id % 3 when 0 then ' (link sends e-mail)' when 1 then '(opens in a new tab)' else '' end)"
_REQ = "concat('https://x.example/api?', case member_id % 3 when 0 then 'limit=' when 1 then 'Per_Page=' else 'q=' end, member_id % 50, '&page=1', case member_id % 5 when 0 then '&pageToken=a' else '' end)"
_KEY = "case member_id % 4 when 0 then 'nextPageToken' when 1 then 'endCursor' when 2 then 'next-page' else 'after' end"
_SOCIAL = "concat('https://', case member_id % 5 when 0 then 'www.facebook.com' when 1 then 'm.x.com' when 2 then 'netflix.com' when 3 then 'uk.linkedin.com' else 'fb.com' end, '/', member_id)"
_PAYLOAD = "case member_id % 5 when 0 then '{\"next\": \"/p/2\"}' when 1 then '{\"paging\": {\"next\": \" tok \"}}' when 2 then '{\"next\": \"null\", \"pageInfo\": {\"endCursor\": \"c9\"}}' when 3 then '{\"next\": true}' else '[]' end"


def _links(s, d):
    m = _m(s, d).where("website like 'http%'")
    path = F.expr("case member_id % 6 when 0 then '/contact-us/' when 1 then '/who-we-are' when 2 then '/x' when 3 then '/our-team/a' when 4 then '/solutions' else '/y' end")
    label = F.expr("case when member_id % 12 = 2 then 'Contact us' when member_id % 12 = 5 then 'What we do' else 'More' end")
    return m.select(F.lower(F.regexp_extract("website", r"^(https?://[^/?#]+)", 1)).alias("site"), F.col("member_id").alias("pos"), path.alias("path"), label.alias("text")).withColumn("href", F.concat("site", "path"))


def _captures(s, d):
    n = _m(s, d).where("source_url is not null").groupBy("source_url").agg(F.count("*").alias("records"))
    return n.join(load(s, d, "directories"), "source_url").select(F.concat("source_url", F.lit("?a=1&page=1")).alias("url"), F.lit("page").alias("param"), "records", F.coalesce("expected_count", F.lit(0)).alias("expected"))


QUERIES = {
    "label_strip": lambda s, d: _m(s, d).select("member_id", extract.without_annotations(extract.without_label(F.expr(_LABELLED))).alias("out")),
    "phone_phrase": _one(lambda: extract.phone_phrase(F.col("phone"))),
    "search_location": _one(lambda: extract.search_location(F.col("street_address"))),
    "social_platform": _one(lambda: extract.social_platform(F.expr(_SOCIAL))),
    "site_sections": lambda s, d: extract.sections(_links(s, d)),
    "registry_taxonomy": _one(lambda: extract.taxonomy(F.regexp_replace("category", "Dentist", "Dentists"))),
    "page_size": _one(lambda: extract.page_size(F.expr(_REQ))),
    "cursor_param": _one(lambda: extract.cursor_param(F.expr(_KEY), F.expr(_REQ))),
    "continuation": _one(lambda: extract.continuation(F.expr(_PAYLOAD))),
    "param_replace": _one(lambda: extract.with_param(F.expr(_REQ), "page", F.col("member_id"))),
    "replay_plan": lambda s, d: extract.next_requests(_captures(s, d)),
    "plan_queries": lambda s, d: extract.queries_of_plan(load(s, d, "nation").select(F.col("n_nationkey").alias("plan"), F.array(F.lower("n_name"), F.lit(" ")).alias("queries"), F.array(F.lit("growthzone"), F.lit("chamber.example")).alias("platforms"), F.lower("n_name").alias("industry"))),
    "shallow_data": lambda s, d: extract.shallow(_m(s, d)),
    "many_entries": lambda s, d: extract.many_entries(load(s, d, "documents").where("text is not null")),
    "starts_with_search": lambda s, d: extract.starts_with(_m(s, d).where("company_name is not null").select(F.col("source_url").alias("site"), F.lower(F.substring("company_name", 1, 1)).alias("letter"), F.col("company_name").alias("name"))),
    "count_evidence": lambda s, d: extract.count_evidence(load(s, d, "directories").select(F.col("source_url").alias("site"), F.col("expected_count").alias("expected"), F.lit(None).cast("bigint").alias("observed")).unionByName(_m(s, d).groupBy(F.col("source_url").alias("site")).agg(F.lit(None).cast("bigint").alias("expected"), F.count("*").alias("observed")))),
    "needs_enrichment": lambda s, d: extract.needs_enrichment(_m(s, d)),
    "dump_catalog": lambda s, d: extract.dump_catalog(load(s, d, "dump_files").select("dump_id", "file_name", "body").distinct()),
    "registry_pages": lambda s, d: extract.registry_pages(load(s, d, "registry_members").select(F.col("category").alias("query"), F.col("npi").alias("id"))),
    "selected_urls": lambda s, d: load(s, d, "directories").join(_m(s, d).where("website_source = 'ddg_search'").select("source_url"), "source_url", "left_semi").select("source_url", "title"),
    "vertical_counts": lambda s, d: _m(s, d).groupBy("enrichment_status", F.coalesce("website_source", F.lit("none")).alias("found_by")).agg(F.count("*").alias("n")),
    "striped_class": _one(lambda: extract.striped(F.expr("case member_id % 4 when 0 then 'odd' when 1 then ' Even  ROW1' when 2 then 'odd card' else '' end"))),
    "trivial_input": _one(lambda: extract.trivial(F.coalesce("phone", F.lit(" Hello!? ")))),
    "sign_in_page": _one(lambda: extract.sign_in_page(F.expr("case member_id % 3 when 0 then '<input TYPE=\"password\"> Log in, username' when 1 then '<input type=\"password\"> x' else 'sign in, login' end"))),
    "plural_words": lambda s, d: s.createDataFrame([(w,) for w in extract.DIRECTORY_WORDS], "word string").select(F.explode(extract.plurals(F.col("word"))).alias("word")),
    "panel_html": _one(lambda: extract.panel_html(F.expr("case when member_id % 2 = 0 then concat('1|#||4|9|updatePanel|p|', company_name, '|x') else company_name end"))),
    "result_target": _one(lambda: extract.unwrapped(F.expr("case member_id % 4 when 0 then concat('//d.example/l/?uddg=https%3A%2F%2Fx.example%2F', member_id, '&rut=1') when 1 then 'https://www.bing.com/ck/a?x=1&u=a1aHR0cHM6Ly94LmV4YW1wbGUvPz8' when 2 then 'https://y.example/' else '/local' end"))),
    "url_resolve": _one(lambda: extract.resolved(F.lit("https://x.example/a/b?c=1"), F.expr("case member_id % 8 when 0 then 'd' when 1 then '/e' when 2 then '?f=2' when 3 then 'https://y.example' when 4 then '//z.example/q' when 5 then 'mailto:a@b.c' when 6 then 'ftp://w' else '#top' end"))),
    "registry_address": lambda s, d: load(s, d, "customer").select("c_custkey", extract.registry_address(F.col("c_name"), F.lit(" "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.lit("WA"), F.col("c_nationkey").cast("string")).alias("address")),
    "head_tail": lambda s, d: load(s, d, "documents").select("doc_id", extract.head_tail(F.col("text"), 50).alias("sample")),
    "stayed_on_listing": _one(lambda: extract.stayed(F.lit("https://x.example/dir/find"), F.expr("case member_id % 6 when 0 then 'https://x.example/dir/find?page=2' when 1 then 'https://x.example/dir/search' when 2 then 'https://x.example/dir/details/acme' when 3 then 'https://x.example/dir/find/-npage-2' when 4 then 'https://x.example/news' else 'https://x.example/dir' end"))),
    "pipeline_parse": lambda s, d: pipelines.parse_pages(web_queries.render(_m(s, d)), "#list > .card", {"company_name": "h3", "phone": "a.tel@href", "street_address": ".addr"}).groupBy("tier").agg(F.count("*").alias("records")),
    "pipeline_gates": lambda s, d: pipelines.structured(_m(s, d), load(s, d, "directories")),
    "pipeline_export": lambda s, d: pipelines.export(_m(s, d), pipelines.structured(_m(s, d), load(s, d, "directories"))).groupBy("source_url").agg(F.count("*").alias("records")),
    "pipeline_discover": lambda s, d: pipelines.discover(web_queries._hits(s, d), load(s, d, "documents").where("text is not null").select(F.concat(F.lit("https://"), "site", F.lit("/")).alias("url"), "text", F.lit(False).alias("js_shell"), F.lit(True).alias("contact"))),
    "pipeline_enrich": lambda s, d: pipelines.enrich(_m(s, d), load(s, d, "registry_members"), "healthcare", ["WA", "OR", "ID"]),
    "priority_coverage": lambda s, d: _m(s, d).groupBy("source_url").agg(F.count_if(F.col("phone") != "").alias("phone"), F.count_if(F.col("website") != "").alias("website"), F.count_if(F.coalesce(F.size("social_media") > 0, F.lit(False))).alias("social")),
}

_SP = "[\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_DG = "regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')"
_D10 = f"case when length({_DG}) = 10 then {_DG} when length({_DG}) = 11 and {_DG}[1] = '1' then substr({_DG}, 2) end"
_PARTS = f"list_transform(string_split(street_address, ','), lambda x: regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g'))"
_LEFT = f"list_filter({_PARTS}, lambda x: not regexp_matches(x, '^\\d') and not regexp_matches(x, '(?i)^p\\.?o\\.?\\s*box'))"
_CODES = f"list_filter(regexp_extract_all(street_address, '\\b([A-Z]{{2}})\\b', 1), lambda x: x not in ({', '.join(chr(39) + x + chr(39) for x in extract.NOT_STATES)}))[1]"
_TAX = "case " + " ".join(f"when c in ('{k}', '{k}s') then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in extract.TAXONOMIES.items()) + " " + " ".join(f"when contains(c, '{k}') then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in extract.TAXONOMIES.items()) + " end"
_F = lambda c: f"coalesce(trim({c}, ' ') <> '', false)"
_MAIL = "coalesce(list_bool_or(list_transform(contacts, lambda x: coalesce(x.email <> '', false))), false)"

_LOC = f"with a as (select *, trim(coalesce(street_address, '') || ' ' || coalesce(mailing_address, ''), ' ') as a from members), z as (select *, list_filter(regexp_extract_all(a, '\\b([A-Z]{{2}})\\s+\\d{{5}}(?:-\\d{{4}})?\\b', 1), lambda x: x in {record_queries._in(rules.STATES)}) as z from a), f as (select *, case when len(z) > 0 then z else list_filter([regexp_extract(a, ',\\s*([A-Z]{{2}})\\s*$', 1)], lambda x: x in {record_queries._in(rules.STATES)}) end as f from z), near as (select * from f where len(f) = 0 or list_has_any(f, ['WA', 'OR', 'ID']))"
_RKEY = record_queries._key("company_name") + " || coalesce('|' || nullif(regexp_extract(street_address, '\\b([A-Z]{2})\\s+\\d{5}', 1), ''), '')"

SQL = {
    "striped_class": "select member_id, member_id % 4 in (0, 1) as out from members",
    "trivial_input": "select member_id, length(regexp_replace(lower(trim(phone, ' ')), '^[?.!,''\" ]+|[?.!,''\" ]+$', '', 'g')) < 2 or phone is null as out from (select member_id, phone from members where phone is not null) union all select member_id, true from members where phone is null",
    "sign_in_page": "select member_id, member_id % 3 = 0 as out from members",
    "plural_words": "with w as (select unnest([" + ", ".join(f"'{w}'" for w in extract.DIRECTORY_WORDS) + "]) as word) select word from w union all select case when regexp_matches(word, '[aeiou]y$') then word || 's' when ends_with(word, 'y') then word[:-2] || 'ies' when ends_with(word, 's') then word || 'es' else word || 's' end from w",
    "panel_html": "select member_id, case when member_id % 2 = 0 then company_name || '|x' else company_name end as out from members",
    "result_target": "select member_id, case member_id % 4 when 0 then 'https://x.example/' || member_id when 1 then 'https://x.example/??' when 2 then 'https://y.example/' end as out from members",
    "url_resolve": "select member_id, case member_id % 8 when 0 then 'https://x.example/a/d' when 1 then 'https://x.example/e' when 2 then 'https://x.example/a/b?f=2' when 3 then 'https://y.example' when 4 then 'https://z.example/q' end as out from members",
    "registry_address": "select c_custkey, concat_ws(', ', c_name, case when c_custkey % 2 = 0 then c_mktsegment end, 'WA ' || c_nationkey) as address from customer",
    "head_tail": f"with s as (select doc_id, trim(regexp_replace(text, '{_SP}+', ' ', 'g'), ' ') as s from documents) select doc_id, case when length(s) <= 100 then s else substr(s, 1, 50) || ' … ' || right(s, 50) end as sample from s",
    "stayed_on_listing": "select member_id, member_id % 6 in (0, 1, 3, 5) as out from members",
    "pipeline_gates": record_queries._CLEANED + f", m as (select source_url, count(*) as records, count(c.member_id) as cleaned, (avg(({record_queries._filled('members.phone')} or {record_queries._filled('members.website')} or {record_queries._filled('members.street_address')} or {record_queries._filled('members.mailing_address')} or {record_queries._MAIL.replace('contacts', 'members.contacts')})::int) < 0.05 or avg({record_queries._false('members.company_name')}::int) > 0.3) as garbage from members left join (select member_id from c) c using (member_id) where source_url is not null group by 1) select m.source_url, records, cleaned, garbage, coalesce(expected_count > 0 and cleaned >= 3 and expected_count <= 10 * greatest(records, cleaned) and cleaned < 0.8 * expected_count, false) as partial from m left join directories d on d.source_url = m.source_url",
    "pipeline_export": record_queries._CONS.replace("with k0 as (select *,", "with good as (select source_url from members where source_url is not null group by 1 having not (avg((" + " or ".join(record_queries._filled(c) for c in ("phone", "website", "street_address", "mailing_address")) + f" or {record_queries._MAIL})::int) < 0.05 or avg({record_queries._false('company_name')}::int) > 0.3)), k0 as (select *,").replace(" from members), k as", " from members semi join good using (source_url)), k as") + " select source_url, count(*) as records from h group by 1",
    "pipeline_enrich": _LOC + f", r as (select {_RKEY} as k, arg_min({{'p': phone, 'f': fax}}, npi) as r from registry_members where company_name is not null group by 1), j as (select near.*, r.r as r from near left join r on r.k = {_RKEY.replace('company_name', 'near.company_name').replace('street_address', 'near.street_address')}) select member_id, 'healthcare' as vertical, coalesce(nullif(phone, ''), r.p) as phone, coalesce(nullif(fax, ''), r.f) as fax, case when r is not null and not (coalesce(phone <> '', false) and coalesce(fax <> '', false)) then 'enriched' else 'complete' end as status from j",
    "label_strip": f"select member_id, trim(regexp_replace(regexp_replace(case when company_name is not null then {_LABELLED} end, '(?i)^(?:phone|tel|telephone|fax|email|e-mail|website|web|url|address|street address|mailing address|category|type|specialty)\\s*:\\s*', ''), '(?i)\\(\\s*link\\s+(?:sends\\s+e-?mail|is\\s+external)\\s*\\)|\\(\\s*opens\\s+in\\s+(?:a\\s+)?new\\s+(?:tab|window)\\s*\\)', '', 'g'), ' ') as out from members",
    "phone_phrase": f"select member_id, case when {_D10} is not null then '\"(' || substr({_D10}, 1, 3) || ') ' || substr({_D10}, 4, 3) || '-' || substr({_D10}, 7, 4) || '\"' end as out from members",
    "search_location": f"select member_id, case when coalesce(street_address, '') = '' then '' when len({_LEFT}) > 0 then array_to_string({_LEFT}, ' ') else coalesce({_CODES}, '') end as out from members",
    "social_platform": "select member_id, case member_id % 5 when 0 then 'facebook' when 1 then 'twitter' when 3 then 'linkedin' when 4 then 'facebook' end as out from members",
    "site_sections": "with l as (select lower(regexp_extract(website, '^(https?://[^/?#]+)', 1)) as site, member_id as pos, case member_id % 6 when 0 then '/contact-us/' when 1 then '/who-we-are' when 2 then '/x' when 3 then '/our-team/a' when 4 then '/solutions' else '/y' end as path from members where website like 'http%'), s as (select site, pos, site || path as href, case when pos % 6 = 0 or pos % 12 = 2 then 'contact' when pos % 6 = 1 then 'about' when pos % 6 = 3 then 'team' when pos % 6 = 4 or pos % 12 = 5 then 'services' end as section from l where regexp_matches(site, '^https?://.')) select site, section, arg_min(href, pos) as href from s where section is not null group by 1, 2",
    "registry_taxonomy": f"select member_id, {_TAX} as out from (select member_id, trim(regexp_replace(lower(replace(category, 'Dentist', 'Dentists')), '{_SP}+', ' ', 'g'), ' ') as c from members)",
    "page_size": "select member_id, case when member_id % 3 in (0, 1) and member_id % 50 > 0 then (member_id % 50)::int else 20 end as out from members",
    "cursor_param": "select member_id, case when member_id % 5 = 0 then 'pageToken' when member_id % 4 = 0 then 'pageToken' when member_id % 4 = 1 then 'cursor' when member_id % 4 = 2 then 'cursor' else 'after' end as out from members",
    "continuation": "select member_id, case member_id % 5 when 0 then '/p/2' when 1 then 'tok' when 2 then 'c9' end as out from members",
    "param_replace": f"select member_id, replace(regexp_replace(r, '&page=1(&|$)', '\\1'), '&&', '&') || '&page=' || member_id as out from (select member_id, {_REQ} as r from members)",
    "replay_plan": "with n as (select source_url, count(*) as n from members where source_url is not null group by 1), c as (select source_url || '?a=1&page=1' as url, n, coalesce(expected_count, 0) as e from n join directories using (source_url)), p as (select url, case when e > 0 then ceil(e * 1.2 / n)::int else 30 end as pages from c) select url, i::int as page, replace(url, 'page=1', 'page=' || i) as request from (select url, pages, unnest(range(2, greatest(pages, 1) + 1)) as i from p)",
    "plan_queries": "with p as (select n_nationkey as plan, lower(n_name) as i from nation) select plan, 0 as pos, i as query from p union all select plan, 1, 'site:growthzoneapp.com ' || i from p union all select plan, 2, 'site:chamber.example ' || i from p",
    "shallow_data": f"select source_url as site, avg(({_F('phone')} or {_F('website')} or {_F('fax')} or {_F('street_address')})::int) < 0.2 as shallow from members group by 1",
    "starts_with_search": "with n as (select source_url as site, lower(substr(company_name, 1, 1)) as letter, company_name as name from members where company_name is not null and length(company_name) between 3 and 199) select site, letter, count(*) >= 3 and avg(starts_with(lower(name), letter)::int) > 0.8 as prefix_search from n group by 1, 2",
    "count_evidence": "select coalesce(m.site, d.source_url) as site, d.expected_count as expected, m.n as observed from (select source_url as site, count(*) as n from members group by 1) m full join directories d on m.site = d.source_url",
    "needs_enrichment": f"select member_id, not coalesce(trim(website, ' ') <> '', false) or not (coalesce(description <> '', false) and coalesce(phone <> '', false) and {_MAIL}) as needs from members",
    "dump_catalog": "with d as (select distinct dump_id, file_name, ltrim(replace(body, chr(65279), ''))::json as j from dump_files where ends_with(file_name, '_structured.json') and not contains(file_name, '_detail_structured')), m as (select dump_id, file_name, case when json_type(j) = 'ARRAY' then j else j->'members' end as l from d), r as (select dump_id, file_name, l->i as r from (select dump_id, file_name, l, unnest(range(0, json_array_length(l)::bigint)) as i from m)) select dump_id, file_name, count(*) as members, count(*) filter (coalesce(r->>'phone', '') = '') as no_phone, count(*) filter (coalesce(r->>'website', '') = '') as no_website from r group by 1, 2",
    "registry_pages": "select category as query, least(count(distinct npi), 1200) as rows, count(distinct npi) > 1200 as hit_ceiling from registry_members group by 1",
    "selected_urls": "select source_url, title from directories where source_url in (select source_url from members where website_source = 'ddg_search' and source_url is not null)",
    "vertical_counts": "select enrichment_status, coalesce(website_source, 'none') as found_by, count(*) as n from members group by 1, 2",
    "priority_coverage": "select source_url, count(*) filter (phone <> '') as phone, count(*) filter (website <> '') as website, count(*) filter (coalesce(cardinality(social_media) > 0, false)) as social from members group by 1",
}
