"""Queries of the record operators over the domain's tables, with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import rules
from rollbook.functions import text as t
from rollbook.operators import clean, intent, merge
from rollbook.work import load


def _m(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "members")


def _scalar(make, *cols: str):
    """A query of one scalar rule over all members."""
    return lambda s, d: _m(s, d).select("member_id", *cols, make())


def _people(s: SparkSession, d: str) -> DataFrame:
    c = _m(s, d).select("member_id", "phone", F.posexplode("contacts").alias("pos", "c"))
    return c.select((F.col("member_id") * 1000 + F.col("pos")).alias("seq"), F.col("c.name").alias("full_name"), F.col("c.email").alias("email"), "phone", F.lit("  Member ").alias("title"))


def _products(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "part")
    return p.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("model"), F.col("p_brand").alias("brand"), F.concat(F.lower("p_brand"), F.lit(".example")).alias("link"), F.lpad(F.col("p_partkey").cast("string"), 10, "2").alias("hotline"))


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("names", clean.joined(F.col("contacts"), "name")).withColumn("emails", clean.joined(F.col("contacts"), "email")).drop("contacts")


def _counts(s: SparkSession, d: str) -> DataFrame:
    m = _m(s, d).groupBy("source_url").agg(F.count("*").alias("observed"), F.countDistinct(t.name_key(F.col("company_name"))).alias("cleaned"))
    return load(s, d, "directories").join(m, "source_url").select("source_url", F.col("expected_count").alias("expected"), "cleaned", "observed")


def _detail(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "registry_members").select(F.col("npi").alias("id"), F.coalesce(t.name_key(F.col("company_name")), F.lit("")).alias("key"))


def _listing(s: SparkSession, d: str) -> DataFrame:
    return _m(s, d).select(F.col("member_id").alias("id"), F.coalesce(t.name_key(F.col("company_name")), F.lit("")).alias("key"))


def _registry_by_phone(s: SparkSession, d: str) -> DataFrame:
    r = load(s, d, "registry_members").withColumn("p", t.digits(F.col("phone"))).where("length(p) = 10")
    return r.groupBy("p").agg(F.min_by(F.struct("fax", "mailing_address"), "npi").alias("r")).select("p", "r.*")


def _pages(s: SparkSession, d: str) -> DataFrame:
    m = _m(s, d).where("website is not null")
    return m.select(F.col("website").alias("site"), F.col("member_id").alias("pos"), "fax", F.col("street_address").alias("address"), "description", "hours", "founded")


def _gap(s: SparkSession, d: str) -> DataFrame:
    m = _m(s, d).select("member_id", t.digits(F.col("phone")).alias("p"), "fax", "mailing_address")
    return merge.gap_fill(m, _registry_by_phone(s, d), "p", ["fax", "mailing_address"])


def _zip(s: SparkSession, d: str) -> DataFrame:
    """Members and registry rows by position within a category."""
    w = lambda df, k: df.withColumn("pos", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("page").orderBy(k)))
    a = w(_m(s, d).where("category is not null").select(F.col("category").alias("page"), "member_id", "phone", "website"), "member_id")
    b = w(load(s, d, "registry_members").where("category is not null").select(F.col("category").alias("page"), "npi", "phone", "website"), "npi")
    return merge.positional_merge(a.select("page", "pos", "phone", "website"), b.select("page", "pos", "phone", "website"), ["phone", "website"])


QUERIES = {
    "phone_format": _scalar(lambda: t.phone_format(F.col("phone")).alias("out")),
    "website_normalize": _scalar(lambda: t.website_normalize(F.col("website")).alias("out")),
    "category_slug": _scalar(lambda: t.category_text(F.col("category")).alias("out")),
    "name_key": _scalar(lambda: t.name_key(F.col("company_name")).alias("out")),
    "export_name_key": _scalar(lambda: t.export_key(F.col("company_name")).alias("out")),
    "company_words": _scalar(lambda: F.array_join(t.company_words(F.col("company_name")), " ").alias("out")),
    "address_state": _scalar(lambda: t.state_of(F.col("street_address")).alias("out")),
    "url_clean": _scalar(lambda: t.url_clean(F.col("website")).alias("out")),
    "label_reject": _scalar(lambda: t.is_label(F.col("company_name")).alias("out")),
    "false_name_reject": _scalar(lambda: t.is_false_name(F.col("company_name")).alias("out")),
    "vertical_heuristic": _scalar(lambda: intent.vertical(F.col("category"), F.col("company_name")).alias("out")),
    "person_email": lambda s, d: _people(s, d).select("seq", t.person_email(F.col("email")).alias("out")),
    "person_name_parts": lambda s, d: _people(s, d).select("seq", t.person_parts(F.col("full_name")).alias("out")),
    "email_domain_site": lambda s, d: _m(s, d).select("member_id", F.get(F.filter(F.transform("contacts", lambda c: F.substring_index(F.lower(F.trim(c["email"])), "@", -1)), lambda h: F.coalesce(h.contains(".") & ~h.contains(" ") & ~h.isin(*rules.FREE_MAIL), F.lit(False))), F.lit(0)).alias("host")),
    "host_root": lambda s, d: _m(s, d).select("member_id", t.host_root(t.host_of(F.col("source_url"))).alias("out")),
    "layout_fingerprint": lambda s, d: load(s, d, "directories").select("source_url", t.layout_fingerprint(F.coalesce("title", F.lit("")), F.array(F.coalesce("name_field", F.lit("")), F.coalesce("entity_type", F.lit("")))).alias("fingerprint")),
    "clean_business": lambda s, d: _joined(clean.clean_business(_m(s, d))),
    "shared_email_prune": lambda s, d: _joined(clean.prune_shared_emails(_m(s, d).select("member_id", "source_url", clean.clean_contacts(F.col("contacts")).alias("contacts")), "source_url")).select("member_id", "names", "emails"),
    "contact_dedup": lambda s, d: _joined(_m(s, d).select("member_id", clean.clean_contacts(F.col("contacts")).alias("contacts"))),
    "clean_person": lambda s, d: clean.clean_person(_people(s, d)),
    "clean_dynamic": lambda s, d: clean.clean_dynamic(_products(s, d), "model", {"link": "url", "hotline": "phone"}),
    "garbage_gate": lambda s, d: clean.garbage_gate(_m(s, d)),
    "garbage_gate_dynamic": lambda s, d: clean.garbage_gate_dynamic(_products(s, d), "brand", "model", ["hotline"]),
    "extraction_valid": lambda s, d: clean.extraction_valid(_m(s, d)),
    "count_gate": lambda s, d: clean.count_gate(_counts(s, d)),
    "name_only_ratio": lambda s, d: clean.name_only(_m(s, d)),
    "location_filter": lambda s, d: clean.location_filter(_m(s, d), ["WA", "OR"]).select("member_id"),
    "coverage_business": lambda s, d: clean.coverage(_m(s, d)),
    "coverage_dynamic": lambda s, d: clean.field_coverage(_products(s, d), ["model", "brand", "link"]),
    "sparse_fields": lambda s, d: clean.sparse_fields(_m(s, d).select("source_url", F.col("fax").alias("phone"), F.col("founded").alias("website")), _m(s, d).select("source_url", "phone", "website"), "source_url", ["phone", "website"]),
    "field_presence": lambda s, d: clean.field_presence(_m(s, d), ["phone", "website", "description"]),
    "consolidate_members": lambda s, d: _joined(merge.consolidate(_m(s, d))),
    "export_metadata": lambda s, d: merge.export_metadata(_m(s, d)),
    "final_sort": lambda s, d: merge.final_order(merge.consolidate(_m(s, d)), 200).select("sort_key", "first_id"),
    "final_sort_all": lambda s, d: merge.positions(merge.final_order(merge.consolidate(_m(s, d))).select("sort_key", "first_id")),
    "flatten_csv": lambda s, d: merge.flatten_record(_m(s, d)),
    "csv_columns": lambda s, d: merge.used_columns(merge.flatten_record(_m(s, d))),
    "listing_detail_anti": lambda s, d: merge.listing_minus_detail(_listing(s, d), _detail(s, d)),
    "positional_merge": _zip,
    "enrich_gap_fill": _gap,
    "enrich_status": lambda s, d: merge.enrichment_status(_m(s, d)),
    "page_merge": lambda s, d: merge.merge_pages(_pages(s, d)),
    "website_backfill": lambda s, d: merge.backfill_website(_m(s, d), _m(s, d).where("enrichment_source is not null").select("member_id", F.col("enrichment_source").alias("website"))),
    "latest_layouts": lambda s, d: merge.latest_layouts(load(s, d, "dump_files").select(F.col("source_url").alias("domain"), F.substring("file_name", 1, 8).alias("fingerprint"), F.col("scraped_at").alias("learned_at"))),
    "intent_filter_failopen": lambda s, d: intent.filter_by_classifier(_m(s, d), lambda keys: [True] * 0).select("member_id"),
}

_SP = "[\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'), ' ')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def _phone(x: str) -> str:
    d = _digits(x)
    form = "'(' || substr(D, {a}, 3) || ') ' || substr(D, {b}, 3) || '-' || substr(D, {c}, 4)"
    return f"case when length({d}) = 10 then {form.format(a=1, b=4, c=7).replace('D', d)} when length({d}) = 11 and {d}[1] = '1' then {form.format(a=2, b=5, c=8).replace('D', d)} else nullif({_strip(x)}, '') end"


def _site(x: str) -> str:
    return f"case when {x} = '' then '' when starts_with({x}, 'http') then {x} when regexp_matches({x}, '^[\\pL\\pN_.-]+\\.[a-z]{{2,}}') then 'https://' || {x} end"


def _key(x: str) -> str:
    k = _ws(f"regexp_replace(replace({_ws(f'lower({x})')}, ',', ' '), '[.]', '', 'g')")
    k = f"regexp_replace({k}, '[.,;:!?\\-\\s]+$', '')"
    for full, short in rules.SUFFIXES.items():
        k = f"regexp_replace({k}, '(^| ){full}$', '\\1{short}')"
    return k


def _ekey(x: str) -> str:
    return f"lower(regexp_replace({_ws(f'coalesce({x}, chr(32))')}, '^[.,]+|[.,]+$', '', 'g'))"


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _any(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _label(x: str) -> str:
    s = f"lower(regexp_replace(regexp_replace({_strip(x)}, '^:+|:+$', '', 'g'), '^[ \\t\"''*•·\\-—]+|[ \\t\"''*•·\\-—]+$', '', 'g'))"
    return f"({x} is null or {s} = '' or {s} in {_in(rules.LABEL_WORDS)})"


def _false(x: str) -> str:
    s = f"lower({_strip(x)})"
    return f"({x} is null or {s} = '' or contains({s}, '?') or {s} in {_in(rules.GENERIC_WORDS)} or {_any(s, rules.FALSE_NAME_PHRASES)} or {' or '.join(f'starts_with({s}, {chr(39)}{p}{chr(39)})' for p in rules.FALSE_NAME_PREFIXES)})"


def _contacts(c: str = "contacts") -> str:
    """Cleaned contacts as a list of structs."""
    tidy = f"list_transform(coalesce({c}, []), lambda x: {{'name': nullif({_ws('x.name')}, ''), 'email': nullif({_strip('lower(x.email)')}, '')}})"
    some = f"list_filter({tidy}, lambda x: x.name is not null or x.email is not null)"
    return f"list_filter({some}, lambda x, i: x.email is null or list_position(list_transform({some}, lambda y: y.email), x.email) = i)"


def _join(c: str, f: str) -> str:
    return f"coalesce(array_to_string(list_transform({c}, lambda x: coalesce(x.{f}, '-')), '; '), '')"


def _filled(x: str) -> str:
    return f"coalesce({x} <> '', false)"


_MAIL = "coalesce(list_bool_or(list_transform(contacts, lambda x: coalesce(x.email <> '', false))), false)"
_WHO = "coalesce(list_bool_or(list_transform(contacts, lambda x: coalesce(x.email <> '', false) or coalesce(x.name <> '', false))), false)"
_P = "with people as (select member_id * 1000 + i - 1 as seq, contacts[i].name as full_name, contacts[i].email as email, phone from (select member_id, phone, contacts, unnest(range(1, len(contacts) + 1)) as i from members))"
_MAILBOX = f"nullif(regexp_extract(lower(case when starts_with(lower({_strip('email')}), 'mailto:') then trim(regexp_replace(substr({_strip('email')}, 8), '\\?.*$', ''), ' ') else {_strip('email')} end), '[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{{2,}}'), '')"
_NOISE = "'(?i)^(?:dr|mr|mrs|ms|prof|rev)\\.?\\s+|[,\\s]+(?:md|dds|dmd|phd|cpa|esq|mba|pe|rn|do|dc)\\.?$', '', 'g'"
_PARTS = f"string_split(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(full_name, ' '), {_NOISE}), ' '), {_NOISE}), ' '), {_NOISE}), ' '), '[,.\\s]+', ' ', 'g'), ' '), ' ')"
_HOST = "nullif(regexp_replace(lower(regexp_extract(U, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www\\.', '', 'g'), '')"
_SRC = _HOST.replace("U", "source_url")
_PASTE = "trim(regexp_replace(trim(website, ' '), '^[<>\"'']+|[<>\"'']+$', '', 'g'), ' ')"
_MK = f"with k0 as (select *, {_ekey('company_name')} as nk, coalesce(nullif(phone, ''), nullif(website, ''), contacts[1].email) as other from members), k as (select *, case when nk <> '' then nk when coalesce(other, '') <> '' then '~anon~' || {_ekey('other')} end as k from k0)"


def _first(f: str) -> str:
    return f"nullif({_ws(f'arg_min({f}, member_id) filter ({_filled(f)})')}, '') as {f}"


_MC = f"list_filter(list_transform(flatten(list(coalesce(contacts, []) order by member_id)), lambda x: {{'name': nullif({_ws('x.name')}, ''), 'email': nullif({_ws('x.email')}, '')}}), lambda x: x.name is not null or x.email is not null)"
_CONS = _MK + f", g as (select k, min(member_id) as first_id, count(*) as rows, {', '.join(_first(f) for f in merge.FIELDS)}, {_MC} as cs from k where k is not null group by k), h as (select * exclude (cs), list_filter(cs, lambda x, i: list_position(list_transform(cs, lambda y: lower(coalesce(y.name, '')) || '|' || lower(coalesce(y.email, ''))), lower(coalesce(x.name, '')) || '|' || lower(coalesce(x.email, ''))) = i) as contacts from g)"
_STATE_SQL = f"list_filter(regexp_extract_all(a, '\\b([A-Z]{{2}})\\s+\\d{{5}}(?:-\\d{{4}})?\\b', 1), lambda x: x in {_in(rules.STATES)})"


def _flat() -> str:
    cols = [f"coalesce({_strip(c)}, '') as {c}" for c in ("company_name", "category", "website", "phone", "fax", "founded")]
    who = lambda f: f"coalesce(array_to_string(list_transform(list_filter(contacts, lambda x: coalesce(x.{f} <> '', false)), lambda x: x.{f}), '; '), '')"
    soc = [f"coalesce(social_media['{p}'], '') as {p}" for p in merge.PLATFORMS]
    team = "coalesce(array_to_string(list_transform(team, lambda x: coalesce(x.name, '') || case when coalesce(x.title <> '', false) then ' (' || x.title || ')' else '' end), '; '), '') as team"
    return f"select member_id, {', '.join(cols + soc)}, {who('name')} as contact_name, {who('email')} as contact_email, coalesce(array_to_string(services, ', '), '') as services, {team} from members"


_CLEANED = f"""with n as (select *, {_ws('company_name')} as cn from members), ok as (select * from n where cn <> '' and not {_label('cn')} and not {_false('cn')}),
k as (select *, {_key('cn')} as nk, {_digits('phone')} as dg from ok), f as (select *, row_number() over (partition by nk || case when dg <> '' then '|' || dg else '' end order by member_id) as rn from k where nk <> ''),
c as (select *, {_contacts()} as cc from f where rn = 1)"""
_PRODUCTS = "with p as (select p_partkey as seq, p_name as model, p_brand as brand, lower(p_brand) || '.example' as link, lpad(p_partkey::varchar, 10, '2') as hotline from part)"
_VERT = f"case when regexp_matches(n, '(?i),?\\s*esq\\.?\\s*$') then 'lawyer' when regexp_matches(n, '(?i)(?:,\\s*|\\s+)(?:dds|dmd|md|do|phd|dvm|dpm|od|optometrist)\\.?\\s*$') then 'healthcare' when {_any('c', intent.HEALTHCARE)} then 'healthcare' when {_any('c', intent.LAWYER)} then 'lawyer' when {_any('c', intent.REAL_ESTATE)} then 'real_estate' when regexp_matches(n, '(?i)^\\s*dr\\.?\\s+') then 'healthcare' else 'business' end"

SQL = {
    "phone_format": f"select member_id, {_phone('phone')} as out from members",
    "website_normalize": f"select member_id, {_site('website')} as out from members",
    "category_slug": "select member_id, case when not (starts_with(category, '/') or regexp_matches(category, '^https?://')) then category end as out from members",
    "name_key": f"select member_id, {_key('company_name')} as out from members",
    "export_name_key": f"select member_id, {_ekey('company_name')} as out from members",
    "company_words": f"select member_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(company_name), '[^\\pL\\pM\\pN_]', ' ', 'g'), ' '), '\\s+'), lambda x: x not in {_in(rules.BUSINESS_SUFFIXES)} and (length(x) >= 3 or regexp_matches(x, '^\\d{{2,}}$'))))), ' ') as out from members",
    "address_state": "select member_id, nullif(regexp_extract(street_address, '\\b([A-Z]{2})\\s+\\d{5}', 1), '') as out from members",
    "url_clean": f"with p as (select member_id, case when starts_with({_PASTE}, '//') then 'https:' || {_PASTE} else {_PASTE} end as s from members), q as (select member_id, s, lower(regexp_extract(s, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) as scheme from p), r as (select member_id, case when scheme = '' then 'https://' || s when scheme in ('http', 'https') then scheme || regexp_extract(s, '^[^:]*(://.*)$', 1) end as u from q), h as (select *, regexp_extract(u, '^https?://(?:[^@/?#]*@)?([^/?#:]*)', 1) as host, regexp_extract(u, '^https?://([^/?#]*)', 1) as loc from r) select member_id, case when host <> '' and not contains(loc, ' ') and (contains(host, '.') or host = 'localhost') then u end as out from h",
    "label_reject": f"select member_id, {_label('company_name')} as out from members",
    "false_name_reject": f"select member_id, {_false('company_name')} as out from members",
    "vertical_heuristic": f"select member_id, {_VERT} as out from (select member_id, lower(coalesce(category, '')) as c, trim(coalesce(company_name, ''), ' ') as n from members)",
    "person_email": _P + f" select seq, {_MAILBOX} as out from people",
    "person_name_parts": _P + f" select seq, case when len({_PARTS}) >= 2 then {_PARTS}[1] || '|' || {_PARTS}[-1] end as out from people",
    "email_domain_site": f"select member_id, list_filter(list_transform(contacts, lambda c: regexp_extract(lower(trim(c.email, ' ')), '([^@]*)$', 1)), lambda h: contains(h, '.') and not contains(h, ' ') and h not in {_in(rules.FREE_MAIL)})[1] as host from members",
    "host_root": f"select member_id, case when length(regexp_replace(h, '[^.]', '', 'g')) >= 2 then regexp_extract(h, '([^.]*\\.[^.]*)$', 1) else h end as out from (select member_id, {_SRC} as h from members)",
    "layout_fingerprint": "select source_url, substr(sha1(coalesce(title, '') || '|' || array_to_string(list_sort([coalesce(name_field, ''), coalesce(entity_type, '')]), ',')), 1, 16) as fingerprint from directories",
    "clean_business": _CLEANED + f" select member_id, cn as company_name, {_phone('phone')} as phone, {_phone('fax')} as fax, {_site('website')} as website, case when not (starts_with(category, '/') or regexp_matches(category, '^https?://')) then category end as category, street_address, case when street_address <> '' and mailing_address <> '' and {_strip('street_address')} = {_strip('mailing_address')} then null else mailing_address end as mailing_address, {_join('cc', 'name')} as names, {_join('cc', 'email')} as emails from c",
    "contact_dedup": f"select member_id, {_join('cc', 'name')} as names, {_join('cc', 'email')} as emails from (select member_id, {_contacts()} as cc from members)",
    "shared_email_prune": f"""with c as (select member_id, coalesce(source_url, '~') as g, {_contacts()} as cc from members), e as (select distinct g, member_id, unnest(cc).email as e from c), n as (select g, count(*) as n from c group by g),
bad as (select e.g, e.e from e join n using (g) where e.e is not null and e.g <> '~' group by e.g, e.e, n.n having count(*) >= 5 and count(*) / n.n >= 0.2), b as (select g, list(e) as bad from bad group by g),
k as (select member_id, list_filter(cc, lambda x: not (coalesce(list_contains(bad, x.email), false) and x.name is null)) as cc, bad from c left join b using (g)),
p as (select member_id, list_transform(cc, lambda x: {{'name': x.name, 'email': case when coalesce(list_contains(bad, x.email), false) then null else x.email end}}) as cc from k) select member_id, {_join('cc', 'name')} as names, {_join('cc', 'email')} as emails from p""",
    "clean_person": _P + f", a as (select seq, {_ws('full_name')} as full_name, {_MAILBOX} as email, phone from people), b as (select *, {_key('full_name')} as k from a where full_name <> '' and not {_label('full_name')} and not regexp_matches(full_name, '^[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}$') and not regexp_matches(lower(full_name), '^(?:https?://|www\\.)')), c as (select *, row_number() over (partition by k, coalesce(email, '') order by seq) as rn from b where k <> '') select seq, full_name, email, {_phone('phone')} as phone, 'Member' as title from c where rn = 1",
    "clean_dynamic": _PRODUCTS + f", k as (select seq, {_ws('model')} as model, brand, link, hotline, row_number() over (partition by {_key('model')} order by seq) as rn from p where {_ws('model')} <> '' and {_key('model')} <> '') select seq, model, brand, case when not starts_with(link, 'http') and regexp_matches(link, '^[\\pL\\pN_.-]+\\.[a-z]{{2,}}') then 'https://' || link else link end as link, {_phone('hotline')} as hotline from k where rn = 1",
    "garbage_gate": f"select source_url, count(*) as records, (avg(({_filled('phone')} or {_filled('website')} or {_filled('street_address')} or {_filled('mailing_address')} or {_MAIL})::int) < 0.05 or avg({_false('company_name')}::int) > 0.3) as garbage from members group by source_url",
    "garbage_gate_dynamic": _PRODUCTS + " select brand, count(*) as records, avg((coalesce(model <> '', false) and coalesce(hotline <> '', false))::int) < 0.3 as garbage from p group by brand",
    "extraction_valid": "select source_url, count(*) as records, (count(*) filter (company_name <> '') >= greatest(3, floor(count(*) * 0.8)) or sum(" + " + ".join(f"(not coalesce({c} <> '', false))::int" for c in clean.SCALARS) + ") / (count(*) * 5) < 0.7) as valid from members group by source_url",
    "count_gate": f"with m as (select source_url, count(*) as observed, count(distinct {_key('company_name')}) as cleaned from members group by 1), j as (select source_url, expected_count as e, cleaned, observed from directories join m using (source_url)) select source_url, e as expected, cleaned as extracted from j where e > 0 and cleaned >= 3 and e <= 10 * greatest(observed, cleaned) and cleaned < 0.8 * e",
    "name_only_ratio": f"with r as (select source_url, round(avg(({_filled('company_name')} and not ({_filled('phone')} or {_filled('street_address')} or {_filled('mailing_address')} or {_WHO}))::int), 6) as name_only from members group by 1) select source_url, name_only, name_only >= 0.7 as shallow from r",
    "location_filter": f"with a as (select member_id, trim(coalesce(street_address, '') || ' ' || coalesce(mailing_address, ''), ' ') as a from members), s as (select member_id, a, {_STATE_SQL} as z from a), f as (select member_id, case when len(z) > 0 then z else list_filter([regexp_extract(a, ',\\s*([A-Z]{{2}})\\s*$', 1)], lambda x: x in {_in(rules.STATES)}) end as f from s) select member_id from f where len(f) = 0 or list_has_any(f, ['WA', 'OR'])",
    "coverage_business": f"select count(*) as total_members, count(*) filter ({_filled('company_name')}) as with_name, count(*) filter ({_filled('phone')}) as with_phone, count(*) filter ({_MAIL}) as with_email, count(*) filter ({_filled('website')}) as with_website, count(*) filter ({_filled('street_address')} or {_filled('mailing_address')}) as with_address, count(*) filter ({_filled('description')}) as with_description, count(*) filter ({_filled('category')}) as with_category, count(*) filter ({_WHO}) as with_contacts, count(*) filter (coalesce(list_bool_or(list_transform(map_values(social_media), lambda v: coalesce(v <> '', false))), false)) as with_social from members",
    "coverage_dynamic": _PRODUCTS + " select 'model' as field, count(*) filter (model <> '')::bigint as filled from p union all select 'brand', count(*) filter (brand <> '') from p union all select 'link', count(*) filter (link <> '') from p",
    "sparse_fields": "with g as (select source_url, count(*) as cards, count(*) filter (fax <> '') as a1, count(*) filter (founded <> '') as a2, count(*) filter (phone <> '') as b1, count(*) filter (website <> '') as b2 from members where source_url is not null group by 1) select source_url, 'phone' as field from g where b1 >= greatest(3, 0.2 * cards) and a1 < 0.5 * b1 union all select source_url, 'website' from g where b2 >= greatest(3, 0.2 * cards) and a2 < 0.5 * b2",
    "field_presence": "with h as (select *, row_number() over (partition by source_url order by member_id) as r from members), g as (select source_url, avg(coalesce(phone <> '', false)::int) as p, avg(coalesce(website <> '', false)::int) as w, avg(coalesce(description <> '', false)::int) as d from h where r <= 20 group by 1) select source_url, 'phone' as field, p >= 0.5 as present from g union all select source_url, 'website', w >= 0.5 from g union all select source_url, 'description', d >= 0.5 from g",
    "consolidate_members": _CONS + f" select * exclude (contacts), {_join('contacts', 'name')} as names, {_join('contacts', 'email')} as emails from h",
    "export_metadata": _MK + " select count(*) as records, count(*) filter (k is null) as dropped_empty, count(k) - count(distinct k) as duplicates_merged, count(distinct k) as total from k",
    "final_sort": _CONS + f" select coalesce(nullif({_ekey('company_name')}, ''), '~') as sort_key, first_id from h order by encode(sort_key), first_id limit 200",
    "final_sort_all": _CONS + f", o as (select coalesce(nullif({_ekey('company_name')}, ''), '~') as sort_key, first_id from h) select sort_key, first_id, row_number() over (order by encode(sort_key), first_id) as position from o",
    "flatten_csv": _flat(),
    "csv_columns": f"with f as ({_flat()}), u as (unpivot (select * exclude (member_id) from f) on columns(*) into name \"column\" value v) select \"column\", count(*) as rows from u where v <> '' group by 1",
    "listing_detail_anti": f"with l as (select member_id as id, coalesce({_key('company_name')}, '') as key from members), d as (select distinct {_key('company_name')} as k from registry_members where {_key('company_name')} <> '') select id, key from l where not exists (select 1 from d where l.key = d.k) and not (key <> '' and exists (select 1 from d where length(d.k) >= 8 and (starts_with(l.key, d.k) or starts_with(d.k, l.key))))",
    "positional_merge": "with a as (select category as page, row_number() over (partition by category order by member_id) as pos, phone, website from members where category is not null), b as (select category as page, row_number() over (partition by category order by npi) as pos, phone as p2, website as w2 from registry_members where category is not null) select page, pos, coalesce(nullif(phone, ''), p2) as phone, coalesce(nullif(website, ''), w2) as website from a full join b using (page, pos)",
    "enrich_gap_fill": f"with r as (select {_digits('phone')} as p, arg_min({{'f': fax, 'm': mailing_address}}, npi) as r from registry_members where length({_digits('phone')}) = 10 group by 1) select member_id, coalesce(nullif(fax, ''), r.f) as fax, coalesce(nullif(mailing_address, ''), r.m) as mailing_address from members left join r on {_digits('members.phone')} = r.p",
    "enrich_status": f"with s as (select *, trim(coalesce(website, ''), ' ') as w from members) select member_id, case when w <> '' and {_filled('description')} and {_filled('phone')} and {_MAIL} then 'skipped' when length(w) < 4 or starts_with(w, '/') then 'no_website' when {_site('w')} is null then 'failed' else 'enriched' end as status from s",
    "page_merge": "select website as site, arg_max(fax, member_id) filter (fax <> '') as fax, arg_max(street_address, member_id) filter (street_address <> '') as address, arg_max(description, length(description) * 1000000000 - member_id) filter (description <> '') as description, arg_min(hours, member_id) filter (hours <> '') as hours, arg_min(founded, member_id) filter (founded <> '') as founded from members where website is not null group by 1",
    "website_backfill": "select member_id, coalesce(nullif(trim(website, ' '), ''), enrichment_source) as website from members",
    "latest_layouts": "with n as (select source_url as domain, substr(file_name, 1, 8) as fingerprint, max(scraped_at) as l from dump_files group by 1, 2), r as (select domain, fingerprint, row_number() over (partition by domain order by l desc, fingerprint) as rank from n) select * from r where rank <= 4",
    "intent_filter_failopen": "select member_id from members",
}
