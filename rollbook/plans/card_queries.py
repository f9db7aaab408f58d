"""Queries of cards and detail pages, rendered from members' rows, with independent SQL over these rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import text as t
from rollbook.operators import cards
from rollbook.plans import record_queries, web_queries
from rollbook.work import load

FIELD = {"name": "company_name", "phone": "phone", "fax": "fax", "addr": "street_address", "web": "website"}


def _rows(s: SparkSession, d: str) -> DataFrame:
    m = load(s, d, "members")
    one = {k: t.ws(F.coalesce(c, F.lit(""))) for k, c in FIELD.items()}
    return m.select("member_id", *[web_queries.esc(c).alias(k) for k, c in one.items()], web_queries.esc(t.ws(F.coalesce(F.get("contacts", F.lit(0))["email"], F.lit("")))).alias("mail"))


_CARD = '<div class="member-card row"><h2>{name}</h2><p>Phone: {phone}</p><p>Facsimile (fax): {fax}</p><p>{addr}</p><a href="mailto:{mail}?subject=Hi">Mail us</a> <a href="{web}">Site</a></div>'


def _html(template: str) -> F.Column:
    parts = [F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(template.replace("{", "\x00").replace("}", "\x00").split("\x00"))]
    return F.concat(*parts)


def listing_pages(s: SparkSession, d: str) -> DataFrame:
    """(page_id, html): lists of up to twenty cards."""
    r = _rows(s, d).select(F.floor(F.col("member_id") / 20).alias("page_id"), F.struct("member_id", _html(_CARD).alias("x")).alias("c"))
    g = r.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["x"]), "\n").alias("x"))
    return g.select("page_id", F.concat(F.lit('<html><body><nav><a href="/a">Home</a></nav><div class="list">'), "x", F.lit("</div><footer>© 2020</footer></body></html>")).alias("html"))


def detail_pages(s: SparkSession, d: str) -> DataFrame:
    """(page_id, html): a page for each member, around its card."""
    body = '<html><head><meta name="description" content="Our guild has kept its register of local firms in order since 1950."></head><body><header><a href="tel:2905550000">Guild 290-555-0000</a></header><div class="side"><p>News</p></div><div class="box">' + _CARD + "</div></body></html>"
    return _rows(s, d).select(F.col("member_id").alias("page_id"), _html(body).alias("html"))


QUERIES = {
    "card_patterns": lambda s, d: cards.cards_by_patterns(listing_pages(s, d), ".member-card"),
    "layout_free_records": lambda s, d: cards.records_without_layout(listing_pages(s, d)),
    "page_listings": lambda s, d: cards.listings(listing_pages(s, d)),
    "page_bundles": lambda s, d: cards.bundles(detail_pages(s, d)),
}

_W = record_queries._ws
_P, _E = web_queries._PHONE, web_queries._EMAIL
_COLS = ", ".join(f"coalesce({_W(c)}, '') as {k}" for k, c in FIELD.items())
_S, _Z = cards.STREET.pattern.replace("'", "''"), cards.STATE_ZIP.pattern
_TEXT = "concat_ws(chr(10), name, 'Phone: ' || phone, 'Facsimile (fax): ' || fax, addr, 'Mail us', 'Site')"
_FLAT = f"trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g'), ' ')"
_READ = f"""with r as (select member_id, {_COLS}, coalesce({_W('contacts[1].email')}, '') as mail from members),
v as (select member_id, length(name) > 1 and not regexp_full_match(name, '{_E}') and not regexp_matches(lower(name), '^(https?://|www\\.)') as good, regexp_matches(web, '^(https?:)?//[^/?#]') as linked, * exclude (member_id) from r)
select member_id // 20 as page_id, (row_number() over (partition by member_id // 20 order by member_id) - 1)::int as pos, case when good then name when not regexp_matches(web, '^(mailto|tel):') then 'Site' end as company_name, coalesce(nullif(regexp_extract(name, '{_P}'), ''), nullif(regexp_extract(phone, '{_P}'), '')) as phone, nullif(regexp_extract(fax, '{_P}'), '') as fax,
case when regexp_matches(split_part(mail, '?', 1), '^{_E}') then trim(split_part(mail, '?', 1), ' ') when regexp_matches(web, '^mailto: *{_E}') then trim(split_part(substr(web, 8), '?', 1), ' ') else nullif(regexp_extract(name || chr(10) || phone || chr(10) || fax || chr(10) || addr, '{_E}'), '') end as email,
case when linked and not regexp_matches(lower(split_part(regexp_replace(web, '^(https?:)?//', ''), '/', 1)), '(^|\\.)({"|".join(cards.ELSEWHERE)})$') and not regexp_matches(lower(web), '/maps/|directions') then web else 'http://' || nullif(regexp_extract({_TEXT}, '{cards.WWW.pattern}'), '') end as website,
case when regexp_matches({_FLAT}, '{_S}') then trim(regexp_extract({_FLAT}, '{_S}'), ' ') when regexp_matches(name, '{_Z}') and length(name) > 10 then name
when regexp_matches(addr, '{_Z}') then case when length(fax) < 83 then trim('Facsimile (fax): ' || fax, ' ') || ', ' else '' end || addr end as street_address from v"""
SQL = {
    "card_patterns": _READ,
    "page_listings": "select member_id // 20 as page_id, case when count(*) >= 3 then 'div.member-card' end as selector, case when count(*) >= 3 then count(*)::int else 0 end as cards, case when count(*) >= 3 then 'member-card' else '' end as classes from members group by 1",
}
