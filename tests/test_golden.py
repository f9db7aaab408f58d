"""Cases with known answers, one by one."""

import pytest
from pyspark.sql import functions as F

from rollbook.functions import text as t
from rollbook.operators import clean, discovery, extract, links, merge, pages, trace
from rollbook.sources import captures, files


def _one(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_phone_and_site(spark):
    assert _one(spark, ["2065551234", "1 (206) 555.1234", "  12 ", "", None], t.phone_format) == ["(206) 555-1234", "(206) 555-1234", "12", None, None]
    assert _one(spark, ["example.com", "http://x", "see us", None], t.website_normalize) == ["https://example.com", "http://x", None, None]


def test_name_keys(spark):
    same = ["Acme Corp", "Acme Corp.", "Acme Corporation", "Acme, Corp", "ACME  CORP"]
    assert set(_one(spark, same, t.name_key)) == {"acme corp"}
    assert _one(spark, ["Acme L.L.C.", "Co-op Market", "  acme decks. ", "acme ,"], t.name_key) == ["acme llc", "co-op market", "acme decks", "acme"]
    assert _one(spark, ["  acme decks. ", "acme ,", None], t.export_key) == ["acme decks", "acme ", ""]


def test_rejects(spark):
    assert _one(spark, ["Phone:", "* Email *", "Acme", None], t.is_label) == [True, True, False, True]
    assert _one(spark, ["Cities in Alabama", "Ready to Find Your Match?", "Vendors", "Acme", " "], t.is_false_name) == [True, True, True, False, True]


def test_person(spark):
    assert _one(spark, ["mailto:A@B.com?subject=x", "write to a.b@c.org today", "none"], t.person_email) == ["a@b.com", "a.b@c.org", None]
    assert _one(spark, ["Dr. A Keith Lethco DDS", "Jane M. Smith", "Cher"], t.person_parts) == ["A|Lethco", "Jane|Smith", None]


def test_links(spark):
    assert _one(spark, ["<https://x.example>", "//x.example/a", "HTTP://X.example", "ftp://x.example", "hoa directory texas", "localhost"], t.url_clean) == ["https://x.example", "https://x.example/a", "http://X.example", None, None, "https://localhost"]
    got = _one(spark, ["https://x.example/m?id=111&npage=3", "https://x.example/members/12345", "https://x.example/p/acme-decks", "https://x.example/dir?page=2", "https://x.example/about"], t.url_template)
    assert got == ["https://x.example/m?id={ID}", "https://x.example/members/{ID}", "https://x.example/p/{ID}", "https://x.example/dir", "https://x.example/about"]


def test_detail_group(spark):
    rows = [("s", i, f"https://x.example/members/{1000 + i % 128}") for i in range(300)] + [("s", 900 + i, f"https://x.example/news/post-{i}") for i in range(50)] + [("s", 990, "mailto:a@b.c"), ("s", 991, "https://x.example/dir?page=2")]
    got = links.detail_groups(spark.createDataFrame(rows, "site string, pos int, href string")).collect()
    assert [(r.template, r.pages) for r in got] == [("https://x.example/members/{ID}", 128)]


def test_count_gate(spark):
    cases = [(100, 213, 0), (100, None, 0), (213, 213, 0), (180, 213, 0), (120, 5000, 130), (2, 213, 0)]
    df = spark.createDataFrame([(str(i), c, e, o) for i, (c, e, o) in enumerate(cases)], "source_url string, cleaned long, expected long, observed long")
    assert [r.source_url for r in clean.count_gate(df).collect()] == ["0"]


def test_location_filter(spark):
    addr = ["1 A St, Salem, OR 97201", "1 A St, Salem, OR", None, "123 Main Ct", "1 B St, Kent, WA 98030"]
    df = spark.createDataFrame([(i, a, None) for i, a in enumerate(addr)], "member_id int, street_address string, mailing_address string")
    assert sorted(r.member_id for r in clean.location_filter(df, ["WA"]).collect()) == [2, 3, 4]


CONTACT = "array<struct<name:string,email:string>>"
RECORD = f"member_id long, company_name string, category string, description string, phone string, fax string, website string, street_address string, mailing_address string, hours string, founded string, source_url string, contacts {CONTACT}"


def test_consolidate(spark):
    def r(i, name, **k):
        d = {c.split()[0]: None for c in RECORD.split(", ")} | {"member_id": i, "company_name": name, "contacts": []} | k
        return tuple(d[c.split()[0]] for c in RECORD.split(", "))

    rows = [r(1, "Acme Decks", phone="1", source_url="a"), r(2, "  acme decks. ", contacts=[("Ann", "a@x.y")]), r(3, "Beta"), r(4, "ACME decks", website="w", description="d", contacts=[("ANN", "A@x.y"), (None, "b@x.y")]), r(5, "Zeta"), r(6, None, phone="9"), r(7, None)]
    df = spark.createDataFrame(rows, RECORD)
    m = {x.k: x for x in merge.consolidate(df).collect()}
    assert set(m) == {"acme decks", "beta", "zeta", "~anon~9"}
    a = m["acme decks"]
    assert (a.phone, a.website, a.description, a.source_url, a.rows) == ("1", "w", "d", "a", 3) and [tuple(c) for c in a.contacts] == [("Ann", "a@x.y"), (None, "b@x.y")]
    assert tuple(merge.export_metadata(df).first()) == (7, 1, 2, 4)
    assert [x.sort_key for x in merge.final_order(merge.consolidate(df), 9).collect()] == ["acme decks", "beta", "zeta", "~"]


def test_shared_emails(spark):
    rows = [(i, [("n", "all@x.y") if i % 2 else (None, "all@x.y"), (None, f"{i}@x.y")]) for i in range(10)]
    got = {r.member_id: [tuple(c) for c in r.contacts] for r in clean.prune_shared_emails(spark.createDataFrame(rows, f"member_id long, contacts {CONTACT}")).collect()}
    assert got[1] == [("n", None), (None, "1@x.y")] and got[2] == [(None, "2@x.y")]


def test_dedup_cap(spark):
    hits = [(0, "q0", 3, "https://a.example/x/", "first"), (0, "q0", 5, "https://www.a.example/X", "same"), (1, "q1", 1, "https://a.example/x", "better"), (1, "q1", 2, "https://a.example/y", "second"), (1, "q1", 3, "https://a.example/z", "third"), (1, "q1", 4, "https://b.example/blog/x", "skip"), (1, "q1", 5, "https://yelp.com/b", "skip")]
    got = discovery.dedup_cap(spark.createDataFrame(hits, "query_idx int, query string, rank int, url string, title string")).collect()
    assert {(r.title, r.via_query, r["rank"]) for r in got} == {("first", "q1", 1), ("second", "q1", 2)}


CARD = '<div class="card"><h3>Firm {i}</h3><p>12 Main St</p><a href="tel:290-555-0{i}00">290-555-0{i}00</a></div>'


def test_pages():
    html = "<html><nav><a href=/x>Home</a></nav><div id=w>" + "".join(CARD.format(i=i) for i in range(8)) + "<div class='card odd'><h3>Firm 8</div></div></html>"
    assert pages.repeated(html) >= 8
    got = pages.cards(html, "#w > div.card", {"name": "h3", "phone": "a@href", "street": "p:nth-of-type(1)"})
    assert len(got) == 9 and got[2] == {"name": "Firm 2", "phone": "290-555-0200", "street": "12 Main St"} and got[8]["phone"] is None
    assert pages.repeated("<p>just a text</p>") == 0 and pages.cards("", ".x", {"a": "b"}) == []
    table = "<table><thead><tr><th>Company Name<th>E-mail<th>Phone</tr></thead><tr><td>A<td>a@b.c<td>1</tr><tr><td>B</table>"
    assert pages.table_rows(table) == [{"company_name": "A", "email": "a@b.c", "phone": "1"}, {"company_name": "B"}]
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"WebSite","name":"S","telephone":"1"},{"@type":"Dentist","name":"D","email":"mailto:d@x.y","address":{"streetAddress":"1 Main St","addressRegion":"WA"}},{"name":"d","telephone":"3"},{"name":"N"}]}</script><script type="application/ld+json">{"itemListElement":[{"item":{"name":"E","telephone":"2"}}]}</script><script type="application/ld+json">{broken</script>'
    assert [(r["company_name"], r["email"], r["street_address"]) for r in pages.jsonld(ld)] == [("D", "d@x.y", "1 Main St, WA"), ("E", None, None)]
    assert pages.form_options("<form><select name=st><option value=''>Any<option>A<option>B<option>C<option>D<option>E</select></form><form method=post><select name=z>" + "<option>1" * 9 + "</select></form>") == [("st", x) for x in "ABCDE"]


def test_listing_minus_detail(spark):
    li = spark.createDataFrame([(1, "acme decks"), (2, "acme decks and more"), (3, "beta"), (4, "zet"), (5, ""), (6, "beta builders")], "id long, key string")
    de = spark.createDataFrame([("acme decks",), ("zeta tools",), ("beta",), ("",)], "key string")
    assert sorted(r.id for r in merge.listing_minus_detail(li, de).collect()) == [5, 6]


def test_captures(spark):
    urls = ["https://x.example/api/authors", "https://x.example/api/auth/login", "https://x.example/a?access_token=1", "https://x.example/a?q=secretary", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r.c for r in df.select("i", captures.credential_shaped(F.col("u"), F.lit(None).cast("string")).alias("c")).orderBy("i").collect()] == [False, True, True, False, True]
    dumps = spark.createDataFrame([(1, '[{"Name": "A", "tel": "1", "Phone": ""}, 5]'), (2, '{"metadata": {"partial": true}, "members": [{"Title": "T", "URL": "u"}]}'), (3, "x"), (4, None)], "dump_id long, body string")
    recs = captures.dump_members(dumps)
    assert recs.count() == 3
    got = {(r.dump_id, r.pos): (r.company_name, r.phone, r.website) for r in captures.resolve_aliases(recs).collect()}
    assert got[1, 0] == ("A", None, None) and got[2, 0] == ("T", None, "u")


def test_requests(spark):
    caps = spark.createDataFrame([("https://x.example/a?page=1&b=2", "page", 20, 50), ("https://y.example/a?page=1", "page", 10, 0)], "url string, param string, records long, expected long")
    got = [(r.url, r.page, r.request) for r in extract.next_requests(caps).collect()]
    assert [g for g in got if "x." in g[0]] == [("https://x.example/a?page=1&b=2", p, f"https://x.example/a?page={p}&b=2") for p in (2, 3)] and len(got) == 2 + 29


def test_runs(spark):
    df = spark.createDataFrame([(i, "k", v) for i, v in enumerate("aabba")], "id long, key string, v string")
    assert sorted((r.v, r.started, r.n) for r in trace.repeat_runs(df, "key", ["id"], "v").collect()) == [("a", 0, 2), ("a", 4, 1), ("b", 2, 2)]


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a_structured.json").write_text('{"members": []}')
    (tmp_path / "d/b_detail_structured.json").write_text("[]")
    assert [r.body for r in files.read_dumps(spark, f"{tmp_path}/d").collect()] == ['{"members": []}']
    (tmp_path / "u.csv").write_text("url,x\n https://a ,1\n,2\n")
    assert [r.url for r in files.read_url_list(spark, f"{tmp_path}/u.csv").collect()] == ["https://a"]
    df = spark.createDataFrame([("a<b", None)], "x string, y string")
    files.write_csv(df, f"{tmp_path}/o.csv", ["x"])
    files.write_json(df, f"{tmp_path}/o.json")
    files.write_workbook(df, f"{tmp_path}/o.xlsx")
    import zipfile

    assert "a&lt;b" in zipfile.ZipFile(f"{tmp_path}/o.xlsx").read("xl/worksheets/sheet1.xml").decode()
    with pytest.raises(ValueError):
        files.write_workbook(df.union(df), f"{tmp_path}/p.xlsx", limit=1)
