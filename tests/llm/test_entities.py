import datetime as dt
import itertools
import random

from rollbook.llm import addresses, entities, linkage, names, survivors

ROW = "member_id long, company_name string, phone string, fax string, website string, website_source string, street_address string, mailing_address string, contacts array<struct<name:string,email:string>>, source_url string, scraped_at timestamp, core string, place string, business string"
SRC = "https://members.some-guild.example/list"


def _rows(spark, *rows):
    full = []
    for r in rows:
        d = {"fax": None, "website": None, "website_source": "original", "mailing_address": None, "contacts": [], "source_url": SRC, "scraped_at": dt.datetime(2025, 1, r["member_id"] % 28 + 1), "core": "x", "place": "x", "business": "x", "company_name": None, "phone": None, "street_address": None} | r
        full.append(tuple(d[c.split()[0]] for c in ROW.split(", ")))
    return spark.createDataFrame(full, ROW)


def _edits(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_against_brute_force():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(120)]
    trie = names.Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for w in words[:40]:
        for k in (0, 1, 2):
            assert trie.near(w, k) == {i for i, x in enumerate(words) if _edits(w, x) <= k}
        assert trie.starting(w) == {i for i, x in enumerate(words) if x.startswith(w)}


def test_company_links():
    same = ["Blue Ember Insurance Group", "BLUE EMBER INS. GRP", "B.E. Insurance Group", "X Holdings dba Blue Embre Insurance", "Insurance Group - Blue Ember", "BlueEmber Insurance Group LLC", "Blue Emb…"]
    other = ["Green Otter Glass", "Evergreen Lantern Accounting"]
    forms = sorted({names.company(n) for n in same + other})
    where = dict(zip(forms, names.link_companies(forms)))
    assert len({where[names.company(n)] for n in same}) == 1
    assert len({where[names.company(n)] for n in same[:1] + other}) == 3


def test_divided_shard_keys_meet():
    for a, b in [("blue ember", "b e"), ("ember blue", "be"), ("the x", "x"), ("blue ember", "clue ember"), ("ember ridge", "ter")]:
        assert set(names.shard_keys(a)) & set(names.shard_keys(b)), (a, b)


def test_person_links():
    people = ["Robert Smithson", "Bob Smithson", "Smithson, R.", "Dr. Robert A. Smithson, CPA", "Roberta Jones", "Max Smithson Sr.", "Max Smithson Jr.", "Zoë Smithson"]
    forms = sorted({names.person(n) for n in people})
    w = dict(zip(forms, names.link_persons(forms)))
    at = [w[names.person(n)] for n in people]
    assert at[0] == at[1] == at[2] == at[3] and len(set(at)) == 5
    assert names.person("Cher") is None


GAZ = addresses.Gazetteer([("12522", "violet hollow", "ne"), ("10720", "driftmoor", "oh"), ("10721", "driftmoor", "oh")])


def test_addresses():
    p = lambda s: addresses.parse(s, GAZ)
    same = ["634 Southwest 12th Street # 290A, Driftmoor, OH 10720", "634 S.W. Twelfth Str Suite 290A\nDriftmoor\nOH 10720-1234, USA", "Driftmoor, OH 10720, 634 12th St SW Ste. 290A", "Ste 290A, 634 SW 12TH ST, DRIFTMOR 10720"]
    assert len({p(s) for s in same}) == 1
    assert p("P O Box 12, Driftmoor 10720") == p("POB 12, Driftmoor, OH 10720")
    assert p("63 Oak Ave Violet Hollow NE")[0] == "violet hollow"
    assert p("same") is None and p(None) is None and p("") is None and p("n/a") is None
    items = [("10720", "sw", "main", "st", "2", 5), ("10720", "", "mian", "st", "", 1), ("10720", "sw", "main", "st", "3", 4), ("10720", "ne", "main", "st", "2", 1), ("10720", "", "oak", "st", "2", 1)]
    w = addresses.resolve(items)
    assert len({w[0], w[2], w[3], w[4]}) == 4
    assert addresses.resolve([items[0], ("", "", "mian", "", "2", 1)]) == [0, 0]


def test_same_location(spark):
    base = [dict(member_id=100 + i, street_address=f"{i} Elm St, Driftmoor, OH 10720") for i in range(30)]
    t = _rows(spark, *base, dict(member_id=1, street_address="5 Main St Ste 2, Driftmoor, OH 10720", mailing_address="5 Main Street #2, Driftmoor 10720"), dict(member_id=2, street_address="5 MAIN ST STE 2, DRIFTMOOR, OH 10720"), dict(member_id=2, street_address="5 MAIN ST STE 2, DRIFTMOOR, OH 10720"), dict(member_id=3, street_address="5 Main St Ste 3, Driftmoor, OH 10720", mailing_address="same"), dict(member_id=4, street_address="", mailing_address="5 " + "x" * 100_000))
    got = {tuple(r) for r in addresses.same_location(t).collect()}
    assert got == {(1, "mailing_address", 1, "street_address"), (1, "mailing_address", 2, "street_address"), (1, "street_address", 2, "street_address")}
    assert addresses.same_location(t.limit(0)).count() == 0


def _firms(spark):
    home = "12 Oak St, Driftmoor, OH 10720"
    filler = [dict(member_id=500 + i, company_name=f"Filler {i} Roofing", phone=f"29055{10000 + i}", street_address=f"{i + 100} Elm St, Driftmoor, OH 10720") for i in range(30)]
    return _rows(
        spark, *filler,
        dict(member_id=1, company_name="Blue Ember Bakery", phone="(290) 612-3456", street_address=home, website="www.blueember.example", contacts=[("Bob Smithson", "bob1@post1.example"), ("R. Smithson", None)]),
        dict(member_id=2, company_name="B.E. Bakery", phone="290.612.3456", website="https://some-guild.example/list/profile/3", contacts=[("Robert Smithson", None)]),
        dict(member_id=3, company_name="{{name}}", phone="tel:+12906123456", street_address=home, website="blueember.example/x"),
        dict(member_id=4, company_name="Blue Ember Bakery…", phone="000-000-0000", street_address="12 Oak Street, Driftmoor 10720", source_url="#top"),
        dict(member_id=5, company_name="Green Otter Glass", phone="290-612-3456", street_address=home, contacts=[("Robert Smithson", "bob1@post1.example"), ("Robert Smithson", None)]),
        dict(member_id=6, company_name="Blue Ember Bakery", phone="290-999-1111", street_address="9 Elm St, Violet Hollow, NE 12522"),
        dict(member_id=7), dict(member_id=7),
    )


def test_businesses_and_survivors(spark):
    t = _firms(spark)
    b = entities.businesses(t).cache()
    low = {r.member_id: r.business for r in b.collect()}
    assert [low[i] for i in range(1, 7)] == [1, 1, 1, 1, 5, 6] and low[7] == 7
    got = {(r.group_id, r.field): r.member_id for r in survivors.survivors(t, b).collect() if r.group_id < 7}
    assert got == {(1, "company_name"): 2, (1, "phone"): 3, (1, "website"): 3, (1, "source_url"): 3}
    pairs = {tuple(r) for r in entities.variants(t, b).collect()}
    assert {p for p in pairs if p[0] == "company_name"} == {("company_name", 1, 0, 2, 0), ("company_name", 1, 0, 4, 0), ("company_name", 2, 0, 4, 0)}
    assert {p[1:] for p in pairs if p[0] == "contacts.name"} == {(1, 0, 1, 1), (1, 0, 2, 0), (1, 1, 2, 0), (1, 0, 5, 0), (1, 1, 5, 0)} | {p[1:] for p in pairs if p[0] == "contacts.name" and p[3:] == (5, 1)}


def test_linkage(spark):
    t = _firms(spark)
    reg = spark.createDataFrame([(90, "BLUE EMBER BAKERY INC", "", "290-612-3456", None, "12 OAK ST, DRIFTMOOR, OH 10720", "x"), (91, "Blue Ember Bakery", None, None, None, "77 Fir St, Violet Hollow, NE 12522", "x"), (92, None, None, None, None, None, "x")] + [(600 + i, f"Filler {i} Roofing", None, f"29055{10000 + i}", None, f"{i + 100} Elm St, Driftmoor, OH 10720", "x") for i in range(30)], "npi long, company_name string, website string, phone string, fax string, street_address string, core string")
    b = entities.businesses(t)
    got = {(r.member_id, r.npi) for r in linkage.linked(t, b, reg).collect()}
    assert {g for g in got if g[0] < 100} == {(1, 90), (2, 90), (3, 90), (4, 90)} and len(got) == 34
    assert linkage.linked(t, b, reg.limit(0)).count() == 0


def test_empty(spark):
    t = _firms(spark).limit(0)
    b = entities.businesses(t)
    assert b.count() == survivors.survivors(t, b).count() == entities.variants(t, b).count() == 0


def test_components(spark):
    edges = [(i, 1000 + i) for i in range(1, 60)] + [(i + 1, 1000 + i) for i in range(1, 60)] + [(90, 5000), (91, 5000), (99, 7000)]
    got = {r.p: r.c for r in entities.components(spark.createDataFrame(edges, "p long, g long"), "t").collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[90] == got[91] == 90 and got[99] == 99


def test_divided_shards_give_the_same(spark, monkeypatch):
    same = [dict(member_id=i, company_name=n, phone="290-612-3456", contacts=[(c, None)]) for i, (n, c) in enumerate([("Blue Ember Bakery", "Ann Lee"), ("B.E. Bakery", "Ann Lew"), ("Blue Embr Bakery", "Bo Ray"), ("Green Otter Glass", "Bob Roy"), ("G.O. Glass", "A. Lee"), ("The Fox & Hen Glass", "Max Hill"), ("TFH Glass", "M Hill"), ("{{x}}", "Ann Lee")], 1)]
    t = _rows(spark, *same)

    def groups():
        b = entities.businesses(t).cache()
        pairs = {tuple(r) for r in entities.variants(t, b).collect()}
        return {r.member_id: r.business for r in b.collect()}, pairs

    whole = groups()
    monkeypatch.setattr(names, "SHARD", 2)
    assert groups() == whole
    assert whole[0][2] == whole[0][3] == 1 and whole[0][5] == 4 and whole[0][7] == 6


def test_divided_blocks_give_the_same(spark, monkeypatch):
    rows = [dict(member_id=i, street_address=s) for i, s in enumerate(["5 Main St, Driftmoor, OH 10720", "5 Mian Street, Driftmoor 10720", "5 N Main St Ste 2, Driftmoor, OH 10720", "5 Oak Ave, Driftmoor, OH 10720", "5 Oak Avenue, Driftmoor, OH 10720"] + [f"{i} Elm St, Driftmoor, OH 10720" for i in range(20, 40)])]
    t = _rows(spark, *rows)
    whole = {tuple(r) for r in addresses.same_location(t).collect()}
    monkeypatch.setattr(addresses, "BLOCK", 2)
    assert {tuple(r) for r in addresses.same_location(t).collect()} == whole and len(whole) == 4


def test_long_values(spark):
    long = "Blue " + "ember" * 20_000
    t = _rows(spark, dict(member_id=1, company_name=long + " Bakery", phone="290-612-3456", street_address="5 " + "y" * 50_000 + " St, Driftmoor, OH 10720", contacts=[("Ann " + "l" * 50_000, None), ("Ann " + "l" * 50_001, None)]), dict(member_id=2, company_name=long + "x Bakery", phone="290-612-3456", street_address="5 " + "y" * 50_001 + " St, Driftmoor, OH 10720"), *[dict(member_id=10 + i, street_address=f"{i} Elm St, Driftmoor, OH 10720") for i in range(9)])
    b = {r.member_id: r.business for r in entities.businesses(t).collect()}
    assert b[1] == b[2] == 1
    assert addresses.same_location(t).count() == 0
    assert names.edits("ab" * 30_000, "ab" * 29_999 + "b", 2) == 1 and names.edits("abcd", "badc", 2) == 2 and names.edits("a", "xyz", 2) == 3
