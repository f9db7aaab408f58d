import itertools
import random

from test_entities import _rows

from rollbook.llm import entities, names

#: Pairs that a small shard links.
PAIRS = [("blue heron", "blue heron valley crest"), ("blue ridge valley", "blueridgevalley"), ("blue ridge", "clue bidge"), ("abc", "abcd"), ("maple hollow", "mable holow"), ("ember oak", "oak embre"), ("otterfield", "otterfieldxy")]


def test_accepted_pairs_share_a_key():
    rng = random.Random(5)
    words = ["".join(rng.choice("abt") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    cores = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(350)} | {x for p in PAIRS for x in p} | {"blue"})
    cut = {c: rng.random() < 0.3 for c in cores} | {"blue": True}
    met = 0
    for a, b in itertools.combinations(cores, 2):
        x, y = names.link_companies([(a, "", cut[a]), (b, "", cut[b])])
        if x == y:
            met += 1
            assert set(names.shard_keys(a, cut[a])) & set(names.shard_keys(b, cut[b])), (a, b)
    assert met > 500


def test_divided_company_shards_are_whole(spark, monkeypatch):
    pairs = [x for p in PAIRS for x in p]
    full = [dict(company_name=n.title(), phone="290-612-3456", website=f"www.host{k}.example") for k, n in enumerate(pairs)]
    full += [dict(company_name="Blue…", phone="290-612-3456"), dict(company_name="B. H. V. C.", phone="290-612-3456"), dict(company_name="M.H.", phone="290-612-3456"), dict(phone="290-612-3456"), dict(phone="290-612-3456", website="www.host9.example"), dict(phone="290-612-3456", website="www.host0.example/x")]
    # a shard of a place and number, where phones differ
    full += [dict(company_name=n, phone=p, street_address="12 Oak St, Driftmoor, OH 10720") for n, p in [("Green Otter", "290-612-1111"), ("Red Lantern", "290-612-2222"), ("Silver Birch", "290-612-3333"), (None, "290-612-2222"), (None, "290-612-9999"), (None, None)]]
    full += [dict(street_address=f"{i} Elm St, Driftmoor, OH 10720") for i in range(30)]
    t = _rows(spark, *[dict(member_id=k + 1) | r for k, r in enumerate(full)])
    whole = {r.member_id: r.business for r in entities.businesses(t).collect()}
    assert all(whole[2 * k + 1] == whole[2 * k + 2] for k in range(len(PAIRS)))
    monkeypatch.setattr(names, "SHARD", 2)
    assert {r.member_id: r.business for r in entities.businesses(t).collect()} == whole
    assert len(set(whole.values())) > 20
