import itertools
import random

from test_entities import _rows

from rollbook.llm import entities, names


def test_near_last_names_share_a_key():
    rng = random.Random(7)
    lasts = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 13))) for _ in range(400)})
    near = names.near_lasts(lasts)
    keys = [set(names.last_keys(x)) for x in lasts]
    assert all(keys[i] & keys[j] for i, js in enumerate(near) for j in js) and sum(map(len, near)) > 500


def test_divided_people_are_whole(spark, monkeypatch):
    who = ["Lee Ann", "Ann Lee", "Jane Harringson", "Jane Harrimgsom", "J. Smithson", "Jane Smithson", "John Smithsen", "K. Birch", "Kate Birch", "Max Hill", "Max Hill Jr.", "Bo Ray"]
    t = _rows(spark, *[dict(member_id=k + 1, company_name="Blue Ember Bakery", phone="290-612-3456", contacts=[(n, None)]) for k, n in enumerate(who)], *[dict(member_id=50 + i, street_address=f"{i} Elm St, Driftmoor, OH 10720") for i in range(30)])
    b = entities.businesses(t).cache()
    pairs = lambda: {(r.member_id_a, r.member_id_b) for r in entities.variants(t, b).where("field = 'contacts.name'").collect()}
    whole = pairs()
    assert whole == {(1, 2), (3, 4), (8, 9), (10, 11)}
    monkeypatch.setattr(names, "SHARD", 2)
    assert pairs() == whole
