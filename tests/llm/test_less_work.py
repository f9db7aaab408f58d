import random

from test_entities import _edits, _firms

from rollbook.llm import addresses, entities, names


def test_near_words_against_brute_force():
    rng = random.Random(11)
    for size in (1, names.FEW, names.FEW + 1, 30):
        for _ in range(20):
            words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 10))) for _ in range(size)})
            want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and _edits(a, b) <= names.bound(a)}
            assert set(names.near_words(words, names.bound)) == want


def test_few_names_link_as_many_do(monkeypatch):
    rng = random.Random(12)
    words = ["".join(rng.choice("abt") for _ in range(rng.randint(1, 9))) for _ in range(12)]
    firms = [sorted({(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), rng.random() < 0.3) for _ in range(5)}) for _ in range(200)]
    people = [sorted({(rng.choice(words), rng.choice(words), rng.choice(["", "jr"])) for _ in range(5)}) for _ in range(200)]
    few = [names.link_alike(f) for f in firms], [names.link_persons(p) for p in people]
    monkeypatch.setattr(names, "FEW", 0)
    assert few == ([names.link_alike(f) for f in firms], [names.link_persons(p) for p in people])


def test_any_number_gives_the_same_businesses(spark):
    t = _firms(spark).where("member_id != 7")
    low = {r.member_id: r.business for r in entities.businesses(t).collect()}
    some = {r.member_id: r.business for r in entities.businesses(t, smallest=False).collect()}
    assert all((low[a] == low[b]) == (some[a] == some[b]) for a in low for b in low) and all(low[some[a]] == low[a] for a in low)


def test_gazetteer_from_endings(spark):
    texts = ["5 Oak St, Driftmoor, OH 10720", "6 Oak St; Driftmoor ;OH  10720-1234 ", "7 Oak St, DRIFTMOOR, OH, 10720, USA", "8 Oak St, Elsewhere, OH 10720", "no digits, here, OH", "Driftmoor 10720", None]
    assert addresses.learn(spark.createDataFrame([(x,) for x in texts], "s string")) == [("10720", "driftmoor", "oh")]
    ends = spark.createDataFrame([(", Driftmoor, OH 10720", 3), (", Elsewhere, OH 10720", 5), ("", 9), (None, 2)], "e string, m long")
    assert addresses.learned(ends) == [("10720", "elsewhere", "oh")]


def test_box_with_known_postcode_needs_no_more():
    g = addresses.Gazetteer([("10720", "driftmoor", "oh")])
    assert addresses.parse("PO Box 12, Suite 4, Elsewhere, OH 10720-1234", g) == ("driftmoor", "10720", "12", "", "", "", "", "")
