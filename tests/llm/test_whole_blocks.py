from test_entities import _rows

from rollbook.llm import addresses


def test_divided_blocks_see_all_rivals(spark, monkeypatch):
    five = ["5 N Mill St, Driftmoor, OH 10720", "5 N Hills St, Driftmoor, OH 10720", "5 Hill, Driftmoor, OH 10720", "5 N Mill Street, Driftmoor, OH 10720"]
    # two slips of a street that many records share
    five += ["5 Juniper St Ste 2, Driftmoor, OH 10720", "5 Junipr St Ste 2, Driftmoor, OH 10720", "5 Jniper Street Ste 2, Driftmoor, OH 10720"]
    five += [f"5 Tower Ave Ste {k}, Driftmoor, OH 10720" for k in range(1, 6)] + ["5 Tower Avenue, Driftmoor, OH 10720", "5 Tower Avenue #3, Driftmoor 10720"]
    rows = five + [f"{i} Juniper St, Driftmoor, OH 10720" for i in range(20, 60)]
    t = _rows(spark, *[dict(member_id=i, street_address=s) for i, s in enumerate(rows)])
    whole = {(r.member_id_a, r.member_id_b) for r in addresses.same_location(t).collect()}
    assert {p for p in whole if p[0] < 7} == {(0, 3), (4, 5), (4, 6), (5, 6)}
    monkeypatch.setattr(addresses, "BLOCK", 2)
    assert {(r.member_id_a, r.member_id_b) for r in addresses.same_location(t).collect()} == whole
