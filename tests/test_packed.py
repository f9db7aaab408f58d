import itertools
import math

from rollbook.operators import packed


def _brute(rows, total):
    """All paths of a lattice by enumeration: the best, and each arc's posterior."""
    sc = packed._lattice(rows, total)
    n = max(j for _, j in sc)
    paths = []
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            edges = list(zip((0, *cuts), (*cuts, n)))
            if all(e in sc for e in edges):
                paths.append((sum(sc[e] for e in edges), edges))
    z = sum(math.exp(s) for s, _ in paths)
    post = {e: sum(math.exp(s) for s, p in paths if e in p) / z for e in sc}
    return max(paths, key=lambda x: x[0])[1], post


def test_lattice_against_enumeration():
    rows = [(i, j, v, f, 3) for (i, j, v), f in zip(packed.arcs("a, b/c, d"), [5.0, 1.0, 0.0, 2.0, 7.0, 4.0, 0.5, 3.0, 0.2, 6.0])]
    want, post = _brute(rows, 50.0)
    assert packed.best(rows, 50.0) == want
    for i, j, p in packed.expected(rows, 50.0):
        assert abs(p - post[i, j]) < 1e-9


def test_chunks():
    assert packed.chunks('["A, b", "C"]') == [("A, b", False), ("C", False)]
    assert packed.chunks("['x']") == [("x", False)]
    assert packed.chunks('"Pies, tarts" ,Mowing ,"A"') == [("Pies, tarts", False), ("Mowing", False), ("A", False)]
    assert packed.chunks("1) A/C Repair 2) Tax Prep - Personal") == [("A/C Repair", True), ("Tax Prep - Personal", False)]
    assert packed.chunks("A\n- B;; C |D;") == [("A", False), ("B", False), ("C", False), ("D", False)]
    assert packed.chunks("/cat/roofing?id=8") == [("/cat/roofing?id=8", False)]
    assert packed.chunks(None) == [] and packed.chunks("  ;; ") == []


def _members(spark, rows):
    return spark.createDataFrame(rows, "member_id long, category string, services array<string>, field string")


def test_split(spark):
    rows = [(i, "Wills, Trusts & Probate", ["Pies, tarts", "Mowing"], "clash") for i in range(20)]
    rows += [(100 + i, a, None, None) for i, a in enumerate(["Roofing", "Video", "Towing"] * 8)]
    rows += [(1000 + i, f"Trade {i % 80}", None, None) for i in range(1600)]
    rows += [(200, "Roofing, Video", None, None), (201, "Wills, Trusts & Probate; Towing, Video", [None, ""], None), (202, None, [], None), (203, "", ["Mowing|Pies, tarts", None], None), (203, "", ["Mowing|Pies, tarts", None], None)]
    got = {(r.member_id, r.field, r.pos, r.val) for r in packed.split_packed(_members(spark, rows)).collect()}
    assert got == {
        (200, "category", 0, "Roofing"), (200, "category", 1, "Video"), (201, "category", 0, "Wills, Trusts & Probate"), (201, "category", 1, "Towing"), (201, "category", 2, "Video"),
        (203, "services", 0, "Mowing"), (203, "services", 1, "Pies, tarts"),
    }


def test_empty(spark):
    assert packed.split_packed(_members(spark, [])).count() == 0
