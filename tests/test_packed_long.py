from rollbook.operators import packed


def test_long_values_are_candidates():
    value = "Installation of " + "x" * 90 + ", and repair of pumps"
    assert (0, 2, value) in packed.arcs(value)
    assert max(j - i for i, j, _ in packed.arcs(", ".join(["ab"] * 1_000))) == 20
