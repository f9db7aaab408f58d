import random

from rollbook.llm import mixing


def _best(lengths, counts, budget):
    reach = {0}
    for n, c in zip(lengths, counts):
        reach = {r + k * n for r in reach for k in range(c + 1) if r + k * n <= budget}
    return max(reach)


def test_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        lengths = rng.sample(range(1, 40), rng.randint(1, 6))
        counts = [rng.randint(1, 4) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randint(0, total + 5)
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        got = sum(t * n for t, n in zip(take, lengths))
        assert got <= budget and got >= min(_best(lengths, counts, budget), budget) - max(lengths)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string")


def test_mix(spark):
    docs = _docs(spark, [(i, "a" if i < 90 else "b", "word " * (1 + i % 7), "clash") for i in range(100)] + [(200, "a", None, ""), (201, "b", "", ""), (99, "b", "word " * 2, "clash"), (300, "zz", "x", "")])
    targets = spark.createDataFrame([(1, "a", 0.75, 2), (1, "b", 0.75, 2), (1, "none", 0.5, 4), (2, "a", 1.0, 1), (3, "b", None, 1), (4, "b", 1.0, None)], "mix_id int, source string, target_share double, max_repeats int")
    sizes = mixing.document_sizes(docs, targets).cache()
    mixed = mixing.mix(sizes, targets).cache()
    rep = {(r.mix_id, r.source): r for r in mixing.shares(mixed, targets, sizes).collect()}
    a, b = rep[1, "a"], rep[1, "b"]
    assert abs(a.actual_share - 0.5) < 0.02 and b.most_repeats <= 2 and a.most_repeats <= 2
    assert rep[1, "none"].tokens == 0 and abs(rep[1, "none"].target_share - 0.25) < 1e-9
    assert rep[2, "a"].tokens == rep[2, "a"].budget
    assert rep[3, "b"].tokens == rep[4, "b"].tokens == 0
    assert mixed.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    assert {tuple(r) for r in mixed.collect()} == {tuple(r) for r in mixing.mix(sizes, targets).collect()}


def test_empty(spark):
    targets = spark.createDataFrame([(1, "a", 1.0, 2)], "mix_id int, source string, target_share double, max_repeats int")
    sizes = mixing.document_sizes(_docs(spark, []), targets)
    assert mixing.mix(sizes, targets).count() == 0
