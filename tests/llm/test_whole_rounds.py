from rollbook.llm import linkage


def test_rivals_lose_their_share_in_every_round(spark, monkeypatch):
    rows = [(b, n, 1.0, 1.0, 1.0, 0.5) if b == n else (b, n, 0.9, 0.5, 0.6, 0.5) for n in range(8) for b in range(8)]
    pairs = spark.createDataFrame(rows, "business long, npi long, name double, phone double, address double, website double").cache()
    shares = []
    real = linkage.maximise

    def seen(x, n, g):
        shares.append(float((n * g).sum()))
        return real(x, n, g)

    monkeypatch.setattr(linkage, "maximise", seen)
    got = {(r.business, r.npi) for r in linkage.match(pairs).collect()}
    assert got == {(k, k) for k in range(8)}
    assert len(shares) == linkage.ROUNDS + 1 and max(shares[1:]) <= 8.0 + 1e-6
