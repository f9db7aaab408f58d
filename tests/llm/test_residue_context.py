from rollbook.llm import residue


def test_context_and_length(spark):
    long = "a" * 70
    bad = [
        "Serving {{city}} since 1990, for example weddings and parties of every size all year round.", "{{ " + ".".join(["x"] * 12) + " }}", "{" + long + "}", "{{ a" + " | b" * 20 + " }} firm",
        "Page not found", "Lorem ipsum dolor", "xxx" + " xx" * 80, "__a.b_c__ firm",
        "We teach template syntax to clubs in town." + " Ask at the desk for the price of a lesson." * 3 + " Owner: {{owner}}",
    ]
    good = ["Untitled works [sic] are sold here.", "Our course on template syntax shows how {{name}} prints a name on every letter of the club.", "We explain {{name}} literally; ask us."]
    df = spark.createDataFrame([(t, True) for t in bad] + [(t, False) for t in good], "t string, want boolean")
    assert [r.t for r in df.where(residue.is_residue(df.t) != df.want).collect()] == []
    deep = spark.createDataFrame([("{" + "a." * 50_000,), ("{{ a" + " | b" * 50_000,), ("~" + "a." * 50_000 + "b~",), ("__" + "a." * 20_000,)], "t string")
    assert [r.x for r in deep.select(residue.is_residue(deep.t).alias("x")).collect()] == [False, False, True, False]
