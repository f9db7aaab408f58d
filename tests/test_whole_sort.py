from rollbook.operators import merge


def test_whole_export_is_sorted(spark):
    rows = [(i, f"Firm {i * 7919 % 1000:04d}") for i in range(1000)]
    merged = spark.createDataFrame(rows, "first_id long, company_name string").repartition(4)
    got = merge.positions(merge.final_order(merged)).select("position", "sort_key").collect()
    assert sorted(map(tuple, got)) == [(k + 1, n.lower()) for k, n in enumerate(sorted(n for _, n in rows))]
    assert merge.positions(merge.final_order(merged.limit(0))).count() == 0
