import datetime as dt
import json

from rollbook.operators import drift

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "dump_id long, file_name string, source_url string, scraped_at timestamp, received_at timestamp, body string, field string"


def _files(spark, bodies, source="s"):
    rows = [(i, "f", source, T0 + dt.timedelta(days=20 * i), T0, b if b is None or isinstance(b, str) else json.dumps(b), "clash") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA)


def _changes(df):
    return {(r.dump_id, r.field, r.change) for r in drift.schema_changes(df).collect()}


def test_changes(spark):
    m = lambda **k: {"metadata": k.pop("meta", {}), "members": [k, {}]}
    files = [m(category="a", meta={"kind": "x"}), m(category="a", meta={"kind": ["x"]}), m(Category=1, meta={"entityType": "x"}), [{"Category": None}], [{"trade": {"name": "a"}}], m(other=1), None, "", "no json", m(category="a")]
    assert _changes(_files(spark, files)) == {
        (1, "entity_type", "retyped"), (2, "category", "renamed"), (2, "category", "retyped"), (2, "entity_type", "renamed"), (2, "entity_type", "retyped"),
        (3, "entity_type", "removed"), (4, "category", "renamed"), (5, "category", "removed"), (9, "category", "added"),
    }


def test_redelivery_and_quirks(spark):
    a = _files(spark, ["﻿" + json.dumps([{"category": "x"}]), '[{"trade": NaN, "trade": "x"}]'])
    assert _changes(a.union(a)) == {(1, "category", "renamed")}
    assert _changes(_files(spark, [])) == set()


def test_unified(spark):
    got = drift.unified(_files(spark, [{"metadata": {"kind": {"type": "x"}}, "members": [{"category": ["a", "b"]}, {"category": 7}, {"category": None}]}])).orderBy("field", "rec").collect()
    assert [(r.field, r.json_type, r.canonical) for r in got] == [("category", "list", "a; b"), ("category", "number", "7"), ("category", None, None), ("entity_type", "object", "x")]
