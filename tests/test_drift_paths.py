from test_drift import _files

from rollbook.operators import drift


def test_all_paths(spark):
    df = _files(spark, [{"metadata": {"Kind": "x"}, "members": [{"Phone-No": 7, "team": [{"name": "a"}, None]}, {"phone_no": "8", "team": None}]}, [{"phoneNo": True, "new": {"a": {"b": [1]}}}], None, "no json"])
    got = {(r.dump_id, r.place, r.rec, r.field, r.source_path, r.json_type, r.canonical) for r in drift.unified_paths(df).collect()}
    assert got == {
        (0, "metadata", 0, "entity_type", "Kind", "text", "x"), (0, "members", 0, "phoneno", "Phone-No", "number", "7"), (0, "members", 0, "team", "team", "list", '[{"name":"a"},null]'),
        (0, "members", 0, "team[]", "team[]", "object", '{"name":"a"}'), (0, "members", 0, "team[]", "team[]", None, None), (0, "members", 0, "team[].name", "team[].name", "text", "a"),
        (0, "members", 1, "phoneno", "phone_no", "text", "8"), (0, "members", 1, "team", "team", None, None), (1, "members", 0, "phoneno", "phoneNo", "flag", "true"),
        (1, "members", 0, "new", "new", "object", '{"a":{"b":[1]}}'), (1, "members", 0, "new.a", "new.a", "object", '{"b":[1]}'), (1, "members", 0, "new.a.b", "new.a.b", "list", "[1]"), (1, "members", 0, "new.a.b[]", "new.a.b[]", "number", "1"),
    }
    types = {(r.field, r.json_type, r["values"], r.files) for r in drift.path_types(df).collect()}
    assert {t for t in types if t[0] == "phoneno"} == {("phoneno", "number", 1, 1), ("phoneno", "text", 1, 1), ("phoneno", "flag", 1, 1)}
    changes = {(r.dump_id, r.field, r.change) for r in drift.path_changes(df).collect()}
    assert {c for c in changes if c[0] == 1} == {(1, f, "removed") for f in ("entity_type", "team", "team[]", "team[].name")} | {(1, f, "added") for f in ("new", "new.a", "new.a.b", "new.a.b[]")} | {(1, "phoneno", "renamed"), (1, "phoneno", "retyped")}
    assert {c for c in changes if c[0] == 2} == {(2, f, "removed") for f in ("phoneno", "new", "new.a", "new.a.b", "new.a.b[]")}
    assert drift.path_changes(df.limit(0)).count() == drift.unified_paths(df.limit(0)).count() == 0


def test_renames_by_values(spark):
    rows = lambda k, *vs: [{k: v, "id": i} for i, v in enumerate(vs)]
    df = _files(spark, [rows("tel", "1", "2", "3"), rows("fone", "2", "3", "4"), rows("other", "x", "y"), rows("other", "x", "y")])
    assert [(r.dump_id, r.old, r.new, r.shared, r.overlap) for r in drift.path_renames(df).collect()] == [(1, "tel", "fone", 2, 0.6667)]
    assert drift.path_renames(df.limit(0)).count() == 0
