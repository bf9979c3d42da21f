import json

import pytest

from factloom.operators import schemas as J

SCHEMA = {
    "$id": "x", "type": "object", "tier": "inferred", "required": ["name", "sizes"], "additionalProperties": False,
    "properties": {
        "name": {"type": "string", "minLength": 2, "maxLength": 5, "pattern": "^[a-z]+$"},
        "price": {"type": ["number", "null"], "exclusiveMinimum": 0, "maximum": 100, "multipleOf": 0.5},
        "count": {"type": "integer"},
        "kind": {"enum": ["a", 1, None, {"b": [1.0], "a": 2}]},
        "fixed": {"const": True},
        "day": {"type": "string", "format": "date"},
        "a/b~c": {"type": "string"},
        "sizes": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "object", "required": ["w"], "properties": {"w": {"type": "number", "minimum": 1}, "tags": {"type": "array", "items": {"enum": ["x", "y"]}}}}},
        "more": {"allOf": [{"type": "object"}, {"minProperties": 1, "maxProperties": 2}]},
    },
}


def check(spark, docs, schema=SCHEMA):
    rules = J.compile_schemas(spark.createDataFrame([("c", None, json.dumps(schema))], "category string, tier string, document string"))
    records = spark.createDataFrame([(i, "c", d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)], "id long, category string, document string")
    rows = {r.id: r for r in J.check_records(records, rules).collect()}
    return [(rows[i].missing, [(e.path, e.keyword) for e in rows[i].errors]) for i in range(len(docs))]


def test_nested_rules(spark):
    ok = {"name": "abc", "sizes": [{"w": 2}]}
    cases = [
        (ok, [], []),
        ({**ok, "price": 1.5, "count": 2.0, "kind": {"a": 2.0, "b": [1]}, "fixed": True, "day": "2024-02-29", "a/b~c": "x", "more": {"k": 1}}, [], []),
        ({**ok, "price": None, "kind": None}, [], []),
        ({}, ["name", "sizes"], []),
        ({"name": "A", "sizes": []}, [], [("/name", "minLength"), ("/name", "pattern"), ("/sizes", "minItems")]),
        ({**ok, "name": "abcdefg"}, [], [("/name", "maxLength")]),
        ({**ok, "name": 5}, [], [("/name", "type")]),
        ({**ok, "price": "5"}, [], [("/price", "type")]),
        ({**ok, "price": 0}, [], [("/price", "exclusiveMinimum")]),
        ({**ok, "price": 100.25}, [], [("/price", "maximum"), ("/price", "multipleOf")]),
        ({**ok, "count": 2.5, "kind": "b", "fixed": 1}, [], [("/count", "type"), ("/fixed", "const"), ("/kind", "enum")]),
        ({**ok, "kind": 1.0}, [], []),
        ({**ok, "day": "2023-02-29"}, [], [("/day", "format")]),
        ({**ok, "day": "soon"}, [], [("/day", "format")]),
        ({**ok, "a/b~c": 1, "new": 1}, [], [("/", "additionalProperties"), ("/a~1b~0c", "type")]),
        ({"name": "abc", "sizes": [{"w": 0}, {"tags": ["x", "z"]}, {"w": 3, "tags": "x"}, {"w": 3, "tags": "x"}]}, ["w"], [("/sizes", "maxItems"), ("/sizes", "uniqueItems"), ("/sizes/0/w", "minimum"), ("/sizes/1/tags/1", "enum"), ("/sizes/2/tags", "type"), ("/sizes/3/tags", "type")]),
        ({**ok, "more": {}}, [], [("/more", "minProperties")]),
        ({**ok, "more": []}, [], [("/more", "type")]),
        ([1], [], [("/", "type")]),
        ("{broken", [], [("/", "json")]),
        (None, [], [("/", "json")]),
    ]
    for (doc, missing, errors), got in zip(cases, check(spark, [c[0] for c in cases]), strict=True):
        assert got == (missing, errors), doc


@pytest.mark.parametrize(("schema", "what"), [({"properties": {"a": {"minimun": 1}}}, "/a: minimun: unknown keyword"), ({"format": "hue"}, "no such format"), ({"type": "text"}, "no such type"), ({"additionalProperties": {"type": "string"}}, "only true and false"), ({"anyOf": []}, "unknown keyword")])
def test_what_is_unknown_is_an_error(spark, schema, what):
    with pytest.raises(ValueError, match=what):
        list(J.rules_of(schema))
    with pytest.raises(Exception, match="schema of c"):
        check(spark, [{}], schema)


def test_no_schema_and_odd_rows(spark):
    rules = J.compile_schemas(spark.createDataFrame([("c", "inferred", '{"required": ["a"]}'), ("d", "authoritative", None)], "category string, tier string, document string"))
    records = spark.createDataFrame([(1, "c", "{}"), (1, "c", "{}"), (None, "c", "{}"), (2, None, "{}"), (3, "e", '{"a": 1}')], "id long, category string, document string")
    got = sorted(((r.id or 0, r.category or "", r.valid, r.missing, r.tier) for r in J.check_records(records, rules).collect()))
    assert got == [(0, "c", False, ["a"], "inferred"), (1, "c", False, ["a"], "inferred"), (2, "", True, [], None), (3, "e", True, [], None)]
    assert J.check_records(records.limit(0), rules).count() == 0
    assert J.check_records(records, rules.limit(0)).filter("valid").count() == 4


def test_schema_files(spark, tmp_path):
    (tmp_path / "home__lamps__desk.json").write_text('{"required": ["a", "b"],\n "properties": {"a": {}, "c": {"type": "number"}}, "tier": "authoritative"}')
    (tmp_path / "home.json").write_text('{"type": "object"}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "note.txt").write_text("no schema")
    rows = {r.category: r for r in J.read_schemas(spark, str(tmp_path), ["home"]).collect()}
    lamp = rows["home/lamps/desk"]
    assert (lamp.required, lamp.optional, lamp.tier, lamp.display_name, lamp.version, lamp.active) == (["a", "b"], ["c"], "inferred", "desk", 1, True)
    assert rows["home"].tier == "authoritative" and rows["home"].optional == [] and not rows["bad"].active and len(rows) == 3
    stored = J.read_schemas(spark, str(tmp_path), []).filter("category = 'home'")
    from factloom.sources.store import absent

    assert {r.category for r in absent(J.read_schemas(spark, str(tmp_path), ["home"]), stored, ["category", "version"]).collect()} == {"home/lamps/desk", "bad"}
    assert J.compile_schemas(J.read_schemas(spark, str(tmp_path), [])).count() == 3


def test_one_plan_for_many_schemas(spark):
    many = spark.createDataFrame([(f"c{i}", "inferred", json.dumps({"properties": {"n": {"maximum": i}, "deep": {"properties": {"m": {"minimum": i}}}}})) for i in range(300)], "category string, tier string, document string")
    records = spark.createDataFrame([(i, f"c{i % 300}", json.dumps({"n": 150, "deep": {"m": 150}})) for i in range(600)], "id long, category string, document string")
    rules = J.compile_schemas(many)
    got = J.check_records(records, rules)
    assert got.filter("valid").count() == 2
    assert all([(e.path, e.keyword) for e in r.errors] == ([("/n", "maximum")] if r.id % 300 < 150 else [("/deep/m", "minimum")]) for r in got.filter("not valid").collect())


def test_rows_of_one_record(spark):
    """Rows of one id and category are one record, whether or not each of them is JSON."""
    rules = J.compile_schemas(spark.createDataFrame([("c", "inferred", '{"required": ["a"], "properties": {"b": {"type": "string"}}}')], "category string, tier string, document string"))
    records = spark.createDataFrame([(1, "c", '{"a": 1, "b": 2}'), (1, "c", '{"b": "x"}'), (2, "c", "{}"), (2, "c", "{"), (3, "c", "{"), (3, "c", None)], "id long, category string, document string")
    got = sorted((r.id, r.missing, [tuple(e) for e in r.errors]) for r in J.check_records(records, rules).collect())
    assert got == [(1, ["a"], [("/b", "type")]), (2, ["a"], []), (2, ["a"], [("/", "json")]), (3, [], [("/", "json")])]


def test_records_are_parsed_and_shuffled_once(spark):
    """However deep rules go, a record is read, parsed and taken apart once, and only its document is shuffled."""
    deep = {"properties": {"a": {"properties": {"b": {"items": {"properties": {"c": {"maximum": 4}}}}}}}}
    rules = J.compile_schemas(spark.createDataFrame([("c", "inferred", json.dumps(deep))], "category string, tier string, document string"))
    records = spark.createDataFrame([(i, "c", json.dumps({"a": {"b": [{"c": k} for k in range(i)]}})) for i in range(9)], "id long, category string, document string")
    got = J.check_records(records, rules)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(document") + plan.count("parse_json(document") == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    shuffled = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and ("id#" in x or "pattern#" in x)]
    assert len(shuffled) == 1 and "REPARTITION_BY_NUM" in shuffled[0], shuffled
    assert "SortMergeJoin" not in plan
    assert {r.id: [e.path for e in r.errors] for r in got.collect()} == {i: [f"/a/b/{k}/c" for k in range(5, i)] for i in range(9)}
