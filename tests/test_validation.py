"""Records against schemas."""

from __future__ import annotations

import json

import pytest

from lexigrain.plans.validation import SchemaError, supported, validated

SCHEMA = {
    "type": "object", "required": ["a"], "additionalProperties": False,
    "properties": {"a": {"type": ["integer", "null"], "minimum": 1, "maximum": 3}, "b": {"type": "array", "minItems": 1, "items": {"type": "string", "pattern": "^x"}}, "c": {"const": {"k": [1, True]}}, "d": {"enum": [1, "two"]}, "e": {"anyOf": [{"type": "boolean"}, {"type": "number", "minimum": 5}]}, "f": {"type": "string", "format": "date-time"}},
}
CASES = [
    ({"a": 1}, []),
    ({"a": None}, []),
    ({"a": 2.0, "c": {"k": [1.0, True]}, "d": "two", "e": 7, "b": ["x"], "f": "2026-02-28T10:00:00.123Z"}, []),
    ({}, ['$: missing required key "a"']),
    ([], ["$: expected type object, got array"]),
    ({"a": 4, "z": 0}, ['$: unexpected key "z"', "$.a: 4 > maximum 3"]),
    ({"z": 0, "y": 1}, ['$: missing required key "a"', '$: unexpected key "y"', '$: unexpected key "z"']),
    ({"a": True}, ["$.a: expected type integer,null, got boolean"]),
    ({"a": 1.5}, ["$.a: expected type integer,null, got number"]),
    ({"a": 1, "b": []}, ["$.b: needs at least 1 item(s)"]),
    ({"a": 1, "b": ["x", "y", 3]}, ["$.b[1]: does not match pattern ^x", "$.b[2]: expected type string, got number"]),
    ({"a": 1, "c": {"k": [1, 1]}}, ['$.c: must equal {"k":[1,true]}']),
    ({"a": 1, "c": {"k": [1, True], "l": 1}}, ['$.c: must equal {"k":[1,true]}']),
    ({"a": 1, "c": {"k": [1]}}, ['$.c: must equal {"k":[1,true]}']),
    ({"a": 1, "d": True}, ['$.d: must be one of 1, "two"']),
    ({"a": 1, "d": None}, ['$.d: must be one of 1, "two"']),
    ({"a": 1, "e": 3}, ["$.e: does not satisfy any allowed alternative"]),
    ({"a": 1, "f": "2026-02-30T10:00:00Z"}, ["$.f: not an ISO-8601 date-time"]),
    ({"a": 1, "f": "2026-01-01 00:00:00Z"}, ["$.f: not an ISO-8601 date-time"]),
    ({"a": 1, "f": "2026-01-01T25:00:00Z"}, ["$.f: not an ISO-8601 date-time"]),
    ({"a": 1, "f": "2026-01-01T00:00:00+02:00"}, []),
    ({"a": 1, "f": "2026-01-01T00:00:00+24:00"}, ["$.f: not an ISO-8601 date-time"]),
    (None, ["$: expected type object, got null"]),
    ("text", ["$: expected type object, got string"]),
]


def checked(spark, texts, schema):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, record string")
    return [list(r.problems) for r in validated(df, schema).orderBy("id").collect()]


def test_problems(spark):
    assert checked(spark, [json.dumps(v) for v, _ in CASES], SCHEMA) == [want for _, want in CASES]


def test_schemas_are_checked():
    supported(SCHEMA)
    for bad in ({"oneOf": []}, {"properties": {"a": {"maxLength": 1}}}, {"items": {"type": "word"}}, {"anyOf": [{"not": {}}]}, {"definitions": {"d": {"if": {}}}}):
        with pytest.raises(SchemaError):
            supported(bad)


def test_values(spark):
    value = {"a": [1, None], "b": True, "c": {"d": "x"}}
    same = ['{"c":{"d":"x"},"b":true,"a":[1.0,null]}']
    other = ['{"a":[1,null],"b":1,"c":{"d":"x"}}', '{"a":[1],"b":true,"c":{"d":"x"}}', '{"a":[1,null],"b":true}', '{"a":[1,null],"b":true,"c":{"d":"x"},"e":1}', "1", "null"]
    assert [not p for p in checked(spark, [*same, *other], {"const": value})] == [True] + [False] * len(other)


def test_nested_arrays(spark):
    schema = {"type": "array", "items": {"type": "array", "items": {"anyOf": [{"type": "null"}, {"properties": {"n": {"type": "number", "maximum": 2}}, "type": "object"}]}}}
    assert checked(spark, ['[[null,{"n":1}],[],[{"n":3},7]]', "[]", "[1]"], schema) == [["$[2][0]: does not satisfy any allowed alternative", "$[2][1]: does not satisfy any allowed alternative"], [], ["$[0]: expected type array, got number"]]


def test_records(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, "{"), (3, None), (4, '{"a":9}')], "id long, record string")
    out = validated(df, SCHEMA)
    got = {r.id: list(r.problems) for r in out.collect()}
    assert got[1] == [] and got[2] == ["$: not JSON"] and got[3] == ["$: no record"] and got[4] == ["$.a: 9 > maximum 3"]
    assert "Python" not in out._jdf.queryExecution().toString()
    assert validated(df.limit(0), SCHEMA).count() == 0
