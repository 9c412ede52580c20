"""Compiled schemas against a plain recursive validator on generated documents."""

import datetime as dt
import json
import random
import re

import pytest

from chronolith.sources.json_schema import schema_errors, validated

SCHEMA = {
    "$schema": "x", "title": "posting", "type": "object", "required": ["id", "at", "a/b"], "additionalProperties": False, "minProperties": 1,
    "$defs": {"money": {"type": ["number", "null"], "minimum": 0, "exclusiveMaximum": 100, "multipleOf": 0.5}},
    "properties": {
        "id": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]+"}, "at": {"type": "string", "format": "date-time"}, "day": {"type": ["string", "null"], "format": "date"}, "a/b": {"type": "integer", "maximum": 5},
        "kind": {"enum": ["A", "B", 3, None, True]}, "version": {"const": "1.2"}, "price": {"$ref": "#/$defs/money"}, "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "maxLength": 2}},
        "place": {"type": ["object", "null"], "required": ["x"], "properties": {"x": {"type": "number", "exclusiveMinimum": -1}, "deep": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "boolean"}}, "additionalProperties": False}}}, "additionalProperties": {"type": "string"}},
        "either": {"anyOf": [{"type": "string", "minLength": 3}, {"type": "integer"}]}, "odd": {"not": {"type": "string"}}, "both": {"allOf": [{"type": "number"}, {"minimum": 2}]}, "any": True, "never": False, "few": {"maxProperties": 1},
    },
}


def real_day(text):
    try:
        return bool(dt.date.fromisoformat(text[:10]))
    except ValueError:
        return False


def number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def plain(value, schema, path=""):
    """(path, keyword) of all that a value breaks."""
    if schema is True:
        return
    if schema is False:
        yield path, "false"
        return
    kinds = {"null": value is None, "boolean": isinstance(value, bool), "string": isinstance(value, str), "object": isinstance(value, dict), "array": isinstance(value, list), "number": number(value), "integer": number(value) and value == int(value)}
    same = lambda a, b: type(a) is type(b) and a == b or number(a) and number(b) and a == b
    text, num = isinstance(value, str), number(value)
    rules = {
        "type": lambda s: any(kinds[k] for k in (s if isinstance(s, list) else [s])), "enum": lambda s: any(same(value, x) for x in s), "const": lambda s: same(value, s),
        "minimum": lambda s: not num or value >= s, "exclusiveMinimum": lambda s: not num or value > s, "maximum": lambda s: not num or value <= s, "exclusiveMaximum": lambda s: not num or value < s, "multipleOf": lambda s: not num or (value / s) == int(value / s),
        "minLength": lambda s: not text or len(value) >= s, "maxLength": lambda s: not text or len(value) <= s, "pattern": lambda s: not text or bool(re.search(s, value)),
        "format": lambda s: not text or real_day(value) and bool(re.fullmatch(r"\d{4}-\d\d-\d\d" if s == "date" else r"\d{4}-\d\d-\d\d[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)", value)),
        "minItems": lambda s: not isinstance(value, list) or len(value) >= s, "maxItems": lambda s: not isinstance(value, list) or len(value) <= s, "minProperties": lambda s: not isinstance(value, dict) or len(value) >= s, "maxProperties": lambda s: not isinstance(value, dict) or len(value) <= s,
        "anyOf": lambda s: any(not list(plain(value, x)) for x in s), "not": lambda s: bool(list(plain(value, s))),
    }
    yield from ((path, k) for k, holds in rules.items() if k in schema and not holds(schema[k]))
    at = lambda k: f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}"
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            yield from plain(x, schema["items"], at(k))
    if isinstance(value, dict):
        own = schema.get("properties", {})
        yield from ((at(k), "required") for k in schema.get("required", ()) if k not in value)
        for k, x in value.items():
            if k in own:
                yield from plain(x, own[k], at(k))
            elif schema.get("additionalProperties", True) is False:
                yield at(k), "additionalProperties"
            else:
                yield from plain(x, schema.get("additionalProperties", True), at(k))
    if "$ref" in schema:
        yield from plain(value, SCHEMA["$defs"]["money"], path)
    for s in schema.get("allOf", ()):
        yield from plain(value, s, path)


def documents(n=400, seed=1):
    chance = random.Random(seed)
    values = [None, True, False, 0, 1, -1, 3, 3.0, 7, 2.5, 99.75, 1e30, "", "a", "ab", "abcd", "abcde", "A", "1.2", "2024-02-30", "2024-02-29", "2024-02-29T10:00:00Z", "2024-02-29T10:00:00.5+01:00", "2024-02-29T25:00:00Z", "2024-02-29T10:00:00", "é漢", [], ["a"], ["abc", 1], ["a", "b", "c"], {}, {"x": 1}, {"x": "1", "y": 2}, {"x": 0, "y": "s", "deep": [{"n": True}, {"n": 1, "m/~": 2}, 3]}]
    good = {"id": "abc", "at": "2024-02-29T10:00:00Z", "a/b": 3}
    yield from [None, "", "{", "null", "[]", "3", '"x"', "{}", json.dumps(good)]
    for _ in range(n):
        doc = dict(good) if chance.random() < 0.8 else {}
        for _ in range(chance.randint(0, 4)):
            doc[chance.choice([*SCHEMA["properties"], "more", "m~/"])] = chance.choice(values)
        yield json.dumps(doc, ensure_ascii=False)


def test_equals_the_plain_validator(spark):
    made = list(documents())
    rows = spark.createDataFrame(list(enumerate(made)), "id int, doc string").repartition(4)
    got = {r.id: [tuple(e) for e in r.errors] for r in validated(rows, "doc", SCHEMA).collect()}
    for k, text in enumerate(made):
        try:
            want = sorted(plain(json.loads(text), SCHEMA))
        except (TypeError, ValueError):
            want = [("", "json")]
        assert got[k] == want, text
    assert sum(not e for e in got.values()) > 20
    assert validated(rows.limit(0), "doc", json.dumps(SCHEMA)).count() == 0


@pytest.mark.parametrize("schema", [{"typo": 1}, {"$ref": "other.json"}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}, {"enum": [[1]]}])
def test_schemas_that_are_refused(spark, schema):
    with pytest.raises(ValueError):
        schema_errors(spark.range(1).id.cast("string"), schema)
