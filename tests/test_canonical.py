"""Canonical JSON against Python's own writer on the same values."""

import datetime as dt
import hashlib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions.canonical import canonical_json, canonical_row, digest, json_array, json_object, quoted

TEXTS = ["", "plain", 'quo"te \\ back/slash', "line\nbreak\r\t\b\f", "\x00\x01\x1f\x7f\x80\xa0", "äöü ß é", "漢字", "😀 \U0010ffff ퟿", "a" * 5000 + "é", "  </script>"]
MOMENT = dt.datetime(2024, 2, 29, 23, 59, 59, 123456)
DDL = (
    "zeta string, Alpha int, `a b.c` bigint, `é` boolean, price decimal(12,4), day date, at timestamp, whole double, few float, tags array<string>, numbers array<double>, nested struct<b:string,a:struct<y:array<int>,x:date>>, "
    "list array<struct<k:string,d:decimal(5,2),t:timestamp,n:array<string>>>, by_name map<string,int>, by_number map<int,string>, nothing void"
)


def rows(n=60, seed=1):
    chance = random.Random(seed)
    maybe = lambda v: None if chance.random() < 0.2 else v
    text = lambda: maybe(chance.choice(TEXTS))
    number = lambda: maybe(chance.choice([0.0, -0.0, 1.0, 1e16, 1e22, 1.5e-7, 0.1 + 0.2, 2.0**-44, 5e-324, 1.7976931348623157e308, 123456789.125, float("inf"), chance.random()]))
    moment = lambda: maybe(chance.choice([MOMENT, dt.datetime(1970, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 1), dt.datetime(2024, 7, 1, 12)]))
    day = lambda: maybe(dt.date(2000 + chance.randint(0, 30), 1 + chance.randint(0, 11), 1))
    money = lambda q: maybe(Decimal(chance.randint(-999, 999)) / 100).quantize(Decimal(q)) if chance.random() < 0.8 else None
    for _ in range(n):
        listed = maybe([maybe((text(), Decimal("1.50"), moment(), maybe([text(), text()]))) for _ in range(chance.randint(0, 3))])
        yield (text(), maybe(chance.randint(-5, 5)), maybe(chance.choice([2**63 - 1, -(2**63), 0])), maybe(True), Decimal("12.3400"), day(), moment(), number(), maybe(0.5), maybe([text() for _ in range(3)]), maybe([number() for _ in range(3)]),
               maybe((text(), maybe((maybe([1, None, -3]), day())))), listed, maybe({chance.choice(TEXTS): k for k in range(4)}), maybe({10: "x", 9: None, -1: "é"}), None)


def plain(value, kind, form):
    """A value as the writer takes it."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: plain(v, f.dataType, form) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, T.ArrayType):
        return [plain(v, kind.elementType, form) for v in value]
    if isinstance(kind, T.MapType):
        return {str(k): plain(v, kind.valueType, form) for k, v in value.items()}
    if isinstance(kind, T.TimestampType):
        aware = value.replace(tzinfo=dt.UTC)
        return aware.strftime("%Y-%m-%dT%H:%M:%S.%fZ") if form == "micros" else aware.isoformat() if form == "iso" else str(aware)
    if isinstance(kind, T.DateType):
        return value.isoformat()
    return str(value) if isinstance(kind, T.DecimalType) else value


@pytest.mark.parametrize(("ascii_only", "form"), [(True, "micros"), (False, "iso"), (True, "text")])
def test_equals_the_writer(spark, ascii_only, form):
    schema = T.StructType.fromDDL(DDL)
    made = list(rows())
    aware = lambda v: v.replace(tzinfo=dt.UTC) if isinstance(v, dt.datetime) else tuple(map(aware, v)) if isinstance(v, tuple) else list(map(aware, v)) if isinstance(v, list) else v
    frame = spark.createDataFrame([tuple(map(aware, r)) for r in made], schema)
    text = canonical_row(frame.schema, None, ascii_only, form)
    got = sorted((r.t, r.d) for r in frame.select(text.alias("t"), digest(text).alias("d")).collect())
    want = [json.dumps(plain(r, schema, form), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only) for r in made]
    assert got == sorted((t, hashlib.sha256(t.encode()).hexdigest()) for t in want)


def test_parts_compose(spark):
    frame = spark.createDataFrame([("x", ["b", None])], "a string, l array<string>")
    each = F.transform("l", lambda t: F.when(t.isNull(), "null").otherwise(quoted(t)))
    text = json_object({"z": F.lit('{"version":1}'), "a": canonical_json(F.col("a"), T.StringType()), "l": json_array(each)})
    assert frame.select(text.alias("t")).first().t == '{"a":"x","l":["b",null],"z":{"version":1}}'
    assert frame.limit(0).select(text.alias("t")).count() == 0


@pytest.mark.parametrize("ddl", ["c binary", "c array<struct<x:double>>", "c map<string,double>"])
def test_what_has_no_form_is_refused(spark, ddl):
    with pytest.raises(ValueError, match="canonical form"):
        canonical_row(T.StructType.fromDDL(ddl))
