"""Canonical JSON: keys in order, no spaces, every value in one form, so that equal values have equal bytes and digests.

The text is what Python's ``json.dumps(value, sort_keys=True, separators=(",", ":"))`` gives once moments, days and decimals
are texts. An expression is generated from the schema; only the shortest form of floating-point numbers needs a UDF.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Forms of a moment: with microseconds and Z; as ISO 8601 with the offset; as text with the offset. The last two leave out
#: microseconds that are nought.
MOMENTS = ("micros", "iso", "text")
_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(text: Column, ascii_only: bool = True) -> Column:
    """A JSON string of a text; with ``ascii_only``, what is not ASCII as escapes of UTF-16 units."""
    unit = lambda code: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        over = code - 0x10000
        pair = F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        out = F
        for raw, short in _SHORT.items():
            out = out.when(c == raw, F.lit(short))
        out = out.when(code < 32, unit(code))
        return out.when(code > 0xFFFF, pair).when(code > 126, unit(code)).otherwise(c) if ascii_only else out.otherwise(c)

    simple = r"^[\x20-\x7E&&[^\x22\x5C]]*$" if ascii_only else r"(?s)^[^\x00-\x1F\x22\x5C]*$"
    body = F.when(F.regexp_like(text, F.lit(simple)), text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


@F.arrow_udf(T.StringType())
def shortest(numbers: pa.Array) -> pa.Array:
    """Floating-point numbers in their shortest form; NaN and Infinity as such."""
    return pa.array([None if x is None else json.dumps(float(x)) for x in numbers.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def shortest_of_each(lists: pa.Array) -> pa.Array:
    """``shortest`` for arrays; null elements as ``null``."""
    return pa.array([None if row is None else ["null" if x is None else json.dumps(float(x)) for x in row] for row in lists.to_pylist()], pa.list_(pa.string()))


def moment(value: Column, form: str = "micros") -> Column:
    """A moment, in UTC, as text."""
    if form not in MOMENTS:
        raise ValueError(f"unknown form of moments: {form}")
    if form == "micros":
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss" if form == "iso" else "yyyy-MM-dd HH:mm:ss")
    return F.concat(whole, F.when(F.pmod(F.unix_micros(value), F.lit(1_000_000)) != 0, F.date_format(value, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def json_object(fields: dict[str, Column], ascii_only: bool = True) -> Column:
    """An object of canonical texts by key."""
    parts = []
    for k, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if k else "") + json.dumps(name, ensure_ascii=ascii_only) + ":"), fields[name]]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_array(texts: Column) -> Column:
    """An array of an array of canonical texts."""
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def canonical_json(value: Column, kind: T.DataType, ascii_only: bool = True, moments: str = "micros", _inside: bool = False) -> Column:
    """The canonical text of a value of the given type; a null is ``null``.

    Decimals are texts with their scale (of no exponent: those of more than six places after the point may differ from
    Python's text), days ISO texts, map keys texts in their order. Binary values and floating-point numbers inside arrays
    of structs or maps are refused.
    """
    below = lambda c, t, inside=_inside: canonical_json(c, t, ascii_only, moments, inside)
    if isinstance(kind, T.StructType):
        text = json_object({f.name: below(value.getField(f.name), f.dataType) for f in kind.fields}, ascii_only) if kind.fields else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.DoubleType, T.FloatType)) and not _inside:
            text = json_array(shortest_of_each(value.cast("array<double>")))
        else:
            text = json_array(F.transform(value, lambda x: below(x, kind.elementType, True)))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), below(e["value"], kind.valueType, True).alias("v")))
        pairs = F.transform(F.array_sort(entries), lambda e: F.concat(quoted(e["k"], ascii_only), F.lit(":"), e["v"]))
        text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        if _inside:
            raise ValueError("floating-point numbers inside arrays of structs or maps have no canonical form here: make them decimals")
        text = shortest(value.cast("double"))
    elif isinstance(kind, T.BooleanType):
        text = F.when(value, "true").otherwise("false")
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, T.TimestampType):
        text = F.concat(F.lit('"'), moment(value, moments), F.lit('"'))
    elif isinstance(kind, (T.DateType, T.DecimalType)):
        text = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    elif isinstance(kind, T.StringType):
        text = quoted(value, ascii_only)
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise ValueError(f"no canonical form of {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(text)


def canonical_row(schema: T.StructType, columns: list[str] | None = None, ascii_only: bool = True, moments: str = "micros") -> Column:
    """The canonical object of a row's columns (all, if none are named)."""
    kinds = {f.name: f.dataType for f in schema.fields}
    return json_object({c: canonical_json(F.col(f"`{c}`"), kinds[c], ascii_only, moments) for c in columns or list(kinds)}, ascii_only)


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)
