"""JSON Schema documents as expressions: what a document breaks, and where.

A schema is walked once and becomes an expression over a VARIANT, so documents are read in the JVM, nested ones included.
An error is the place as a JSON pointer and the keyword that is broken. Keywords: type, enum, const, minimum, maximum,
exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength, pattern, format (date, date-time), items, minItems, maxItems,
required, properties, additionalProperties, minProperties, maxProperties, allOf, anyOf, not, $ref to a definition. Titles
and the like say nothing; any other keyword, and a definition that holds itself, is refused when the schema is read.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ERRORS = "array<struct<path:string,keyword:string>>"
_SILENT = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "$comment", "deprecated", "readOnly", "writeOnly"}
_KNOWN = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "items", "minItems", "maxItems", "required", "properties", "additionalProperties", "minProperties", "maxProperties", "allOf", "anyOf", "not", "$ref"}
_DATE = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
_FORMATS = {"date": _DATE + "$", "date-time": _DATE + r"[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"}


def _none() -> Column:
    return F.array().cast(_ERRORS)


def _pointer(name: str) -> str:
    return "/" + name.replace("~", "~0").replace("/", "~1")


class _Compiler:
    def __init__(self, whole: dict) -> None:
        self.whole, self.open = whole, ()

    def resolve(self, reference: str) -> dict:
        if not reference.startswith("#/"):
            raise ValueError(f"a reference beyond the document: {reference}")
        out = self.whole
        for part in reference[2:].split("/"):
            out = out[part.replace("~1", "/").replace("~0", "~")]
        return out

    def errors(self, value: Column, schema: dict | bool, path: Column) -> Column:
        """The errors of a value (a VARIANT that is there) against a schema."""
        told = lambda keyword, at=path: F.array(F.struct(at.alias("path"), F.lit(keyword).alias("keyword"))).cast(_ERRORS)
        if isinstance(schema, bool):
            return _none() if schema else told("false")
        if unknown := schema.keys() - _KNOWN - _SILENT:
            raise ValueError(f"unknown keywords: {sorted(unknown)}")
        kind = F.schema_of_variant(value)
        is_text, is_object, is_list = kind == "STRING", F.startswith(kind, F.lit("OBJECT")), F.startswith(kind, F.lit("ARRAY"))
        is_number = ~kind.isin("VOID", "BOOLEAN", "STRING") & ~is_object & ~is_list
        text, number = value.try_cast("string"), value.try_cast("double")
        is_a = {"null": kind == "VOID", "boolean": kind == "BOOLEAN", "string": is_text, "object": is_object, "array": is_list, "number": is_number, "integer": is_number & (F.rint(number) == number)}

        def equal(wanted: object) -> Column:
            if wanted is None or isinstance(wanted, bool):
                return kind == "VOID" if wanted is None else (kind == "BOOLEAN") & (text == str(wanted).lower())
            if isinstance(wanted, str):
                return is_text & (text == wanted)
            if isinstance(wanted, (int, float)):
                return is_number & (number == float(wanted))
            raise ValueError("enum and const take single values")

        checks: list[tuple[str, Column, Column]] = []  # keyword, where it applies, what must hold
        always = F.lit(True)
        if "type" in schema:
            kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            checks.append(("type", always, reduce(lambda a, b: a | b, (is_a[k] for k in kinds))))
        for keyword, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
            if values is not None:
                checks.append((keyword, always, reduce(lambda a, b: a | b, map(equal, values), F.lit(False))))
        for keyword, holds in {"minimum": lambda b: number >= b, "maximum": lambda b: number <= b, "exclusiveMinimum": lambda b: number > b, "exclusiveMaximum": lambda b: number < b, "multipleOf": lambda b: F.rint(number / b) == number / b}.items():
            if keyword in schema:
                checks.append((keyword, is_number, holds(float(schema[keyword]))))
        if "minLength" in schema:
            checks.append(("minLength", is_text, F.length(text) >= schema["minLength"]))
        if "maxLength" in schema:
            checks.append(("maxLength", is_text, F.length(text) <= schema["maxLength"]))
        if "pattern" in schema:
            checks.append(("pattern", is_text, F.regexp_like(text, F.lit(schema["pattern"]))))
        if schema.get("format") in _FORMATS:
            day = F.substring(text, 1, 10)
            checks.append(("format", is_text, F.regexp_like(text, F.lit(_FORMATS[schema["format"]])) & F.try_to_date(day, "yyyy-MM-dd").isNotNull()))
        found = [F.when(where & ~F.coalesce(holds, F.lit(False)), told(k)).otherwise(_none()) for k, where, holds in checks]

        if schema.keys() & {"items", "minItems", "maxItems"}:
            elements = value.try_cast("array<variant>")
            for keyword, holds in (("minItems", lambda b: F.size(elements) >= b), ("maxItems", lambda b: F.size(elements) <= b)):
                if keyword in schema:
                    found.append(F.when(is_list & ~holds(schema[keyword]), told(keyword)).otherwise(_none()))
            if "items" in schema:
                each = F.transform(elements, lambda x, k: self.errors(x, schema["items"], F.concat(path, F.lit("/"), k.cast("string"))))
                found.append(F.when(is_list, F.flatten(each)).otherwise(_none()))
        if schema.keys() & {"required", "properties", "additionalProperties", "minProperties", "maxProperties"}:
            fields = value.try_cast("map<string,variant>")
            names, own = F.map_keys(fields), schema.get("properties", {})
            for keyword, holds in (("minProperties", lambda b: F.size(names) >= b), ("maxProperties", lambda b: F.size(names) <= b)):
                if keyword in schema:
                    found.append(F.when(is_object & ~holds(schema[keyword]), told(keyword)).otherwise(_none()))
            for name in schema.get("required", ()):
                found.append(F.when(is_object & ~F.array_contains(names, name), told("required", F.concat(path, F.lit(_pointer(name))))).otherwise(_none()))
            for name, below in own.items():
                found.append(F.when(is_object & F.array_contains(names, name), self.errors(fields.getItem(name), below, F.concat(path, F.lit(_pointer(name))))).otherwise(_none()))
            if schema.get("additionalProperties", True) is not True:
                others = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*own) if own else F.lit(True))
                place = lambda e: F.concat(path, F.lit("/"), F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
                rest = schema["additionalProperties"]
                inside = (lambda e: told("additionalProperties", place(e))) if rest is False else (lambda e: self.errors(e["value"], rest, place(e)))
                found.append(F.when(is_object, F.flatten(F.transform(others, inside))).otherwise(_none()))
        if "$ref" in schema:
            if schema["$ref"] in self.open:
                raise ValueError(f"{schema['$ref']} holds itself")
            self.open += (schema["$ref"],)
            found.append(self.errors(value, self.resolve(schema["$ref"]), path))
            self.open = self.open[:-1]
        for below in schema.get("allOf", ()):
            found.append(self.errors(value, below, path))
        if "anyOf" in schema:
            fits = [F.size(self.errors(value, below, path)) == 0 for below in schema["anyOf"]]
            found.append(F.when(~reduce(lambda a, b: a | b, fits), told("anyOf")).otherwise(_none()))
        if "not" in schema:
            found.append(F.when(F.size(self.errors(value, schema["not"], path)) == 0, told("not")).otherwise(_none()))
        return F.concat(*found) if found else _none()


def schema_errors(document: Column, schema: dict | str) -> Column:
    """An array of ``(path, keyword)`` of what a JSON text breaks, empty if nothing; a text that is no JSON, or null, breaks
    ``json``."""
    whole = json.loads(schema) if isinstance(schema, str) else schema
    value = F.try_parse_json(document)
    broken = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("keyword"))).cast(_ERRORS)
    return F.when(value.isNull(), broken).otherwise(_Compiler(whole).errors(value, whole, F.lit("")))


def validated(rows: DataFrame, column: str, schema: dict | str) -> DataFrame:
    """Rows with ``errors``: the places and keywords that their document breaks, sorted."""
    return rows.withColumn("errors", F.array_sort(schema_errors(F.col(column), schema)))
