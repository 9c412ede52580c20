"""Contract-checked tables: CSV dimensions, JSON documents, raw objects."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.operators.expectations import ExpectationError, require_empty, unique
from chronolith.session import materialize


def strict_csv(spark: SparkSession, path: str, headers: list[str], count: int | None, key: str) -> DataFrame:
    """A CSV with exactly these headers, this many rows, and a key that is present and unique; values are trimmed
    and null is empty. A byte order mark on the first header is taken off."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    found = [c.removeprefix("﻿") for c in rows.columns]
    if found != headers:
        raise ExpectationError(f"headers are {found}")
    rows = rows.toDF(*headers).select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in headers))
    if count is not None and (n := rows.count()) != count:
        raise ExpectationError(f"{n} rows, {count} expected")
    require_empty(rows.where(F.length(key) == 0), f"empty {key}")
    require_empty(unique(rows, [key]), f"repeated {key}")
    return rows


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of raw files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def pinned_csv(spark: SparkSession, path: str, digest: str, headers: list[str], count: int | None, key: str) -> DataFrame:
    """``strict_csv`` of a file that must have this SHA-256."""
    found = file_digests(spark, path).first()
    if found is None or found.sha256 != digest:
        raise ExpectationError(f"{path} is not the pinned file")
    return strict_csv(spark, path, headers, count, key)


def safe_key(key: str) -> str:
    """A raw key that stays below its root: relative, without empty, ``.`` or ``..`` parts or odd characters."""
    parts = key.split("/")
    if not key or any(p in ("", ".", "..") for p in parts) or not re.fullmatch(r"[\w.\-/]+", key):
        raise ValueError(f"unsafe key {key!r}")
    return key


def read_raw(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """``path, content, sha256`` of raw objects by key."""
    files = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{safe_key(k)}" for k in keys])
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"))


def validated_documents(rows: DataFrame, column: str, schema: T.StructType, required: list[str], rules: dict[str, Column]) -> DataFrame:
    """Each JSON text as ``document`` with ``errors``: not JSON, missing or unknown keys, broken rules.

    ``rules`` are conditions on ``document``; null is no violation (absence is a matter of ``required``).
    """
    parsed = rows.withColumn("document", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    keys = F.json_object_keys(column)
    unknown = F.array_except(keys, F.array(*(F.lit(f.name) for f in schema.fields)))
    checks = [F.when(keys.isNull(), F.lit("not an object"))]
    checks += [F.when(F.col(f"document.{name}").isNull(), F.lit(f"missing {name}")) for name in required]
    checks += [F.when(~rule, F.lit(f"invalid {name}")) for name, rule in rules.items()]
    errors = F.array_compact(F.concat(F.array(*checks), F.coalesce(F.transform(unknown, lambda k: F.concat(F.lit("unknown "), k)), F.array().cast("array<string>"))))
    return parsed.withColumn("errors", errors)


def raw_key(source: Column, moment: Column, run: Column, kind: Column, digest: Column) -> Column:
    """Where a raw body is kept."""
    return F.concat_ws("/", F.lit("sources"), source, F.date_format(moment, "yyyy/MM/dd"), run, F.concat_ws("-", kind, F.substring(digest, 1, 16)))


def write_once(rows: DataFrame, path: str, key: str, digest: str) -> DataFrame:
    """Append raw rows under new keys, one for each. A key with the same digest again, in these rows or written before, is
    reused; with another one it is refused, and then nothing is written."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path).select(key, F.col(digest).alias("_known"))
    except Exception as missing:  # noqa: BLE001  nothing was written yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = rows.select(key, F.col(digest).alias("_known")).limit(0)
    given = materialize(rows, "raw")
    require_empty(given.groupBy(key).agg(F.count_distinct(digest).alias("n")).where("n > 1"), "a raw key is given with two contents")
    joined = given.dropDuplicates([key]).join(known, key, "left")
    require_empty(joined.where(F.col("_known") != F.col(digest)), "a raw key has other content")
    fresh = materialize(joined.where(F.col("_known").isNull()).drop("_known"), "raw")
    fresh.write.mode("append").parquet(path)
    written = spark.read.parquet(path).select(key, F.col(digest).alias("_written"))
    require_empty(fresh.join(written, key, "left").where(~F.col("_written").eqNullSafe(F.col(digest))), "a raw row was not written as given")
    return fresh


def insert_counted(rows: DataFrame, path: str, expected: int) -> DataFrame:
    """Write rows once; any other number of rows than expected is refused, and what was written is read back."""
    rows.write.parquet(path)
    out = rows.sparkSession.read.parquet(path)
    if (n := out.count()) != expected:
        raise ExpectationError(f"{n} rows written, {expected} expected")
    return out
