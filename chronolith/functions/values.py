"""Dates, numbers and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
GERMAN_MONTHS = ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"]


def iso_date(text: Column) -> Column:
    """The date in a text's first ten characters, or null."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def iso_timestamp(text: Column) -> Column:
    """An ISO timestamp; without an offset it is UTC (the session's zone)."""
    return F.try_to_timestamp(F.trim(text))


def aware_timestamp(text: Column) -> Column:
    """An ISO timestamp with an offset or ``Z``; one without fails, one that is no timestamp is null."""
    aware = F.regexp_like(F.trim(text), F.lit(r"(?i)\d(z|[+-]\d{2}:?\d{2})$"))
    moment = iso_timestamp(text)
    return F.when(moment.isNotNull() & ~aware, F.raise_error(F.concat(F.lit("no time zone: "), text)).cast("timestamp")).otherwise(moment)


def dotted_date(text: Column) -> Column:
    """``7.8.2026``."""
    return F.try_to_date(F.trim(text), "d.M.yyyy")


def german_date(text: Column) -> Column:
    """``7. August 2026``."""
    pattern = r"(\d{1,2})\.\s*(\p{L}+)\s+(\d{4})"
    part = lambda k: F.regexp_extract(text, pattern, k)
    month = F.array_position(F.array(*map(F.lit, GERMAN_MONTHS)), F.lower(part(2)))
    spelled = F.concat_ws("-", part(3), F.lpad(F.nullif(month, F.lit(0)).cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.when(month > 0, F.try_to_date(spelled, "yyyy-MM-dd"))


def unix_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.try_cast("double"))


def utc_micros(moment: Column) -> Column:
    """Canonical UTC text with microseconds (the session's zone is UTC)."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end, with microseconds."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000.0)


def local_date_range(column: str, zone: str, first: str | None, last: str | None) -> Column:
    """Rows whose local date lies in a closed range, as a half-open range of instants so that scans can prune."""
    instant = lambda day, after: F.to_utc_timestamp(F.to_timestamp(F.date_add(F.to_date(F.lit(day)), after)), zone)
    condition = F.lit(True)
    if first:
        condition &= F.col(column) >= instant(first, 0)
    if last:
        condition &= F.col(column) < instant(last, 1)
    return condition


def optional_int(text: Column) -> Column:
    """An integer; blank and UNKNOWN are null."""
    return F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit("UNKNOWN")).try_cast("int")


def number(text: Column) -> Column:
    """A finite number of JSON text; truth values and everything else are null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.lower(F.trim(text)).isin("true", "false") & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def publication_confidence(raw: Column, precision: Column, day: Column, moment: Column) -> Column:
    """1 if a publication date was stated and read with the precision it claims, else null."""
    read = F.when(precision == "EXACT_DATE", day.isNotNull()).when(precision.isin("EXACT_DATETIME", "RELATIVE_RESOLVED"), moment.isNotNull())
    return F.when((F.length(raw) > 0) & read, F.lit(1.0))


def decimal_range(text: Column) -> Column:
    """``(low, high)`` of ``a`` or ``a-b``."""
    ends = F.split(F.trim(text), "-")
    value = lambda k: F.trim(F.get(ends, F.lit(k))).try_cast("decimal(14,2)")
    return F.struct(value(0).alias("low"), F.coalesce(value(1), value(0)).alias("high"))


def yes_no(text: Column) -> Column:
    """YES or NO; anything else fails."""
    return F.when(F.trim(text) == "YES", True).when(F.trim(text) == "NO", False).otherwise(F.raise_error(F.concat(F.lit("not YES or NO: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def row_fingerprint(*columns: str) -> Column:
    """SHA-256 of named values in the order of their names, each with its length, so that no value can pass for several;
    null differs from empty."""
    value = lambda c: F.col(c).cast("string")
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def dataset_fingerprint(rows: DataFrame, *columns: str) -> str:
    """A digest of a set of rows that no partitioning or order changes: rows are hashed where they are, digests are
    summed in 256 sub-streams by their first byte, and only those sums reach the driver."""
    digest = rows.select(row_fingerprint(*(columns or rows.columns)).alias("d"))
    words = [F.conv(F.substring("d", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    sums = digest.groupBy(F.substring("d", 1, 2).alias("head")).agg(F.count("*").alias("n"), *(F.sum(w).alias(f"s{k}") for k, w in enumerate(words)))
    text = F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", *(F.col(c).cast("string") for c in sums.columns)))))
    return sums.agg(F.sha2(text, 256)).first()[0]  # 256 rows at most
