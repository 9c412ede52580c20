"""Which sources count, packages of governed rows, and the events and cycles of an operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.values import dataset_fingerprint, row_fingerprint
from chronolith.operators.expectations import ExpectationError, require_empty
from chronolith.operators.lookup import look_up
from chronolith.operators.rules import first_match
from chronolith.session import materialize

# Families that hold no vacancies, and what makes a source authoritative.
NO_VACANCIES = ("OFFICIAL_REFERENCE", "OFFICIAL_STATISTICS", "SALARY_REFERENCE")
AUTHORITATIVE = ("CANONICAL", "HIGH_CANONICALITY", "AGENCY_CANONICAL")


def source_policy() -> Column:
    """``(role, access)`` of a registry row: what it is needed for, and whether it may be collected."""
    outside = F.col("source_family").isin(*NO_VACANCIES) | (F.col("source_type") == "PUBLISHING_API")
    first = F.col("priority") == "P0"
    unit = F.contains(F.lower("coverage_scope"), F.lit("green unit"))
    role = [
        (outside, "NONE"),
        (F.col("source_family") == "OFFICIAL_CANTON", "REQUIRED"),
        ((F.col("source_family") == "OFFICIAL_FEDERAL") & first & F.col("canonicality").isin(*AUTHORITATIVE), "REQUIRED"),
        ((F.col("source_family") == "OFFICIAL_MUNICIPAL") & first & unit, "SUPPORTING"),
        ((F.col("source_family") == "OFFICIAL_MUNICIPAL") & first, "REQUIRED"),
    ]
    ready = (F.col("automation_status") == "READY_FOR_IMPLEMENTATION") & (F.col("legal_review_status") == "PUBLIC_DATA_DOCUMENTED")
    access = [(outside, "NOT_APPLICABLE"), (ready, "READY_FOR_IMPLEMENTATION")]
    return F.struct(first_match(role, "SUPPORTING").alias("role"), first_match(access, "BLOCKED_PENDING_ACCESS_REVIEW").alias("access"))


def cohort(universe: DataFrame, blocked: DataFrame, expected: int | None = None) -> DataFrame:
    """Required sources that are not blocked; if a number is expected, any other is refused."""
    found = universe.where("role = 'REQUIRED'").join(blocked.select("source_id").distinct(), "source_id", "left_anti")
    if expected is not None and (n := found.count()) != expected:
        raise ExpectationError(f"{n} sources, {expected} expected")
    return found


def inventory(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``table, key, digest`` of every row of a package."""
    parts = [rows.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), row_fingerprint(*rows.columns).alias("digest")) for name, (rows, key) in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def relationships(rows: DataFrame, table: str, key: str, targets: dict[str, str]) -> DataFrame:
    """``table, key, field, target_table, target_key``: the references of each row; nulls refer to nothing."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(t).alias("target_table"), F.col(c).cast("string").alias("target_key")) for c, t in targets.items()))
    flat = rows.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.inline(fields))
    return flat.where("target_key IS NOT NULL")


def dangling(edges: DataFrame, known: DataFrame) -> DataFrame:
    """References to rows that the package does not hold."""
    return edges.join(known.select(F.col("table").alias("target_table"), F.col("key").alias("target_key")), ["target_table", "target_key"], "left_anti")


def distinct_events(events: DataFrame, cycle: str, fingerprint: str, order: list[str]) -> DataFrame:
    """One event for each cycle and fingerprint: the first by ``order``."""
    return events.groupBy(cycle, fingerprint).agg(F.min_by(F.struct(*events.columns), F.struct(*order)).alias("_first")).select("_first.*")


def against_previous(cycles: DataFrame, keys: list[str], succeeded: Column, order: list[Column], values: list[str]) -> DataFrame:
    """Successful cycles of each key with the values of the successful one before, and whether any differs."""
    if not keys:
        raise ValueError("cycles are compared within a key: without one they would all meet in one task")
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = cycles.where(succeeded).withColumns({f"previous_{v}": F.lag(v).over(by) for v in values}).withColumn("_n", F.row_number().over(by))
    differs = F.lit(False)
    for v in values:
        differs |= ~F.col(v).eqNullSafe(F.col(f"previous_{v}"))
    return rows.withColumn("changed", (F.col("_n") > 1) & differs).drop("_n")


def zscores(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Extension: each value's distance from its group's mean in standard deviations, and their mean. Groups are summed
    before the shuffle, and those of very many rows are answered by a broadcast. Null keys are keys like any other."""
    known = materialize(rows.withColumn("_group", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})), "rows")
    stats = materialize(known.groupBy("_group").agg(*(f(v).alias(f"_{n}_{v}") for v in values for n, f in (("m", F.avg), ("s", F.stddev_samp)))), "groups")
    found = look_up(known, stats, "_group")
    scored = found.withColumns({f"z_{v}": F.try_divide(F.col(v) - F.col(f"_m_{v}"), F.col(f"_s_{v}")) for v in values}).select(*rows.columns, *(f"z_{v}" for v in values))
    return scored.withColumn("pressure", sum((F.col(f"z_{v}") for v in values), F.lit(0.0)) / len(values))


def package_manifest(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row that stands for a package: rows by table, and digests of its rows and of its references, which no order or
    partitioning changes.

    ``rows``: ``inventory``; ``edges``: ``relationships`` with ``included``.
    """
    tables = rows.groupBy("table").agg(F.count("*").alias("n"))
    counted = tables.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "n"))))).alias("row_counts"))  # a row a table
    spark = rows.sparkSession
    digests = spark.createDataFrame([(dataset_fingerprint(rows, "table", "key", "digest"), dataset_fingerprint(edges, "table", "key", "field", "target_table", "target_key", "included"))], "rows_sha256 string, edges_sha256 string")
    return counted.crossJoin(digests)  # one row each


def with_included(edges: DataFrame, known: DataFrame) -> DataFrame:
    """References with whether the package holds what they refer to."""
    held = known.select(F.col("table").alias("target_table"), F.col("key").alias("target_key"), F.lit(True).alias("included"))
    return edges.join(held, ["target_table", "target_key"], "left").withColumn("included", F.coalesce("included", F.lit(False)))


def import_package(package: DataFrame, manifest: DataFrame, edges: DataFrame, current: DataFrame) -> DataFrame:
    """The rows of a package that are to be inserted. A package that is not what its manifest says, or that holds a row
    which differs from the current one of its key, is refused; identical rows are left out."""
    if package_manifest(package, edges).first() != manifest.first():
        raise ExpectationError("the package is not what its manifest says")
    both = package.join(current.select("table", "key", F.col("digest").alias("_now")), ["table", "key"], "left")
    require_empty(both.where(F.col("_now") != F.col("digest")), "a row of the package differs from the current one")
    return both.where("_now IS NULL").drop("_now")


def outcome_distribution(decisions: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """``outcome, n, expected, agrees``: decisions by outcome against the numbers that were announced."""
    wanted = decisions.sparkSession.createDataFrame(sorted(expected.items()), "outcome string, expected bigint")
    counted = decisions.groupBy(F.col(column).alias("outcome")).agg(F.count("*").alias("n"))
    both = counted.join(wanted, "outcome", "full_outer").withColumns({"n": F.coalesce("n", F.lit(0)), "expected": F.coalesce("expected", F.lit(0))})
    return both.withColumn("agrees", F.col("n") == F.col("expected"))
