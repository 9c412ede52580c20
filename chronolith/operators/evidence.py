"""Projections of observations: linkage evidence, absence contracts, serialized rows, small text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.text import contains_phrase, first_text, redirect_target, requisition_id, requisition_key
from chronolith.functions.values import publication_confidence, utc_micros
from chronolith.operators.lifecycle import carry_forward

# The parts of a payload that make its text, in order, and what stands in if all are empty.
TEXT_PARTS, TEXT_FALLBACK = ("description", "responsibilities", "qualifications", "benefits"), "raw_text"


def payload_value(payload: Column, key: str) -> Column:
    """A value of a JSON payload as text; a list's items are joined by a space; null and missing are empty."""
    value = F.get_json_object(payload, f"$.{key}")
    listed = F.array_join(F.from_json(value, "array<string>"), " ")
    return F.coalesce(F.trim(F.when(F.startswith(value, F.lit("[")), listed).otherwise(value)), F.lit(""))


def payload_text(payload: Column) -> Column:
    """The payload's text: its non-empty parts joined by a space, or the fallback if there are none."""
    parts = F.concat_ws(" ", *(F.nullif(payload_value(payload, p), F.lit("")) for p in TEXT_PARTS))
    return F.when(F.length(parts) > 0, parts).otherwise(payload_value(payload, TEXT_FALLBACK))


def posting_evidence(states: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """The evidence record of each selected posting: ``EVIDENCE`` columns.

    ``states``: posting_id, observation_id, source_id, source_posting_id, observed_at, first_seen_at, title,
    canonical_url, structured_payload, contract_payload (JSON texts); ``events``: posting_id, event_id, event_type,
    observed_at, created_at. Each value is the contract's, else the structured payload's, else empty.
    """
    order = F.struct("observed_at", "created_at", "event_id", "event_type")
    known = events.where(F.col("observed_at") <= as_of).groupBy("posting_id").agg(F.array_sort(F.collect_list(order)).alias("lifecycle_events"))
    told = states.join(known, "posting_id", "left").withColumn("lifecycle_events", F.coalesce("lifecycle_events", F.array().cast(known.schema["lifecycle_events"].dataType)))
    structured, contract = F.col("structured_payload"), F.col("contract_payload")
    pick = lambda theirs, own: first_text(payload_value(contract, theirs), payload_value(structured, own))
    text = F.coalesce(F.nullif(payload_text(structured), F.lit("")), payload_value(contract, TEXT_FALLBACK))
    return told.withColumns(
        {
            "lifecycle_status": F.coalesce(F.try_element_at("lifecycle_events", F.lit(-1))["event_type"], F.lit("ACTIVE_OBSERVED")),
            "employer": pick("raw_employer", "hiring_organization"),
            "text": text,
            "location": pick("raw_location", "location_raw"),
            "redirect_target": redirect_target(structured),
            "requisition_id": F.nullif(requisition_id(structured), F.lit("")),
            "requisition_provenance": F.nullif(requisition_key(structured), F.lit("")),
            "pensum_contract_start": F.trim(F.concat_ws(" ", *(payload_value(structured, k) for k in ("pensum", "employment_type", "start_date")))),
        }
    ).select(*EVIDENCE)


#: The columns of an evidence record.
EVIDENCE = (
    "posting_id", "observation_id", "source_id", "source_posting_id", "observed_at", "first_seen_at", "lifecycle_status", "lifecycle_events", "title",
    "employer", "text", "location", "canonical_url", "redirect_target", "requisition_id", "requisition_provenance", "pensum_contract_start",
)


def contract_payload(parsed: DataFrame) -> DataFrame:
    """The contract of each parsed posting, 22 fields in a struct ``contract``.

    ``parsed``: source_id, source_posting_id, run_id, observed_at, requested_url, canonical_url, http_status, title,
    raw_location, employer, contract_text (null: the four parts by line), the four text parts, raw_sha256,
    published_at_raw, source_published_at, source_updated_at, published_at_precision, published_at_parse_method,
    date_posted, municipality_bfs, municipality_name, municipality_canton.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    parts = F.concat_ws("\n", *(some(p) for p in TEXT_PARTS))
    place = F.struct(F.col("municipality_bfs").alias("bfs_code"), F.col("municipality_name").alias("municipality"), F.col("municipality_canton").alias("canton_code"), F.lit("MUNICIPALITY").alias("location_precision"))
    values = {
        "schema_version": F.lit("1.2"),
        "source_id": F.col("source_id"),
        "source_native_id": F.col("source_posting_id"),
        "observed_at": utc_micros(F.col("observed_at")),
        "observation_status": F.lit("ACTIVE"),
        "source_url": F.col("requested_url"),
        "canonical_url": F.col("canonical_url"),
        "http_status": F.col("http_status"),
        "raw_title": F.col("title"),
        "raw_location": some("raw_location"),
        "raw_employer": some("employer"),
        "raw_text": F.nullif(F.coalesce("contract_text", parts), F.lit("")),
        "raw_payload_sha256": F.col("raw_sha256"),
        "published_at_raw": F.col("published_at_raw"),
        "source_published_at": utc_micros(F.col("source_published_at")),
        "source_updated_at": utc_micros(F.col("source_updated_at")),
        "published_at_precision": F.col("published_at_precision"),
        "published_at_parse_method": F.col("published_at_parse_method"),
        "published_at_confidence": publication_confidence(F.col("published_at_raw"), F.col("published_at_precision"), F.col("date_posted"), F.col("source_published_at")),
        "collector_run_id": F.col("run_id"),
        "source_health_status": F.lit("HEALTHY"),
        "normalized_location": F.when(F.col("municipality_bfs").isNotNull(), place),
    }
    return parsed.withColumn("contract", F.struct(*(v.alias(k) for k, v in values.items())))


def absence_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """NOT_FOUND observations with the title and URL that the posting last had."""
    active = F.col("observation_status") == "ACTIVE"
    carried = carry_forward(rows, keys, order, active, {"last_title": "title", "last_url": "canonical_url"})
    return carried.where("observation_status = 'NOT_FOUND'").withColumns({"title": F.coalesce("last_title", F.lit("")), "canonical_url": F.coalesce("last_url", F.lit(""))}).drop("last_title", "last_url")


def serialized(rows: DataFrame, columns: list[str], detail: list[str] | None = None) -> DataFrame:
    """Each row as JSON; detail columns only if asked for."""
    return rows.select(F.to_json(F.struct(*columns, *(detail or [])), {"ignoreNullFields": "false"}).alias("row"))


def workload(payload: Column) -> Column:
    """What a payload says of the workload, 100 characters at most."""
    return F.substring(first_text(payload_value(payload, "pensum"), payload_value(payload, "workload")), 1, 100)


def joined_observed(values: Column) -> Column:
    """Distinct non-blank values in order, joined by ``; ``."""
    return F.array_join(F.array_distinct(F.filter(F.transform(values, F.trim), lambda v: F.length(v) > 0)), "; ")


def posting_id_of(url: Column) -> Column:
    """The last number in a URL's path, or null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"(\d+)(?:\.html?)?/?$", 1), F.lit(""))


def without_prefix(name: Column, prefix: str) -> Column:
    """A name without a prefix that it must have."""
    return F.when(F.startswith(name, F.lit(prefix)), F.trim(F.substring(name, len(prefix) + 1, 1_000_000))).otherwise(F.raise_error(F.concat(F.lit("no such prefix: "), name)).cast("string"))


def retrieved(text: Column, any_of: list[str], core: list[str], context: list[str]) -> Column:
    """Extension: a text (normalized) with a decisive phrase, or with a core phrase and a context phrase."""
    some = lambda phrases: F.array_contains(F.array(*(contains_phrase(text, p) for p in phrases)), True)
    return some(any_of) | (some(core) & some(context))
