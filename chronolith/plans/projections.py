"""More of the catalogue: normal forms, parsers, locations, records, metrics, packages and listings. Importing this module
registers its queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import canonical
from chronolith.functions import text as X
from chronolith.functions import values as V
from chronolith.operators import evidence, governance, lifecycle, lineage, linkage, market, pit, places, readiness, rules, snapshot
from chronolith.operators.evidence import posting_evidence
from chronolith.plans import cycle
from chronolith.plans.catalogue import _CLUSTERS, _PAIRS, _pairs, at, query, table
from chronolith.session import materialize, shared_folder
from chronolith.sources import listings
from chronolith.sources.dimension import Dimension
from chronolith.sources.json_schema import validated

_FOLDED = "replace(lower(text), 'ß', 'ss')"


@query(rf"""SELECT doc_id, sha256(trim(regexp_replace({_FOLDED}, '\s+', ' ', 'g'))) AS matched, sha256(trim(regexp_replace({_FOLDED}, '[^\p{{L}}\p{{N}}_%]+', ' ', 'g'))) AS linked,
  sha256(trim(regexp_replace({_FOLDED}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS phrased, sha256(trim(regexp_replace({_FOLDED}, '\s+', ' ', 'g'))) AS titled FROM documents""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole texts in the forms for literal matching, linkage, phrases and titles."""
    digest = lambda c, name: F.sha2(c.cast("binary"), 256).alias(name)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digest(X.norm_ws("text"), "matched"), digest(X.norm_dedup("text"), "linked"), digest(X.norm_alnum("text"), "phrased"), digest(X.norm_title(F.col("text")), "titled"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE END AS number, p_name || ' & co' AS plain, CASE WHEN p_size % 2 = 0 THEN 'https://x.ch/' || p_partkey END AS redirect,
  CASE WHEN p_size % 4 = 0 THEN 1.0::DOUBLE END AS confidence, strftime(TIMESTAMP '2024-01-01 10:00:00' - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.%fZ') AS moment, CASE WHEN p_size % 5 < 3 THEN 'r' || p_partkey END AS requisition,
  CASE WHEN p_size % 5 < 3 THEN 'requisitionId' END AS named, 'A; b' AS observed, CASE WHEN p_size % 3 = 0 THEN p_size::INT END AS whole, p_size % 2 = 0 AS yes, p_size::DOUBLE AS low, (p_size + 1)::DOUBLE AS high FROM part""")
def field_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, tags, redirects, confidence, zoned times, requisitions, lists and ranges out of raw texts."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    payload = F.to_json(F.struct(F.when(size % 2 == 0, F.concat(F.lit("HTTPS://X.ch/"), key, F.lit("/?utm_source=a#b"))).alias("redirect_target"), F.struct(F.array(F.struct(F.when(size % 5 < 3, F.concat(F.lit(" r"), key)).alias("requisitionId"))).alias("jobs")).alias("page")))
    precision = F.when(size % 4 == 0, "EXACT_DATE").when(size % 4 == 1, "EXACT_DATETIME").otherwise("UNKNOWN")
    number = F.when(size % 3 == 0, size.cast("string")).when(size % 3 == 1, "true").otherwise("n/a")
    found = table(spark, sf_dir, "part").withColumn("p", payload).select(
        "p_partkey",
        V.number(number).alias("number"),
        X.without_tags(F.concat(F.lit("<p class='x'>"), "p_name", F.lit(" &amp;\n <b>co</b></p>"))).alias("plain"),
        X.redirect_target(F.col("p")).alias("redirect"),
        V.publication_confidence(F.lit("said"), precision, F.lit("2024-01-01").cast("date"), F.lit(None).cast("timestamp")).alias("confidence"),
        V.utc_micros(V.aware_timestamp(F.lit("2024-01-01T10:00:00+01:00"))).alias("moment"),
        F.nullif(X.requisition_id("p"), F.lit("")).alias("requisition"),
        F.nullif(X.requisition_key("p"), F.lit("")).alias("named"),
        F.array_join(F.array_distinct(F.filter(F.array(F.lit("A"), F.lit(""), F.lit("b"), F.lit("A")), lambda v: F.length(v) > 0)), "; ").alias("observed"),
        V.optional_int(F.when(size % 3 == 0, size.cast("string")).otherwise("UNKNOWN")).alias("whole"),
        V.yes_no(F.when(size % 2 == 0, "YES").otherwise("NO")).alias("yes"),
        V.decimal_range(F.concat(size.cast("string"), F.lit("-"), (size + 1).cast("string"))).alias("r"),
    )
    return found.select(*(c for c in found.columns if c != "r"), F.col("r.low").cast("double").alias("low"), F.col("r.high").cast("double").alias("high"))


_PLACED = """o AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 5 = 0 AS protected, c_custkey % 7 = 0 AS abroad, c_custkey % 11 AS own FROM customer),
d AS (SELECT *, CASE WHEN abroad THEN 'REVIEW' WHEN own = 2 THEN 'REVIEW' WHEN own = 1 THEN 'RESOLVED' WHEN n % 4 = 0 THEN 'REVIEW' WHEN n % 4 = 2 THEN 'REVIEW' ELSE 'RESOLVED' END AS status,
  CASE WHEN abroad THEN 'UNEXPECTED_COUNTRY' WHEN own = 2 THEN 'AMBIGUOUS_SOURCE_COORDINATES' WHEN own = 1 THEN NULL WHEN n % 4 = 0 THEN 'GEOCODER_CONTRADICTS_BFS' WHEN n % 4 = 2 THEN 'MULTIPLE_PLAUSIBLE_RESULTS' END AS reason FROM o),
e AS (SELECT *, CASE WHEN status <> 'RESOLVED' THEN 'UNKNOWN' WHEN own = 1 THEN 'EXACT_WORK_ADDRESS' WHEN protected THEN 'MUNICIPALITY' WHEN n % 4 = 3 THEN 'EXACT_WORK_ADDRESS' ELSE 'MUNICIPALITY' END AS prec, CASE WHEN protected THEN 'HIDDEN' ELSE 'EXACT_ALLOWED' END AS shown FROM d)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as observations in the towns of their nations, and a cache of what a geocoder says of each town."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    town = F.concat(F.lit("Town"), nation.cast("string"), F.lit("x"))
    point = F.struct(F.lit(46.5).alias("latitude"), F.lit(7.5).alias("longitude"))
    other = F.struct(F.lit(46.75).alias("latitude"), F.lit(7.5).alias("longitude"))
    empty = F.lit("")
    seen = table(spark, sf_dir, "customer").select(
        key.alias("observation_id"), F.lit("Weg 1").alias("street"), town.alias("locality"), F.lit("BE").alias("region"), empty.alias("postal_code"), F.when(key % 7 == 0, "DE").otherwise("CH").alias("country"),
        nation.cast("int").alias("municipality_bfs"), town.alias("municipality_name"), F.lit("BE").alias("municipality_canton"), F.when(key % 5 == 0, "PRIVATE_RESIDENCE").otherwise(places.PUBLIC).alias("privacy_context"), empty.alias("location_text"),
        F.when(key % 11 == 1, F.array(point)).when(key % 11 == 2, F.array(point, other)).otherwise(F.array().cast("array<struct<latitude:double,longitude:double>>")).alias("source_points"),
    )
    asked = places.requests(seen).select("request_fingerprint", "municipality_bfs", "municipality_name").distinct()
    attributes = lambda name: F.struct(name.alias("municipality"), F.lit("BE").alias("canton"), F.lit("CH").alias("country"), F.when(F.col("municipality_bfs") % 4 == 3, "address").otherwise("zipcode").alias("origin"))
    one = lambda lat, name: F.struct(F.struct(F.array(F.lit(7.25), lat).alias("coordinates")).alias("geometry"), F.struct(attributes(name).alias("attrs")).alias("properties"))
    here, kind = F.col("municipality_name"), F.col("municipality_bfs") % 4
    said = F.when(kind == 0, F.array(one(F.lit(46.25), F.lit("Elsewhere")))).when(kind == 2, F.array(one(F.lit(46.25), here), one(F.lit(46.5), here))).otherwise(F.array(one(F.lit(46.25), F.upper(here))))
    cache = asked.select("request_fingerprint", F.to_json(F.struct(said.alias("features"))).alias("response"))
    towns = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("bfs"), F.concat(F.lit("Town"), F.col("n_nationkey").cast("string"), F.lit("x")).alias("name"), F.lit("BE").alias("canton"))
    return places.resolve(seen, places.candidates(cache), towns)


@query(f"WITH {_PLACED} SELECT k AS observation_id, status AS resolution_status, reason AS review_reason, prec AS precision, shown AS display_level, CASE WHEN status = 'RESOLVED' AND NOT protected THEN CASE WHEN own = 1 THEN 46.5::DOUBLE ELSE 46.25::DOUBLE END END AS public_latitude FROM e")
def location_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations from a source's own coordinates or a geocoder's answers, with precision and privacy."""
    return _resolved(spark, sf_dir).select("observation_id", "resolution_status", "review_reason", "precision", "display_level", "public_latitude")


@query(f"""WITH {_PLACED}, f AS (SELECT unnest([('status', status), ('precision', prec), ('display', shown), ('mappable', CASE WHEN status = 'RESOLVED' AND NOT protected THEN 'MAPPABLE' ELSE 'UNMAPPABLE' END)]) AS p FROM e)
SELECT p[1] AS kind, p[2] AS value, count(*) AS n FROM f GROUP BY ALL""")
def location_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of resolutions, counted."""
    return places.batch_counts(_resolved(spark, sf_dir))


@query(f"""WITH {_PAIRS} SELECT a, b, CASE WHEN (a + b) % 3 = 0 THEN 'HUMAN' WHEN hard THEN 'HARD_KEY' ELSE 'RULE_SCORE' END AS method, CASE WHEN (a + b) % 3 = 0 THEN CASE WHEN a % 2 = 0 THEN 'MERGE' ELSE 'KEEP_SEPARATE' END ELSE outcome END AS outcome FROM pairs""")
def human_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs under earlier human decisions, which name them in either order."""
    pairs = materialize(_pairs(spark, sf_dir).select("a", "b", "hard_key", "outcome", F.lit("f").alias("fingerprint")), "pairs")
    known = pairs.where("(a + b) % 3 = 0").select(F.col("b").alias("posting_a"), F.col("a").alias("posting_b"), "fingerprint", F.when(F.col("a") % 2 == 0, "MERGE").otherwise("KEEP_SEPARATE").alias("human_outcome"), at("2024-01-01 00:00:00").alias("created_at"))
    late = pairs.select("a", "b", "fingerprint", F.lit("MERGE").alias("human_outcome"), at("2025-01-01 00:00:00").alias("created_at")).toDF(*known.columns)
    return linkage.with_human_decisions(pairs, known.union(late), at("2024-06-01 00:00:00")).select("a", "b", "method", "outcome")


@query("""SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey), '') AS profiles FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY c_custkey""")
def known_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All profiles (here: orders) that were available at a cutoff, in order."""
    profiles = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("available_at"), F.col("o_orderkey").alias("profile_id"), F.lit("").alias("evidence_text"))
    found = pit.known_profiles(table(spark, sf_dir, "customer").select("c_custkey"), profiles, at("1998-01-01 00:00:00"), ["c_custkey"])
    ids = F.transform(F.coalesce("profiles", F.array().cast(found.schema["profiles"].dataType)), lambda p: p["profile_id"].cast("string"))
    return found.select("c_custkey", F.array_join(ids, ",").alias("profiles"))


_RUNS = """u AS (SELECT s_suppkey AS source_id, s_suppkey % 9 = 0 AS blocked FROM supplier),
runs AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS source_id, o_orderkey AS run_id, o_orderdate AS t, o_orderstatus = 'F' AS failed, o_orderpriority = '5-LOW' AS degraded, o_orderkey % 3 <> 0 AS whole FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01'),
latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY t DESC, run_id DESC) = 1), complete AS (SELECT * FROM runs WHERE NOT failed AND NOT degraded AND whole QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY t DESC, run_id DESC) = 1),
j AS (SELECT u.source_id, blocked, f.t IS NOT NULL AND NOT blocked AS done, NOT blocked AND coalesce(NOT l.failed AND NOT l.degraded, false) AS healthy, CASE WHEN blocked THEN false WHEN f.t IS NOT NULL THEN f.t >= TIMESTAMP '2000-01-01' - INTERVAL 72 HOUR END AS fresh, l.failed, l.degraded
  FROM u LEFT JOIN latest l USING (source_id) LEFT JOIN complete f USING (source_id))"""


def _source_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    size, key = suppliers.count(), F.col("o_orderkey")
    universe = suppliers.select(F.col("s_suppkey").alias("source_id"), F.lit("X").alias("source_family"), (F.col("s_suppkey") % 9 == 0).alias("blocked"))
    counters = [F.when((key % 3 == 0) & F.lit(c == readiness.COUNTERS[0]), 1).otherwise(5).alias(c) for c in readiness.COUNTERS]
    runs = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % size).alias("source_id"), key.alias("run_id"), F.lit("FULL_SOURCE").alias("run_scope"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "DEGRADED").otherwise("HEALTHY").alias("source_health_status"), F.lit(True).alias("snapshot_complete"), *counters, F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"),
    )
    return readiness.source_evidence(universe, runs, at("2000-01-01 00:00:00"))


@query(f"""WITH {_RUNS} SELECT source_id, CASE WHEN NOT done THEN 'NO_ELIGIBLE_RUN' WHEN failed THEN 'FAILED' WHEN degraded THEN 'DEGRADED' WHEN healthy AND fresh THEN 'COMPLETE_HEALTHY' ELSE 'INCOMPLETE' END AS completion_status,
  CASE WHEN blocked THEN 'BLOCKED' WHEN fresh THEN 'FRESH' WHEN NOT fresh THEN 'STALE' ELSE 'NO_ACCEPTED_RUN' END AS freshness_state, done AND healthy AND coalesce(fresh, false) AS counts_toward_coverage FROM j""")
def source_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's latest runs say of it."""
    return _source_evidence(spark, sf_dir).select("source_id", "completion_status", "freshness_state", "counts_toward_coverage")


@query(f"""WITH {_RUNS}, m AS (SELECT unnest([('day0_acquisition_coverage', done AND healthy AND coalesce(fresh, false)), ('governed_disposition_coverage', blocked), ('required_source_run_coverage', done), ('required_source_freshness_coverage', coalesce(fresh, false)), ('source_health_coverage', healthy)]) AS p, source_id, done FROM j),
c AS (SELECT p[1] AS metric, count(*) FILTER (p[2]) AS numerator, count(*) AS denominator, coalesce(string_agg(source_id::VARCHAR, ',' ORDER BY source_id::VARCHAR) FILTER (p[2]), '') AS evidence FROM m GROUP BY p[1]
  UNION ALL SELECT 'canonical_source_coverage', count(*) FILTER (done AND source_id % 2 = 0), count(*) FILTER (source_id % 2 = 0), coalesce(string_agg(source_id::VARCHAR, ',' ORDER BY source_id::VARCHAR) FILTER (done AND source_id % 2 = 0), '') FROM j)
SELECT metric, numerator, denominator, round_even(numerator / denominator::DOUBLE, 6) AS ratio, sha256(evidence) AS evidence FROM c""")
def source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defined ratios over all sources, with the ids that count."""
    rows = _source_evidence(spark, sf_dir).withColumns({"canonical": F.col("source_id") % 2 == 0, "disposition": F.when(F.col("blocked"), "ACCEPTED_BLOCKED").otherwise("PENDING")})
    found = readiness.defined_metrics(rows, readiness.SOURCE_METRICS, "source_id")
    return found.select("metric", "numerator", "denominator", F.col("ratio").cast("double").alias("ratio"), F.sha2(F.array_join("evidence", ","), 256).alias("evidence"))


@query("""WITH n AS (SELECT doc_id, n_chars > 800 AS ok, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents),
m AS (SELECT ok, contains(t, ' of the ') AS p, contains(t, ' de la ') AS e, contains(t, ' on the ') AS w FROM n), c AS (SELECT ok, CASE WHEN NOT ok THEN 'SKIPPED_NOT_GREEN' WHEN p AND e THEN 'REVIEW' WHEN p OR e OR w THEN 'CLASSIFIED' ELSE 'NO_SUFFICIENT_EVIDENCE' END AS s,
  CASE WHEN NOT ok OR (p AND e) THEN 'UNKNOWN' WHEN e THEN 'PRIVATE_ESTATE_DIRECT' WHEN p THEN 'PRIVATE_RESIDENTIAL_PREMIUM' WHEN w THEN 'PRIVATE_RESIDENTIAL_STANDARD' ELSE 'UNKNOWN' END AS g FROM m)
SELECT count(*) AS considered, count(*) FILTER (ok) AS eligible, count(*) FILTER (s = 'CLASSIFIED') AS status_classified, count(*) FILTER (s = 'REVIEW') AS status_review, count(*) FILTER (s = 'NO_SUFFICIENT_EVIDENCE') AS status_no_sufficient_evidence, count(*) FILTER (s = 'SKIPPED_NOT_GREEN') AS status_skipped_not_green,
  count(*) FILTER (g = 'PRIVATE_RESIDENTIAL_STANDARD') AS segment_private_residential_standard, count(*) FILTER (g = 'PRIVATE_RESIDENTIAL_PREMIUM') AS segment_private_residential_premium, count(*) FILTER (g = 'PRIVATE_ESTATE_DIRECT') AS segment_private_estate_direct, count(*) FILTER (g = 'UNKNOWN') AS segment_unknown FROM c""")
def segment_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses and segments of a run, counted."""
    plain, empty = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), F.lit("")
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") > 800, "GREEN_CONFIRMED").otherwise("NOT_GREEN").alias("effective_result"), plain.alias("description"), *(empty.alias(c) for c in ("title", "benefits", "qualifications", "responsibilities")), F.array().cast("array<string>").alias("profiles"))
    return rules.segment_counts(rules.segments(docs, [rules.Signal(s, p, "JOB") for s, p in (("P001", "of the"), ("P006", "de la"), ("P008", "on the"))]))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' latest orders as vacancies, with all that a record takes."""
    orders = pit.latest_by_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    key, seen, empty = F.col("o_custkey"), F.col("o_orderdate"), F.lit("")
    states = orders.select(key.alias("vacancy_state_id"), key.alias("vacancy_key"), key.alias("canonical_posting"), key.alias("canonical_observation"), F.when(F.col("o_orderstatus") == "F", "CLOSED_OBSERVED").otherwise("ACTIVE").alias("status"), seen.alias("first_seen_at"), seen.alias("last_seen_at"), F.lit(None).cast("timestamp").alias("closed_observed_at"), F.when(key % 2 == 0, 3).alias("positions_count"), (key % 2 == 0).alias("multi_hire_possible"), F.lit(1).alias("episode_number"))
    structured = F.to_json(F.struct(F.when(key % 6 == 0, "expired_source").alias("canonical_url_status"), F.when(key % 2 == 0, " 80% ").alias("pensum")))
    contract = F.to_json(F.struct(F.when(key % 3 == 0, F.concat(F.lit("https://s.ch/"), key.cast("string"))).alias("source_url"), F.when(key % 2 == 1, "EXACT_DATE").alias("published_at_precision")))
    observations = orders.select(
        key.alias("observation_id"), F.lit("S").alias("source_name"), F.lit("PORTAL").alias("source_type"), F.when(key % 4 == 0, "CANONICAL").otherwise("OTHER").alias("canonicality"), F.concat(F.lit("<b>Job</b> "), key.cast("string")).alias("title"), F.lit("Town &amp; Co").alias("employer"),
        F.lit("<p>Do<script>x()</script> it</p>").alias("description_html"), F.when(key % 5 < 3, F.concat(F.lit("https://c.ch/"), key.cast("string"))).otherwise("ftp://c.ch").alias("canonical_url"), F.when(key % 2 == 0, F.to_date(seen)).alias("date_posted"), F.lit("zh").alias("region"), F.lit("Bern").alias("municipality_name"), F.lit("BE").alias("municipality_canton"),
        structured.alias("structured_payload"), contract.alias("contract_payload"),
    )
    context = F.when(key % 9 == 0, "PRIVATE_RESIDENCE").otherwise(places.PUBLIC)
    result = F.when(key % 4 == 3, "NOT_GREEN").when(key % 8 == 2, "REVIEW").otherwise("GREEN_CONFIRMED")
    assessments = orders.select(key.alias("observation_id"), key.alias("green_assessment_id"), key.alias("premium_assessment_id"), result.alias("effective_result"), F.lit("UNKNOWN").alias("segment"), F.lit("REVIEW").alias("assessment_status"), context.alias("privacy_context"))
    located = orders.where(key % 5 != 0).select(key.alias("location_resolution_id"), key.alias("observation_id"), context.alias("privacy_context"), F.when(key % 5 == 1, "REVIEW").otherwise("RESOLVED").alias("resolution_status"), F.lit("MUNICIPALITY").alias("precision"), F.when(key % 9 == 0, "HIDDEN").otherwise("EXACT_ALLOWED").alias("display_level"), F.when(key % 5 == 4, 999.0).otherwise(47.0).alias("public_latitude"), F.lit(8.0).alias("public_longitude"), F.lit("Chur").alias("resolved_municipality"), F.when(key % 5 == 3, "XX").otherwise("gr").alias("resolved_canton"))
    provenance = snapshot.provenance(states.select("vacancy_key", F.lit("CANONICAL").alias("membership_role"), F.col("canonical_posting").alias("posting_id"), F.col("canonical_posting").alias("source_posting_id")))
    return snapshot.record_plan(states, observations, assessments, located, provenance)


_RECORDS = """o AS (SELECT o_custkey AS k, o_orderdate AS seen, o_orderstatus AS st FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
a AS (SELECT *, CASE WHEN k % 4 = 3 THEN 'EXCLUDED_NOT_GREEN' WHEN k % 8 = 2 THEN 'REVIEW_NOT_PUBLIC' ELSE 'PUBLIC_GREEN_CONFIRMED' END AS vis, CASE WHEN k % 5 < 3 THEN 'https://c.ch/' || k ELSE '' END AS curl, CASE WHEN k % 3 = 0 THEN 'https://s.ch/' || k ELSE '' END AS surl, k % 9 = 0 AS prot FROM o),
b AS (SELECT *, CASE WHEN vis <> 'PUBLIC_GREEN_CONFIRMED' THEN 'LOCATION_UNRESOLVED' WHEN k % 5 = 0 AND prot THEN 'PRIVACY_RESOLUTION_MISSING' WHEN k % 5 = 0 THEN 'LOCATION_UNRESOLVED' WHEN k % 5 = 1 THEN 'LOCATION_REVIEW' WHEN prot THEN 'LOCATION_HIDDEN' WHEN k % 5 = 4 THEN 'PUBLIC_COORDINATES_MISSING' ELSE 'MAPPABLE' END AS map,
  CASE WHEN k % 6 = 0 THEN 'EXPIRED_SOURCE' WHEN curl <> '' AND k % 4 = 0 THEN 'CANONICAL' WHEN surl <> '' THEN 'DISCOVERY_OR_HISTORICAL' WHEN curl <> '' THEN 'REVIEW' ELSE 'NO_LINK_AVAILABLE' END AS link FROM a)"""


@query(f"""WITH {_RECORDS} SELECT k AS vacancy_key, vis AS visibility_status, map AS mapping_status, link AS source_link_status, CASE link WHEN 'EXPIRED_SOURCE' THEN coalesce(nullif(curl, ''), surl) WHEN 'CANONICAL' THEN curl WHEN 'DISCOVERY_OR_HISTORICAL' THEN surl ELSE '' END AS selected_external_url,
  CASE link WHEN 'EXPIRED_SOURCE' THEN 'Open expired link' WHEN 'CANONICAL' THEN 'Open original advert' WHEN 'DISCOVERY_OR_HISTORICAL' THEN 'Open observed source' ELSE '' END AS visible_link_label, 'Job ' || k AS title, 'Town & Co' AS employer, CASE WHEN prot THEN '' ELSE 'Do it' END AS safe_description,
  CASE WHEN k % 5 = 0 THEN 'Bern' ELSE 'Chur' END AS municipality_name, CASE WHEN k % 5 = 0 THEN 'BE' WHEN k % 5 = 3 THEN '' ELSE 'GR' END AS canton_code, CASE WHEN k % 2 = 1 THEN 'EXACT_DATE' ELSE 'UNKNOWN' END AS published_at_precision, CASE WHEN k % 5 = 0 THEN CASE WHEN prot THEN 'HIDDEN' ELSE '' END WHEN prot THEN 'HIDDEN' ELSE 'EXACT_ALLOWED' END AS privacy_display_level,
  CASE WHEN map = 'MAPPABLE' THEN 47.0::DOUBLE END AS public_display_latitude, CASE WHEN k % 2 = 0 THEN '80%' ELSE '' END AS workload, (k % 5 = 4 AND NOT prot)::INT AS n_flags, 43 AS n_columns FROM b""")
def record_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they are shown, those columns that are derived."""
    found = _records(spark, sf_dir)
    columns = ["vacancy_key", "visibility_status", "mapping_status", "source_link_status", "selected_external_url", "visible_link_label", "title", "employer", "safe_description", "municipality_name", "canton_code", "published_at_precision", "privacy_display_level", "public_display_latitude", "workload"]
    return found.select(*columns, F.size("quality_flags").alias("n_flags"), F.lit(len(found.columns)).alias("n_columns"))


@query(f"""WITH {_RECORDS}, p AS (SELECT *, vis = 'PUBLIC_GREEN_CONFIRMED' AS pub FROM b) SELECT count(*) AS total_vacancy_states, count(*) FILTER (pub) AS public_green_eligible, count(*) FILTER (vis = 'EXCLUDED_NOT_GREEN') AS excluded_not_green, count(*) FILTER (vis = 'REVIEW_NOT_PUBLIC') AS review_not_public,
  count(*) FILTER (pub AND map = 'MAPPABLE') AS mappable_vacancies, count(*) FILTER (pub AND map <> 'MAPPABLE') AS unmappable_vacancies, count(*) FILTER (pub AND k % 2 = 0) AS known_publication_dates, count(*) FILTER (pub AND k % 2 = 1) AS unknown_publication_dates, count(*) FILTER (k % 5 > 1) AS geospatial_resolved,
  count(*) FILTER (k % 5 = 1) AS geospatial_review, count(*) FILTER (k % 5 = 0) AS geospatial_unresolved, count(*) FILTER (prot) AS private_locations_protected FROM p""")
def plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot's counts."""
    return snapshot.plan_counts(_records(spark, sf_dir))


@query(f"""WITH {_RECORDS}, m AS (SELECT * FROM b WHERE vis = 'PUBLIC_GREEN_CONFIRMED' AND st <> 'F'), c AS (SELECT 'publication_date_coverage' AS metric, count(*) FILTER (k % 2 = 0) AS numerator, count(*) AS denominator FROM m
  UNION ALL SELECT 'geospatial_resolution_coverage', count(*) FILTER (map = 'MAPPABLE'), count(*) FROM m UNION ALL SELECT 'position_count_disclosure_coverage', count(*) FILTER (k % 2 = 0), count(*) FROM m UNION ALL SELECT 'source_link_provenance_coverage', count(*) FILTER (link NOT IN ('NO_LINK_AVAILABLE', 'REVIEW')), count(*) FROM m
  UNION ALL SELECT 'green_classification_coverage', count(*), count(*) FROM b UNION ALL SELECT 'dedup_resolution_quality', count(*), count(*) + 7 FROM m)
SELECT metric, numerator, denominator, round_even(numerator / denominator::DOUBLE, 6) AS ratio, 'COMPUTABLE' AS status FROM c UNION ALL SELECT 'geographic_coverage', NULL, NULL, NULL, 'NOT_COMPUTABLE' UNION ALL SELECT 'required_source_freshness_coverage', NULL, NULL, NULL, 'POLICY_PENDING'""")
def metrics_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of a readiness run over records and market, while the freshness policy is pending."""
    records = materialize(_records(spark, sf_dir), "records")
    market = records.where("visibility_status = 'PUBLIC_GREEN_CONFIRMED' AND vacancy_status = 'ACTIVE'")
    sources = _source_evidence(spark, sf_dir).withColumns({"canonical": F.lit(True), "disposition": F.lit("PENDING")})
    found = readiness.metrics_map(sources, records, market, False, 7)
    return found.where(~F.col("metric").isin(*(readiness.SOURCE_METRICS.keys() - {"required_source_freshness_coverage"}))).select("metric", "numerator", "denominator", F.col("ratio").cast("double").alias("ratio"), "status")


@query("""SELECT 'v' || c_custkey AS vacancy_id, 'v' || arg_min(c_custkey, (c_acctbal, 'v' || c_custkey)) OVER (PARTITION BY c_nationkey) AS winner, c_custkey <> arg_min(c_custkey, (c_acctbal, 'v' || c_custkey)) OVER (PARTITION BY c_nationkey) AS merged FROM customer""")
def merged_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of one cluster (here: a nation) merged into the one that was seen first."""
    rows = table(spark, sf_dir, "customer")
    identities = rows.select(F.col("c_custkey").alias("posting_id"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("vacancy_id"), F.col("c_acctbal").alias("first_seen_at"))
    return linkage.merged_identities(rows.select(F.col("c_custkey").alias("posting_id"), F.col("c_nationkey").alias("cluster")), identities)


@query("""SELECT 'r' || s_suppkey AS review_id, CASE WHEN s_suppkey % 2 = 0 THEN 'MERGE' ELSE 'KEEP_SEPARATE' END AS human_outcome, CASE WHEN s_suppkey % 2 = 0 THEN 'MERGED' ELSE 'KEPT_SEPARATE' END AS status FROM supplier WHERE s_suppkey % 3 = 0""")
def resolved_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human answers to pending pairs, as rows to append."""
    key = F.col("s_suppkey")
    reviews = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), key.cast("string")).alias("review_id"), key.alias("a"), (key + 1).alias("b"), F.lit("f").alias("fingerprint"), F.when(key % 3 == 0, "PENDING").otherwise("MERGED").alias("status"))
    asked = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("r"), key.cast("string")).alias("review_id"), (key % 2 == 0).alias("merge"), F.lit("seen").alias("reason"), at("2024-01-01 00:00:00").alias("resolved_at"))
    return linkage.resolved_reviews(reviews, asked).select("review_id", "human_outcome", "status")


@query("""SELECT o_orderstatus AS outcome, count(*) AS n, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END::BIGINT AS expected, count(*) = CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS agrees FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'X', 0, 5, false""")
def outcome_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes against the numbers announced."""
    return governance.outcome_distribution(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": 1, "O": 1, "X": 5})


@query("""WITH i AS (SELECT 'nation' AS "table", n_nationkey::VARCHAR AS key FROM nation WHERE n_nationkey % 4 <> 0) SELECT * FROM i""")
def package_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of two tables, checked against its manifest; rows that are there already are left out."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = governance.inventory({"nation": (nation, "n_nationkey"), "region": (region, "r_regionkey")})
    edges = governance.with_included(governance.relationships(nation, "nation", "n_nationkey", {"n_regionkey": "region"}), rows)
    there = rows.where("table = 'region' OR CAST(key AS INT) % 4 = 0")
    return governance.import_package(rows, governance.package_manifest(rows, edges), edges, there).select("table", "key")


_LISTED = """e AS (SELECT l_suppkey AS source_id, l_linenumber AS ordinal, count(*) AS n_entries, count(DISTINCT l_orderkey) AS ids FROM lineitem GROUP BY ALL), i AS (SELECT l_suppkey AS source_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL),
f AS (SELECT source_id, ordinal, n_entries, CASE WHEN source_id % 4 = 1 THEN 3 WHEN source_id % 4 = 2 THEN (SELECT n FROM i WHERE i.source_id = e.source_id) ELSE 0 END AS total, CASE WHEN source_id % 5 = 0 THEN ordinal END AS start, source_id % 7 = 0 AND ordinal = 2 AS broken FROM e)"""


@query(f"""WITH {_LISTED}, s AS (SELECT *, coalesce(sum(n_entries) OVER (PARTITION BY source_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS due FROM f),
g AS (SELECT source_id, count(*) FILTER (broken) AS errors, max(ordinal) - min(ordinal) + 1 <> count(*) AS gaps, count(DISTINCT nullif(total, 0)) AS totals, max(nullif(total, 0)) AS total, count(*) FILTER (start <> due) AS jumps FROM s GROUP BY source_id)
SELECT g.source_id, n, CASE WHEN errors > 0 THEN 'UNREADABLE_PAGE' WHEN gaps THEN 'MISSING_PAGE' WHEN totals > 1 THEN 'UNSTABLE_TOTAL' WHEN jumps > 0 THEN 'OFFSET_MISMATCH' WHEN total <> n THEN 'TOTAL_MISMATCH' END AS reason FROM g JOIN i USING (source_id)""")
def listing_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is each supplier's listing, of one page a line number, complete."""
    lines = table(spark, sf_dir, "lineitem")
    source = F.col("source_id")
    entries = lines.select(F.col("l_suppkey").alias("source_id"), F.lit("main").alias("surface"), F.col("l_linenumber").alias("ordinal"), F.col("l_orderkey").cast("string").alias("source_posting_id"))
    ids = entries.groupBy("source_id").agg(F.count_distinct("source_posting_id").alias("n"))
    pages = entries.groupBy("source_id", "surface", "ordinal").agg(F.count("*").alias("n_entries")).join(ids, "source_id")
    facts = pages.select("source_id", "surface", "ordinal", "n_entries", F.when(source % 4 == 1, 3).when(source % 4 == 2, F.col("n")).otherwise(0).alias("total"), F.when(source % 5 == 0, F.col("ordinal")).alias("offset"), F.when((source % 7 == 0) & (F.col("ordinal") == 2), "broken").alias("error"))
    return listings.completeness(entries, facts).select("source_id", "n", "reason")


@query("""SELECT doc_id, 'e' || lang AS employer, CASE WHEN n_chars % 2 = 0 THEN 'D' || n_chars ELSE 'raw' END AS text, CASE WHEN n_chars % 3 = 0 THEN 'https://r.ch/' || doc_id END AS redirect_target, CASE WHEN n_chars % 5 = 0 THEN 'q' || n_chars END AS requisition_id,
  trim(CASE WHEN n_chars % 2 = 0 THEN '80%  ' ELSE '' END || 'open') AS pensum, CASE WHEN doc_id % 2 = 0 THEN 'STILL_ACTIVE' ELSE 'ACTIVE_OBSERVED' END AS lifecycle_status, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS n_events, 17 AS n_columns FROM documents""")
def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence records of documents with made-up payloads and two events for every other one."""
    key, size = F.col("doc_id").cast("string"), F.col("n_chars")
    structured = F.to_json(F.struct(F.when(size % 2 == 0, F.array(F.concat(F.lit("D"), size.cast("string")))).alias("description"), F.concat(F.lit("e"), "lang").alias("hiring_organization"), F.when(size % 3 == 0, F.concat(F.lit("https://r.ch/"), key, F.lit("/"))).alias("redirect_target"), F.when(size % 5 == 0, F.struct(F.concat(F.lit("q"), size.cast("string")).alias("jobReqId"))).alias("inner"), F.when(size % 2 == 0, "80%").alias("pensum"), F.lit("open").alias("start_date")))
    then = at("2024-01-01 00:00:00")
    states = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("posting_id"), F.col("doc_id").alias("observation_id"), F.col("source").alias("source_id"), key.alias("source_posting_id"), then.alias("observed_at"), then.alias("first_seen_at"), F.lit("t").alias("title"), F.lit("u").alias("canonical_url"), structured.alias("structured_payload"), F.to_json(F.struct(F.lit("raw").alias("raw_text"))).alias("contract_payload"))
    told = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("posting_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("event_id"), F.lit(e).alias("event_type"), F.timestamp_add("DAY", F.lit(k), then).alias("observed_at")) for k, e in enumerate(["STILL_ACTIVE", "NEW", "CLOSED_OBSERVED"])))).alias("e")).select("posting_id", "e.*")
    told = told.withColumns({"observed_at": F.when(F.col("event_type") == "NEW", F.timestamp_add("DAY", F.lit(-1), then)).otherwise(F.col("observed_at")), "created_at": F.col("observed_at")})
    found = posting_evidence(states, told, at("2024-01-02 00:00:00"))
    return found.select(F.col("posting_id").alias("doc_id"), "employer", "text", "redirect_target", "requisition_id", F.col("pensum_contract_start").alias("pensum"), "lifecycle_status", F.size("lifecycle_events").alias("n_events"), F.lit(len(found.columns)).alias("n_columns"))


_CALENDAR = ("1996-02-20", "1996-06-10")
_EPISODES = """e AS (SELECT o_orderpriority AS canton, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS relationship, 1 + o_orderkey % 3 // 2 AS episode, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE + (o_orderkey % 200)::INT END AS z,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 7 END AS positions, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 60 END AS employer, o_custkey % 60 < 12 AS agency, o_orderkey % 5 = 0 AS direct, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END AS entry, o_orderkey % 13 = 0 AS apprentice FROM orders)"""


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes that close within 200 days or stay open."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    employer = F.col("o_custkey") % 60
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("canton"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("relationship"), F.expr("1 + o_orderkey % 3 DIV 2").alias("episode_number"), day.alias("opened_on"), F.when(key % 11 != 0, F.date_add(day, (key % 200).cast("int"))).alias("closed_on"),
        F.when(key % 4 == 0, key % 7).alias("positions_count"), F.when(F.col("o_custkey") % 9 != 0, employer).alias("employer"), (employer < 12).alias("is_agency"), (key % 5 == 0).alias("is_public_direct"), F.when(key % 3 > 0, key % 3 == 1).alias("is_entry_accessible"), (key % 13 == 0).alias("is_apprenticeship"),
    )


def _state_sql(level: str, canton: str, relationship: str) -> str:
    on = lambda flag: f"count(*) FILTER (a <= d AND coalesce(z > d, true) AND {flag})"
    share = lambda flag, of="true": f"round_even({on(flag)} / nullif({on(of)}, 0)::DOUBLE, 6)"
    return f"""SELECT '{level}' AS level, {canton} AS canton, {relationship} AS relationship, d AS state_date, {on('true')} AS active_unique_vacancies, coalesce(sum(positions) FILTER (a <= d AND coalesce(z > d, true)), 0)::BIGINT AS estimated_positions, {on('positions IS NOT NULL')} AS positions_known,
  count(*) FILTER (a = d AND episode = 1) AS new_vacancies, count(*) FILTER (a = d AND episode > 1) AS reappeared_vacancies, count(*) FILTER (z = d) AS disappeared_vacancies, median(d - a) FILTER (a <= d AND coalesce(z > d, true))::DOUBLE AS median_days_online,
  count(DISTINCT employer) FILTER (a <= d AND coalesce(z > d, true)) AS unique_employers, count(DISTINCT employer) FILTER (a <= d AND coalesce(z > d, true) AND agency) AS unique_agencies, {on('true')} AS active_postings,
  {share('direct')} AS public_direct_share, {share('agency')} AS agency_share, {share('apprentice')} AS apprenticeship_share, {share('episode > 1')} AS repost_rate, {share('entry', 'entry IS NOT NULL')} AS entry_accessible_share FROM e, days GROUP BY ALL"""


@query(f"""WITH {_EPISODES}, days AS (SELECT unnest(range(DATE '{_CALENDAR[0]}', DATE '{_CALENDAR[1]}' + 1, INTERVAL 1 DAY))::DATE AS d)
{_state_sql('', 'NULL', 'NULL')} UNION ALL {_state_sql('canton', 'canton', 'NULL')} UNION ALL {_state_sql('canton,relationship', 'canton', 'relationship')}""")
def daily_market_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market on each day, of all orders as episodes, in all, by canton, and by canton and relationship."""
    rows = materialize(_episodes(spark, sf_dir), "episodes")
    return market.daily_state(rows, [[], ["canton"], ["canton", "relationship"]], _CALENDAR, rows.select("canton", "relationship", "opened_on", "closed_on"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, o_orderdate - INTERVAL 40 DAY) DESC, o_orderkey)::INT AS place FROM orders")
def recency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders by when they were published, else first seen, the latest first."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("source_published_at"), F.timestamp_add("DAY", F.lit(-40), "o_orderdate").alias("first_seen_at"))
    by = Window.partitionBy("o_custkey").orderBy(F.desc("_recency"), "o_orderkey")
    return rows.withColumn("_recency", market.recency()).select("o_orderkey", F.row_number().over(by).alias("place"))


@query("""WITH r AS (SELECT o_orderkey, '{"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') || '","day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","open":' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END || ',"price":"' || o_totalprice::DECIMAL(12, 2) || '","tags":["' || o_orderpriority || '","a\\\\b\\"\\u00e4"],"who":{"key":' || o_custkey
  || ',"segment":' || CASE WHEN o_custkey % 3 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}}' AS t FROM orders) SELECT o_orderkey, length(t) AS n, sha256(t) AS digest FROM r""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of orders with nested values, and its digest."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("at"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") == "O").alias("open"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        F.array(F.col("o_orderpriority"), F.lit('a\\b"ä')).alias("tags"), F.struct(F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")).alias("segment"), F.col("o_custkey").alias("key")).alias("who"),
    )
    text = canonical.canonical_row(rows.schema, ["at", "day", "open", "price", "tags", "who"])
    return rows.select("o_orderkey", text.alias("t")).select("o_orderkey", F.length("t").cast("long").alias("n"), canonical.digest(F.col("t")).alias("digest"))


_FILTERS = {"status": "ACTIVE", "canton": "gr", "municipality": "CHUR", "mapping": "MAPPABLE", "segment": "UNKNOWN", "precision": "MUNICIPALITY", "source": "s1", "published_from": "1993-01-01", "first_seen_to": "2000-12-31", "q": " town & "}


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = materialize(_records(spark, sf_dir), "records")
    observed = records.select(F.col("canonical_observation").alias("observation_id"), F.concat(F.lit("s"), (F.col("canonical_observation") % 3).cast("string")).alias("source_id"))
    return snapshot.with_source(records, observed)


@query(f"""WITH {_RECORDS}, f AS (SELECT k, seen, k % 3 AS s FROM b WHERE vis = 'PUBLIC_GREEN_CONFIRMED' AND st <> 'F' AND k % 5 NOT IN (0, 3) AND map = 'MAPPABLE' AND k % 3 = 1 AND k % 2 = 0 AND seen >= DATE '1993-01-01' AND seen < TIMESTAMP '2000-12-31 23:00:00')
SELECT k AS vacancy_key, (SELECT count(*) FROM f) AS total, greatest(1, ceil((SELECT count(*) FROM f) / 10.0))::INT AS pages FROM f ORDER BY seen DESC, k LIMIT 10""")
def record_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the public records that pass all kinds of filters, with their number."""
    found, total, pages = snapshot.record_page(_sourced(spark, sf_dir), _FILTERS, 1, 10)
    return found.select("vacancy_key", F.lit(total).cast("long").alias("total"), F.lit(pages).alias("pages"))


@query(f"""WITH {_RECORDS}, m AS (SELECT k, st FROM b WHERE vis = 'PUBLIC_GREEN_CONFIRMED' AND map = 'MAPPABLE' ORDER BY seen DESC, k LIMIT 300)
SELECT k AS vacancy_key, '{{"type":"Feature","id":' || k || ',"geometry":{{"type":"Point","coordinates":[8.0,47.0]}},"properties":{{"vacancy_key":' || k || ',"title":"Job ' || k || '","employer":"Town & Co","status":"' || CASE WHEN st = 'F' THEN 'CLOSED_OBSERVED' ELSE 'ACTIVE' END || '"}}}}' AS feature,
  (SELECT count(*) FROM b WHERE vis = 'PUBLIC_GREEN_CONFIRMED' AND map = 'MAPPABLE') > 300 AS truncated FROM m""")
def record_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the latest public records, and whether some were left out."""
    found, truncated = snapshot.geojson(snapshot.public_records(_records(spark, sf_dir)), 300)
    return found.withColumn("truncated", F.lit(truncated))


_CYCLE_AT = "2026-01-01 00:00:00"


def _cycle(spark: SparkSession, sf_dir: str) -> tuple[cycle.Stages, cycle.Published]:
    """Documents as postings of five sources, through all stages of a cycle. Merges can join two postings whose own pair is
    left for review: it stays a review, as the SQL has it."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))
    size, key, whole, head = F.col("n_chars"), F.col("doc_id"), F.col("text"), F.substring_index("text", "\n", 1)
    digest = lambda c: F.when(F.length(plain(c)) >= 20, F.sha2(plain(c).cast("binary"), 256)).otherwise("")
    seen = F.date_add(F.lit("2024-01-01").cast("date"), (size % 400).cast("int")).cast("timestamp")
    empty, code = F.lit(""), F.concat(F.lit("s"), (size % 5).cast("string"))
    docs = table(spark, sf_dir, "documents")
    observations = docs.select(
        key.alias("posting_id"), key.alias("observation_id"), code.alias("source_id"), key.cast("string").alias("source_posting_id"), seen.alias("observed_at"), seen.alias("first_seen_at"), F.lit("ACTIVE").alias("observation_status"), plain(head).alias("title"), plain(whole).alias("text"), F.col("source").alias("employer"), F.col("lang").alias("location"),
        F.when(size % 3 == 0, "").when(size % 3 == 1, "80").otherwise("100").alias("terms"), F.when(size % 2 == 0, F.sha2(whole.cast("binary"), 256)).otherwise("").alias("requisition"), digest(whole).alias("url"), F.when(size % 5 == 0, digest(head)).otherwise("").alias("redirect"),
        F.when(size % 3 == 0, "regional").when(size % 3 == 1, "specialist").otherwise("canton").alias("source_type"), empty.alias("platform_family"), F.lit("S").alias("source_name"), F.lit("CANONICAL").alias("canonicality"), F.lit("<p>x</p>").alias("description_html"), F.concat(F.lit("https://x.ch/"), key.cast("string")).alias("canonical_url"), F.lit(None).cast("date").alias("date_posted"),
        F.lit("zh").alias("region"), F.lit("Bern").alias("municipality_name"), F.lit("BE").alias("municipality_canton"), F.lit("{}").alias("structured_payload"), F.lit("{}").alias("contract_payload"),
    )
    told = F.when(size % 7 == 0, F.timestamp_add("DAY", F.lit(10), seen)).otherwise(seen)
    events = docs.select(key.alias("posting_id"), key.alias("event_id"), F.when(size % 7 == 0, "CLOSED_OBSERVED").otherwise("STILL_ACTIVE").alias("event_type"), told.alias("observed_at"), told.alias("created_at"))
    contexts = F.explode(F.array(F.lit(places.PUBLIC), F.lit("PRIVATE_RESIDENCE"))).alias("privacy_context")
    located = docs.where(key % 5 != 0).select(key.alias("location_resolution_id"), key.alias("observation_id"), contexts, F.when(key % 5 == 1, "REVIEW").otherwise("RESOLVED").alias("resolution_status"), F.lit("MUNICIPALITY").alias("precision"), F.lit(47.0).alias("public_latitude"), F.lit(8.0).alias("public_longitude"), F.lit("Chur").alias("resolved_municipality"), F.lit("gr").alias("resolved_canton"))
    located = located.withColumn("display_level", F.when(F.col("privacy_context") == places.PUBLIC, "EXACT_ALLOWED").otherwise("HIDDEN"))
    sources = observations.select("source_id").distinct()
    name = F.col("source_id")
    universe = sources.select("source_id", F.when(name == "s0", "OFFICIAL_FEDERAL").otherwise("OFFICIAL_MUNICIPAL").alias("source_family"), (name == "s4").alias("blocked"), F.when(name == "s4", "ACCEPTED_BLOCKED").otherwise("ACCEPTED_IMPLEMENTED").alias("disposition"), F.lit(True).alias("canonical"))
    ended = F.timestamp_add("HOUR", F.when(name == "s3", -200).otherwise(-1), at(_CYCLE_AT))
    runs = sources.select("source_id", F.concat(F.lit("r"), name).alias("run_id"), F.lit("FULL_SOURCE").alias("run_scope"), F.lit("SUCCEEDED").alias("status"), F.lit("HEALTHY").alias("source_health_status"), F.lit(True).alias("snapshot_complete"), *(F.lit(5).alias(c) for c in readiness.COUNTERS), ended.alias("started_at"), ended.alias("finished_at"))
    terms = [rules.Term("G1", "the", "TITLE_OR_TEXT"), rules.Term("X1", "que la", "EXCLUSION"), rules.Term("O1", "src1", "ORGANIZATION_SIGNAL")]
    stages = cycle.run(observations, events, terms, at(_CYCLE_AT))
    signals = [rules.Signal(s, p, "JOB") for s, p in (("P001", "of the"), ("P004", "in der"), ("P008", "on the"))]
    return stages, cycle.publish(stages, events, signals, located, universe, runs, at(_CYCLE_AT), cycle.Policy(conflicts_stop=False))


_CYCLE = f"""{_CLUSTERS}, posts AS (SELECT id, n_chars % 5 AS source, CASE n_chars % 3 WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 1 END AS rank, seen, n_chars % 7 = 0 AS ended, c.cluster,
  CASE WHEN contains(plain, 'the') AND contains(plain, 'que la') THEN 'REVIEW' WHEN contains(plain, 'the') THEN 'GREEN_CONFIRMED' WHEN contains(plain, 'que la') THEN 'NOT_GREEN' WHEN contains(l.source, 'src1') THEN 'REVIEW' ELSE 'NOT_GREEN' END AS result, ' ' || plain || ' ' AS words FROM l JOIN p ON p.id = l.doc_id JOIN c USING (id)),
g AS (SELECT *, CASE WHEN result <> 'GREEN_CONFIRMED' THEN 'UNKNOWN' WHEN contains(words, ' of the ') THEN 'PRIVATE_RESIDENTIAL_PREMIUM' WHEN contains(words, ' in der ') THEN 'UNKNOWN' WHEN contains(words, ' on the ') THEN 'PRIVATE_RESIDENTIAL_STANDARD' ELSE 'UNKNOWN' END AS segment,
  result = 'GREEN_CONFIRMED' AND NOT contains(words, ' of the ') AND contains(words, ' in der ') AS asked FROM posts),
o AS (SELECT cluster, 1 + count(*) FILTER (NOT ended AND before) AS episode FROM (SELECT *, lag(ended) OVER (PARTITION BY cluster ORDER BY seen + CASE WHEN ended THEN 10 ELSE 0 END, id) AS before FROM g) GROUP BY cluster),
shown AS (SELECT g.*, episode, NOT ended AS open, CASE WHEN result = 'GREEN_CONFIRMED' THEN 'PUBLIC_GREEN_CONFIRMED' WHEN result = 'NOT_GREEN' THEN 'EXCLUDED_NOT_GREEN' ELSE 'REVIEW_NOT_PUBLIC' END AS visibility,
  CASE WHEN result <> 'GREEN_CONFIRMED' THEN 'LOCATION_UNRESOLVED' WHEN id % 5 = 0 AND segment <> 'UNKNOWN' THEN 'PRIVACY_RESOLUTION_MISSING' WHEN id % 5 = 0 THEN 'LOCATION_UNRESOLVED' WHEN id % 5 = 1 THEN 'LOCATION_REVIEW' WHEN segment <> 'UNKNOWN' THEN 'LOCATION_HIDDEN' ELSE 'MAPPABLE' END AS mapping
  FROM g JOIN o USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY rank, seen, id) = 1)"""


@query(f"{_CYCLE} SELECT id AS canonical_posting, CASE WHEN open THEN 'ACTIVE' ELSE 'CLOSED_OBSERVED' END AS vacancy_status, visibility AS visibility_status, mapping AS mapping_status, segment AS premium_segment, episode::INT AS episode_number, 43 AS n_columns FROM shown")
def cycle_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a whole cycle publishes of all documents."""
    records = _cycle(spark, sf_dir)[1].records
    return records.select("canonical_posting", "vacancy_status", "visibility_status", "mapping_status", "premium_segment", "episode_number", F.lit(len(records.columns)).alias("n_columns"))


@query(f"""{_CYCLE}, mine AS (SELECT g.*, v.open, v.id = g.id AS canonical, v.mapping, g.source < 3 AS ours FROM g JOIN shown v USING (cluster)),
asks AS (SELECT count(*) FILTER (coalesce(a.open AND a.ours AND a.result IN ('GREEN_CONFIRMED', 'REVIEW'), false) OR coalesce(b.open AND b.ours AND b.result IN ('GREEN_CONFIRMED', 'REVIEW'), false)) AS dedup, count(*) AS reviews FROM pairs JOIN mine a ON a.id = pairs.a JOIN mine b ON b.id = pairs.b WHERE outcome = 'REVIEW'),
rest AS (SELECT count(*) FILTER (result = 'REVIEW' AND ours AND canonical AND open) AS green, count(*) FILTER (result = 'REVIEW') AS all_green, count(*) FILTER (asked AND ours AND canonical AND open) AS premium, count(*) FILTER (canonical AND open AND mapping = 'LOCATION_REVIEW' AND ours) AS location FROM mine)
SELECT green AS critical_green, dedup AS critical_dedup, premium AS critical_premium, location AS critical_location, all_green - green + reviews - dedup AS n_other, CASE WHEN green + dedup + premium + location > 0 THEN 'BLOCKED_QUALITY' ELSE 'NOT_READY' END AS status FROM rest, asks""")
def cycle_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is open for review after a whole cycle, by kind, and the status that follows."""
    out = _cycle(spark, sf_dir)[1]
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n_critical"))), F.lit(0)).cast("long").alias(f"critical_{kind}")
    return out.reviews.agg(of("green"), of("dedup"), of("premium"), of("location"), F.coalesce(F.sum("n_other"), F.lit(0)).cast("long").alias("n_other")).withColumn("status", F.lit(out.status))


@query("""SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, upper(p_name), p_size + 2 FROM part WHERE p_partkey % 3 = 0""")
def dimension_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a dimension, new rows of which every key has two put into it, and the newest version read."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    sink = Dimension(spark, f"{shared_folder(spark).rstrip('/')}/part-{uuid.uuid4().hex}", ["p_partkey"], 16)
    sink.upsert(part, [F.desc("p_size")], part.count())
    fresh = part.where("p_partkey % 3 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.explode(F.array(F.col("p_size") + 1, F.col("p_size") + 2)).alias("p_size"))
    sink.upsert(fresh, [F.desc("p_size")], part.count())
    return sink.read()


#: What a document of ``document_contracts`` must be like.
_CONTRACT = {"type": "object", "required": ["id", "lines"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^o[0-9]*[02468]$"}, "status": {"enum": ["F", "O"]}, "day": {"type": ["string", "null"], "format": "date"}, "price": {"type": ["number", "null"], "maximum": 300000}, "lines": {"type": "array", "maxItems": 2, "items": {"type": "integer", "minimum": 10}}}}


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice > 300000 AS dear FROM orders), e AS (
  SELECT k, unnest(list_filter([CASE WHEN k % 2 = 1 THEN '/id pattern' END, CASE WHEN st = 'P' THEN '/status enum' END, CASE WHEN k % 7 = 0 THEN '/day format' WHEN k % 7 = 1 THEN '/day type' END, CASE WHEN dear THEN '/price maximum' END, CASE WHEN k % 5 = 0 THEN '/lines required' END, CASE WHEN k % 5 = 1 THEN '/more additionalProperties' END,
    CASE WHEN k % 5 = 2 THEN '/lines maxItems' END, CASE WHEN k % 5 = 2 AND k % 13 < 10 THEN '/lines/2 minimum' END, CASE WHEN k % 11 = 3 THEN NULL END], lambda x: x IS NOT NULL)) AS x FROM o WHERE k % 11 <> 3 UNION ALL SELECT k, ' json' FROM o WHERE k % 11 = 3)
SELECT k AS o_orderkey, coalesce(string_agg(x, ',' ORDER BY x), '') AS errors FROM o LEFT JOIN e USING (k) GROUP BY k""")
def document_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON documents, some of them broken, against a schema."""
    key = F.col("o_orderkey")
    day = F.when(key % 7 == 0, F.lit("1996-02-30")).when(key % 7 != 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
    body = F.concat(
        F.lit('{"id":"o'), key.cast("string"), F.lit('","status":"'), F.col("o_orderstatus"), F.lit('","day":'), F.when(key % 7 == 1, F.lit("17")).otherwise(F.coalesce(F.concat(F.lit('"'), day, F.lit('"')), F.lit("null"))), F.lit(',"price":'), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.when(key % 5 == 0, "").when(key % 5 == 1, ',"lines":[],"more":1').when(key % 5 == 2, F.concat(F.lit(',"lines":[10,20,'), (key % 13).cast("string"), F.lit("]"))).otherwise(',"lines":[10]'), F.when(key % 11 == 3, "").otherwise("}"),
    )
    found = validated(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("doc")), "doc", _CONTRACT)
    return found.select("o_orderkey", F.array_join(F.array_sort(F.transform("errors", lambda e: F.concat(e["path"], F.lit(" "), e["keyword"]))), ",").alias("errors"))


_LINKS = """links AS (SELECT 'orders' AS t, o_orderkey AS k, 'customer' AS x, o_custkey AS y FROM orders UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey FROM customer UNION ALL SELECT 'customer', c_custkey, 'customer', c_custkey // 2 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'nation', n_nationkey, 'region', n_regionkey FROM nation)"""


@query(f"""WITH RECURSIVE {_LINKS}, reach AS (SELECT 'orders' AS t, o_orderkey AS k FROM orders WHERE o_totalprice > 400000 UNION SELECT x, y FROM reach JOIN links USING (t, k))
SELECT t AS "table", k::VARCHAR AS key FROM reach""")
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the dearest orders lead to, by typed references."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    kin = customer.withColumn("_kin", F.when(F.col("c_custkey") % 3 == 0, F.expr("c_custkey DIV 2")))
    edges = lineage.references({"orders": (orders, "o_orderkey"), "customer": (kin, "c_custkey"), "nation": (nation, "n_nationkey")}, {"orders": {"o_custkey": "customer"}, "customer": {"c_nationkey": "nation", "_kin": "customer"}, "nation": {"n_regionkey": "region"}})
    return lineage.closure(edges, orders.where("o_totalprice > 400000").select(F.lit("orders").alias("table"), F.col("o_orderkey").cast("string").alias("key"))).select("table", "key")


@query("""SELECT 'customer' AS "table", c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 211 = 5 THEN 'LEFT_ONLY' ELSE 'CONFLICTING' END AS state FROM customer WHERE c_custkey % 211 = 5 OR c_custkey % 307 = 7""")
def package_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a package that was tampered with differs from the rows it was made of, by digest trees."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    made = governance.inventory({"customer": (customer, "c_custkey"), "nation": (nation, "n_nationkey")})
    changed = customer.where("c_custkey % 211 <> 5").withColumn("c_name", F.when(F.col("c_custkey") % 307 == 7, "x").otherwise(F.col("c_name")))
    given = governance.inventory({"customer": (changed, "c_custkey"), "nation": (nation, "n_nationkey")})
    return lineage.differences(lineage.digest_tree(made), lineage.digest_tree(given), made, given).select("table", "key", "state")


@query("""SELECT o_orderkey, CASE WHEN b THEN NULL ELSE d END AS iso, CASE WHEN b THEN NULL ELSE d || ' 10:30:00.250000' END AS naive, CASE WHEN b THEN NULL ELSE d || 'T08:30:00.000000Z' END AS zoned, CASE WHEN b THEN NULL ELSE d END AS dotted, CASE WHEN b THEN NULL ELSE d END AS german, CASE WHEN b THEN NULL ELSE d || 'T00:00:00.500000Z' END AS unix,
  array_to_string(list_distinct(['F', o_orderstatus]), '') = 'F' AS one_listed FROM (SELECT *, o_orderkey % 10 = 3 AS b, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""")
def date_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and moments read back from the forms in which sources write them; a tenth is unreadable."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    spoilt = lambda text: F.when(key % 10 == 3, F.concat(F.lit("x"), text)).otherwise(text)
    iso = F.date_format(day, "yyyy-MM-dd")
    month = F.element_at(F.array(*(F.lit(m.capitalize()) for m in V.GERMAN_MONTHS)), F.month(day))
    told = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        told(V.iso_date(spoilt(F.concat(iso, F.lit("T99"))))).alias("iso"),
        F.date_format(V.iso_timestamp(spoilt(F.concat(F.lit(" "), iso, F.lit("T10:30:00.25 ")))), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("naive"),
        V.utc_micros(V.aware_timestamp(spoilt(F.concat(iso, F.lit("T10:30:00+02:00"))))).alias("zoned"),
        told(V.dotted_date(spoilt(F.date_format(day, "d.M.yyyy")))).alias("dotted"),
        told(V.german_date(F.when(key % 10 == 3, "3. Brumaire 1996").otherwise(F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), month, F.lit(" "), F.year(day).cast("string"))))).alias("german"),
        V.utc_micros(V.unix_timestamp(spoilt(F.concat(F.unix_seconds(day.cast("timestamp")).cast("string"), F.lit(".5"))))).alias("unix"),
        (evidence.joined_observed(F.array(F.lit("F"), F.lit(""), F.col("o_orderstatus"), F.lit("F"))) == "F").alias("one_listed"),
    )


@query("""WITH o AS (SELECT o_custkey % 5 AS s, o_custkey % 5 * 100 + month(o_orderdate) AS run, month(o_orderdate) AS m, o_custkey % 50 AS posting FROM orders WHERE o_orderkey % 3 = 0), scans AS (SELECT DISTINCT s, run, m FROM o WHERE m <> 3), seen AS (SELECT DISTINCT s, posting, run, m FROM o WHERE m <> 3),
known AS (SELECT s, posting, min(m) AS since FROM seen GROUP BY ALL), due AS (SELECT s, posting, run FROM scans JOIN known USING (s) WHERE m >= since AND m % 4 <> 1 AND m <> 6)
SELECT s AS source_id, posting AS source_posting_id, run AS run_id, bool_or(p) AS present FROM (SELECT s, posting, run, false AS p FROM due UNION ALL SELECT s, posting, run, true FROM seen) GROUP BY ALL""")
def scan_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that each finished scan showed, or, if it saw its whole source in health, lacked."""
    month = F.month("o_orderdate")
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 5).alias("source_id"), (F.col("o_custkey") % 5 * 100 + month).alias("run_id"), month.alias("m"), (F.col("o_custkey") % 50).alias("source_posting_id"))
    scans = orders.select("source_id", "run_id", "m").distinct().select("source_id", "run_id", F.when(F.col("m") == 3, "FAILED").otherwise("SUCCESS").alias("status"), F.when(F.col("m") % 4 == 1, "PARTIAL").otherwise("FULL_SOURCE").alias("run_scope"), F.when(F.col("m") == 6, "DEGRADED").otherwise("HEALTHY").alias("source_health_status"), F.make_timestamp(F.lit(2024), F.col("m"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("observed_at"))
    return lifecycle.presence(scans, orders.drop("m")).select("source_id", "source_posting_id", "run_id", "present")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS id, l_linenumber AS surface FROM lineitem), u AS (SELECT s, id, min(surface) AS surface FROM e GROUP BY ALL)
SELECT s AS source_id, id::VARCHAR AS source_posting_id, surface::VARCHAR AS surface FROM u WHERE (s, id) NOT IN (SELECT s, id FROM e WHERE surface = 3)""")
def surface_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each supplier over all its surfaces (line numbers), each once, less those that the third surface shows."""
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").cast("string").alias("surface"), F.lit(1).alias("ordinal"), F.col("l_orderkey").cast("string").alias("source_posting_id"), F.concat(F.lit("https://x.ch/"), F.col("l_orderkey").cast("string")).alias("url"), F.lit("t").alias("title"))
    whole = materialize(listings.union_surfaces(entries), "entries")
    third = entries.where("surface = '3'").select("source_id", "source_posting_id").distinct()
    return listings.subtract_surface(whole, third).select("source_id", "source_posting_id", "surface")
