"""Locations, sources, manifests and the cycle."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions import values as V
from chronolith.functions.text import repaired_json, visible_for_display, visible_for_matching
from chronolith.operators import expectations, places, readiness, snapshot
from chronolith.plans import cycle
from chronolith.plans.manifest import Manifests, fingerprint
from chronolith.operators.rules import Term
from chronolith.sources import listings, tables

PLACE = "observation_id int, street string, locality string, region string, postal_code string, country string, municipality_bfs int, municipality_name string, municipality_canton string, privacy_context string, location_text string"
PUBLIC = places.PUBLIC


def feature(town, canton="ZH", lon=8.5, lat=47.3, origin="zipcode", postcode=""):
    return {"geometry": {"coordinates": [lon, lat]}, "properties": {"attrs": {"municipality": town, "canton": canton, "country": "CH", "postcode": postcode, "origin": origin, "label": town}}}


def test_resolution_table(spark):
    rows = [
        (1, "", "Zürich", "ZH", "8000", "CH", 261, "Zürich", "ZH", PUBLIC, ""),
        (2, "", "Zürich", "ZH", "8000", "DE", 261, "Zürich", "ZH", PUBLIC, ""),
        (3, "", "", "", "", "", None, "", "", PUBLIC, ""),
        (4, "Weg 1", "Zürich", "ZH", "", "CH", 261, "Zürich", "ZH", PUBLIC, ""),
        (5, "", "Zürich", "ZH", "", "CH", 261, "Zürich", "ZH", PUBLIC, "Diverse Standorte"),
        (6, "", "Wil", "SG", "", "CH", None, "", "", PUBLIC, ""),
        (7, "Weg 1", "Zürich", "ZH", "8000", "CH", 261, "Zürich", "ZH", "PRIVATE_RESIDENCE", ""),
        (8, "", "Bern", "BE", "", "CH", 351, "Bern", "BE", PUBLIC, ""),
        (9, "", "Nirgends", "", "", "CH", None, "", "", PUBLIC, ""),
    ]
    points = F.array().cast("array<struct<latitude:double,longitude:double>>")
    seen = spark.createDataFrame(rows, PLACE).withColumn("source_points", points)
    asked = {r.observation_id: r.request_fingerprint for r in places.requests(seen).collect()}
    answers = {1: [feature("Zürich")], 4: [feature("Zürich", origin="address")], 5: [feature("Zürich")], 6: [feature("Wil", "SG"), feature("Wil", "SG", 9.0)], 7: [feature("Zürich")], 8: [feature("Zürich")], 9: []}
    cache = spark.createDataFrame([(f, json.dumps({"features": answers[k]})) for k, f in asked.items() if k in answers], "request_fingerprint string, response string").dropDuplicates(["request_fingerprint"])
    towns = spark.createDataFrame([(261, "Zürich", "ZH"), (351, "Bern", "BE")], "bfs int, name string, canton string")
    got = {r.observation_id: r for r in places.resolve(seen, places.candidates(cache), towns).collect()}
    told = {k: (r.resolution_status, r.precision, r.review_reason) for k, r in got.items()}
    assert told == {
        1: ("RESOLVED", "POSTCODE", None),
        2: ("REVIEW", "UNKNOWN", "UNEXPECTED_COUNTRY"),
        3: ("UNRESOLVED", "UNKNOWN", None),
        4: ("RESOLVED", "EXACT_WORK_ADDRESS", None),
        5: ("RESOLVED", "REMOTE_OR_MULTIPLE", None),
        6: ("REVIEW", "UNKNOWN", "MULTIPLE_PLAUSIBLE_RESULTS"),
        7: ("RESOLVED", "MUNICIPALITY", None),
        8: ("REVIEW", "UNKNOWN", "GEOCODER_CONTRADICTS_BFS"),
        9: ("UNRESOLVED", "UNKNOWN", None),
    }
    assert got[7].latitude == 47.3 and got[7].public_latitude is None and got[1].public_longitude == 8.5


def test_dates(spark):
    row = spark.range(1).select(V.german_date(F.lit("ab 7. August 2026")).alias("a"), V.german_date(F.lit("7. Foo 2026")).alias("b"), V.dotted_date(F.lit("7.8.2026")).alias("c"), V.iso_date(F.lit("2026-08-07T10:00")).alias("d"), V.iso_date(F.lit("soon")).alias("e"), V.optional_int(F.lit("UNKNOWN")).alias("f"), V.decimal_range(F.lit("10-20.5")).alias("g")).first()
    assert [str(x) for x in row[:6]] == ["2026-08-07", "None", "2026-08-07", "2026-08-07", "None", "None"] and (float(row.g.low), float(row.g.high)) == (10, 20.5)


def test_html(spark):
    html = "<p>A<script>x</script>b</p> see https://x.ch/y <svg>z</svg>​"
    row = spark.createDataFrame([(html,)], "h string").select(visible_for_matching("h").alias("m"), visible_for_display("h").alias("d")).first()
    assert "https" not in row.m and "z" in row.m and row.d == "A b see https://x.ch/y"


def test_broken_json_is_repaired(spark):
    broken = '{"description": "a "quoted" word", "x": 1}'
    got = spark.createDataFrame([(broken,), ('{"a": 1}',)], "j string").select(repaired_json("j").alias("j")).collect()
    assert json.loads(got[0].j) == {"description": 'a "quoted" word', "x": 1} and got[1].j == '{"a": 1}'


def test_fingerprint_ignores_order(spark):
    rows = spark.range(100).select("id", F.col("id").cast("string").alias("s"))
    a, b = V.dataset_fingerprint(rows.repartition(7)), V.dataset_fingerprint(rows.orderBy(F.desc("id")))
    assert a == b != V.dataset_fingerprint(rows.where("id > 0")) and a != V.dataset_fingerprint(rows.union(rows.limit(1)))


def test_strict_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("﻿id,name\na, x \nb,\n", encoding="utf-8")
    assert [tuple(r) for r in tables.strict_csv(spark, str(path), ["id", "name"], 2, "id").orderBy("id").collect()] == [("a", "x"), ("b", "")]
    for headers, count, text in ((["id"], 2, None), (["id", "name"], 3, None), (["id", "name"], None, "id,name\na,1\na,2\n")):
        if text:
            path.write_text(text)
        with pytest.raises(expectations.ExpectationError):
            tables.strict_csv(spark, str(path), headers, count, "id")


def test_documents(spark):
    schema = T.StructType.fromDDL("a string, b int")
    rows = spark.createDataFrame([('{"a": "x", "b": 5}',), ('{"b": -1}',), ('{"a": "x", "c": 1}',), ("no",)], "j string")
    got = tables.validated_documents(rows, "j", schema, ["a"], {"b": F.col("document.b") > 0}).collect()
    assert [r.errors for r in got] == [[], ["missing a", "invalid b"], ["unknown c"], ["not an object", "missing a"]]


def test_write_once(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "d1")], "key string, digest string")
    tables.write_once(rows, str(tmp_path / "raw"), "key", "digest")
    assert tables.write_once(rows, str(tmp_path / "raw"), "key", "digest").count() == 0
    with pytest.raises(expectations.ExpectationError):
        tables.write_once(spark.createDataFrame([("k1", "d2")], rows.schema), str(tmp_path / "raw"), "key", "digest")


def test_listings(spark):
    platform = listings.Platform("jobs", "id", "link", "name.de", "total", "offset")
    page = lambda ids, total, offset: json.dumps({"jobs": [{"id": i, "link": f"/j/{i}", "name": {"de": f"T{i}"}} for i in ids], "total": total, "offset": offset})
    bodies = [("ok", 0, page([1, 2], 3, 0)), ("ok", 1, page([3], 3, 2)), ("short", 0, page([1], 3, 0)), ("jump", 0, page([1], 2, 0)), ("jump", 1, page([2], 2, 5)), ("broken", 0, "<html>"), ("empty", 0, page([], 0, 0)), ("links", 0, '<a href="/x">A <b>b</b></a>')]
    pages = spark.createDataFrame([(s, "main", n, f"https://{s}.ch/l", b) for s, n, b in bodies], "source_id string, surface string, ordinal int, url string, body string")
    entries, facts = listings.parse_listings(pages, {s: None if s == "links" else platform for s, _, _ in bodies})
    got = {r.source_id: (r.n, r.reason) for r in listings.completeness(entries, facts).collect()}
    assert got == {"ok": (3, None), "short": (1, "TOTAL_MISMATCH"), "jump": (2, "OFFSET_MISMATCH"), "broken": (0, "UNREADABLE_PAGE"), "empty": (0, None), "links": (1, None)}
    assert entries.where("source_id = 'links'").first().title == "A b"
    every = entries.where("source_id = 'ok'")
    assert listings.subtract_surface(every, every.where("source_posting_id = '2'")).count() == 2
    with pytest.raises(expectations.ExpectationError):
        listings.union_surfaces(every.union(every.withColumn("url", F.lit("other"))))


def test_details(spark):
    body = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Gärtner", "hiringOrganization": {"name": "Stadt"}, "jobLocation": [{"address": {"addressLocality": "Bern"}}]}]}</script>'
    got = listings.parse_details(spark.createDataFrame([("s", "u", body), ("s", "v", "<p>"), ("s", "w", None)], "source_id string, url string, body string")).collect()
    assert (got[0].title, got[0].employer, got[0].locality, got[0].error) == ("Gärtner", "Stadt", "Bern", None)
    assert got[1].error == got[2].error == "NO_JOB_POSTING"


def test_manifest_replays(spark, tmp_path):
    runs = Manifests(spark, str(tmp_path))
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    digest = fingerprint({"b": 1, "a": 2}, spark.range(3))
    first, replayed = runs.run("x", "v1", "2024-01-01 00:00:00", digest, make)
    again, replayed_again = runs.run("x", "v1", "2024-01-01 00:00:00", digest, make)
    assert (first.count(), replayed, again.count(), replayed_again, len(made)) == (3, False, 3, True, 1)
    runs.run("x", "v1", "2023-01-01 00:00:00", "other", lambda: spark.range(1))
    assert runs.latest("x").first().fingerprint == digest


def test_cycle(spark):
    cols = "posting_id string, observation_id string, observed_at string, observation_status string, title string, employer string, location string, terms string, text string, url string, redirect string, requisition string, source_type string, platform_family string, source_name string"
    base = ("Stadt Zürich", "Zürich", "", "Rasenpflege Sportanlage")
    rows = [
        ("a", "1", "2024-01-01", "ACTIVE", "Greenkeeper", *base, "https://x.ch/1?utm_a=1", None, None, "direct", "", ""),
        ("b", "2", "2024-01-02", "ACTIVE", "Greenkeeper", *base, "https://x.ch/1", None, None, "aggregator", "", ""),
        ("c", "3", "2024-01-02", "ACTIVE", "Florist", *base, "https://x.ch/3", None, None, "direct", "", ""),
        ("a", "9", "2024-03-01", "ACTIVE", "Later", *base, "https://x.ch/9", None, None, "direct", "", ""),
    ]
    seen = spark.createDataFrame(rows, cols).withColumn("observed_at", F.to_timestamp("observed_at")).withColumn("first_seen_at", F.col("observed_at"))
    events = spark.createDataFrame([], "posting_id string, event_id string, event_type string, observed_at timestamp, created_at timestamp")
    out = cycle.run(seen, events, [Term("T", "Greenkeeper", "TITLE")], F.lit("2024-02-01").cast("timestamp"))
    assert {r.posting_id: r.result for r in out.relevance.collect()} == {"a": "GREEN_CONFIRMED", "b": "GREEN_CONFIRMED", "c": "NOT_GREEN"}
    assert {r.canonical_posting: r.n_postings for r in out.vacancies.collect()} == {"a": 2, "c": 1} and out.conflicts.isEmpty()


def test_health(spark):
    rows = [("x", "s", 1, "FAILED"), ("x", "s", 2, "SUCCEEDED"), ("y", "s", 1, "FAILED"), ("z", "s", 1, "SUCCEEDED"), ("z", "t", 1, "FAILED")]
    frame = spark.createDataFrame(rows, "cycle_id string, source_id string, attempt_number int, status string")
    assert {r.cycle_id: r.health for r in cycle.health(frame).collect()} == {"x": "GREEN", "y": "RED", "z": "AMBER"}


def test_source_evidence(spark):
    universe = spark.createDataFrame([("s1", "OFFICIAL_FEDERAL", False), ("s2", "OFFICIAL_MUNICIPAL", False), ("s3", "X", True), ("s4", "X", False)], "source_id string, source_family string, blocked boolean")
    run = lambda i, s, end, health="HEALTHY", status="SUCCEEDED", n=5: (i, s, "FULL_SOURCE", status, health, True, 5, 5, 5, 5, 5, n, end, end)
    rows = [run("1", "s1", "2024-01-05"), run("2", "s2", "2024-01-01"), run("3", "s2", "2024-01-06", "DEGRADED"), run("4", "s3", "2024-01-06"), run("5", "s4", "2024-01-06", n=4)]
    runs = spark.createDataFrame(rows, "run_id string, source_id string, run_scope string, status string, source_health_status string, snapshot_complete boolean, " + ", ".join(f"{c} int" for c in readiness.COUNTERS) + ", started_at string, finished_at string")
    runs = runs.withColumns({c: F.to_timestamp(c) for c in ("started_at", "finished_at")})
    got = {r.source_id: (r.completion_status, r.freshness_state, r.stratum, r.counts_toward_coverage) for r in readiness.source_evidence(universe, runs, F.lit("2024-01-07").cast("timestamp")).collect()}
    assert got == {"s1": ("COMPLETE_HEALTHY", "FRESH", "FEDERAL", True), "s2": ("DEGRADED", "STALE", "CITY", False), "s3": ("NO_ELIGIBLE_RUN", "BLOCKED", "OTHER", False), "s4": ("NO_ELIGIBLE_RUN", "NO_ACCEPTED_RUN", "OTHER", False)}


def test_write_once_refuses_two_contents_of_a_key(spark, tmp_path):
    path, ddl = str(tmp_path / "raw"), "key string, digest string"
    with pytest.raises(expectations.ExpectationError):
        tables.write_once(spark.createDataFrame([("k", "a"), ("k", "b")], ddl), path, "key", "digest")
    assert tables.write_once(spark.createDataFrame([("k", "a"), ("k", "a"), ("l", "b")], ddl), path, "key", "digest").count() == 2
    with pytest.raises(expectations.ExpectationError):
        tables.write_once(spark.createDataFrame([("m", "a"), ("m", "b")], ddl), path, "key", "digest")
    assert sorted(tuple(r) for r in spark.read.schema(ddl).parquet(path).collect()) == [("k", "a"), ("l", "b")]


def test_geojson(spark):
    rows = spark.createDataFrame([(f"k{k}", "t", "e", "ACTIVE", "MAPPABLE" if k else "LOCATION_HIDDEN", 47.0, 8.0) for k in range(4)], "vacancy_key string, title string, employer string, vacancy_status string, mapping_status string, public_display_latitude double, public_display_longitude double")
    rows = rows.withColumns({"first_seen_at": F.current_timestamp(), "location_resolution_status": F.lit("RESOLVED"), "privacy_display_level": F.lit("EXACT_ALLOWED")})
    features, truncated = snapshot.geojson(rows, 2)
    assert truncated and features.count() == 2 and json.loads(features.first().feature)["geometry"]["coordinates"] == [8.0, 47.0]
    assert snapshot.geojson(rows, 3)[1] is False
    for column, value in (("public_display_latitude", None), ("public_display_latitude", float("nan")), ("public_display_longitude", 180.5), ("location_resolution_status", "REVIEW"), ("privacy_display_level", "HIDDEN")):
        kind = rows.schema[column].dataType
        assert snapshot.geojson(rows.withColumn(column, F.lit(value).cast(kind)))[0].count() == 0


def test_expectations(spark):
    rows = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert expectations.violations(rows, {"positive": F.col("x") > 0}).first().n_violations == 2
    with pytest.raises(expectations.ExpectationError):
        expectations.require(rows, {"positive": F.col("x") > 0})
