"""Decision tables."""

import pytest
from pyspark.sql import functions as F

from chronolith.functions.text import jaccard, norm_alnum, norm_dedup, norm_ws, position_count, precedence_rank, requisition_id, safe_url, tokens
from chronolith.operators import readiness, rules, snapshot

# Terms of the relevance taxonomy that the cases need.
TERMS = [
    rules.Term("T001", "Gärtner", "TITLE"),
    rules.Term("T004", "Gartenunterhalt", "TITLE_OR_TEXT"),
    rules.Term("T007", "Grünpflege", "TITLE_OR_TEXT"),
    rules.Term("T010", "Arealpflege", "TITLE_OR_TEXT"),
    rules.Term("T022", "Mitarbeiter Werkhof", "HIDDEN_PUBLIC_TITLE"),
    rules.Term("T026", "Fachmann Betriebsunterhalt", "HIDDEN_PUBLIC_TITLE"),
    rules.Term("T034", "Winterdienst", "TEXT_SIGNAL"),
    rules.Term("T038", "Stadtgrün", "ORGANIZATION_SIGNAL"),
    rules.Term("T052", "Reinigung", "EXCLUSION"),
]
CASES = [
    ("Gärtner:in Gartenunterhalt", "", "", "GREEN_CONFIRMED"),
    ("Landschaftsgärtner", "", "", "GREEN_CONFIRMED"),
    ("Mitarbeiter Werkhof", "", "", "REVIEW"),
    ("Mitarbeiter Werkhof", "Grünpflege", "", "GREEN_CONFIRMED"),
    ("Fachmann Betriebsunterhalt", "Arealpflege", "", "GREEN_CONFIRMED"),
    ("Winterdienst", None, "", "REVIEW"),
    ("Softwareentwickler", "Cloud-Plattform", "IT", "NOT_GREEN"),
    ("Reinigung", "", None, "NOT_GREEN"),
    ("Reinigung", "Grünpflege", "", "REVIEW"),
    ("Sachbearbeiter", "Budget und Termine", "Stadtgrün", "REVIEW"),
]


def test_relevance(spark):
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "id int, title string, text string, organization string, expected string")
    rows = rows.select("id", "expected", *(norm_ws(F.col(c)).alias(c) for c in ("title", "text", "organization")))
    assert rules.relevance(rows, TERMS).where("result <> expected").count() == 0


def test_taxonomy_is_checked(spark):
    bad = spark.createDataFrame([("a", "x", "TITLE"), ("a", "y", "TITLE")], "term_id string, search_term string, term_type string")
    with pytest.raises(ValueError, match="repeated"):
        rules.terms_of(bad)


SIGNALS = [rules.Signal(i, p, s) for i, p, s in [("P001", "hochwertige privatgärten", "JOB_OR_EMPLOYER"), ("P004", "gehobene kundschaft", "JOB"), ("P006", "herrschaftsgärtner", "JOB"), ("P012", "hauswart", "TITLE_OR_TEXT"), ("P008", "privatgarten", "JOB"), ("P015", "poolbau", "JOB"), ("N001", "villa", "INFERENCE")]]
SEGMENT_CASES = [
    ("NOT_GREEN", "hochwertige privatgärten", [], "UNKNOWN", "SKIPPED_NOT_GREEN"),
    (None, "hochwertige privatgärten", [], "UNKNOWN", "SKIPPED_NOT_GREEN"),
    ("GREEN_CONFIRMED", "hochwertige privatgärten", [], "PRIVATE_RESIDENTIAL_PREMIUM", "CLASSIFIED"),
    ("GREEN_CONFIRMED", "hochwertige privatgärtene", [], "UNKNOWN", "NO_SUFFICIENT_EVIDENCE"),
    ("GREEN_CONFIRMED", "hochwertige privatgärten herrschaftsgärtner", [], "UNKNOWN", "REVIEW"),
    ("GREEN_CONFIRMED", "hauswart", [], "PRIVATE_ESTATE_DIRECT", "CLASSIFIED"),
    ("GREEN_CONFIRMED", "gehobene kundschaft privatgarten", [], "UNKNOWN", "REVIEW"),
    ("GREEN_CONFIRMED", "privatgarten poolbau", [], "PRIVATE_RESIDENTIAL_STANDARD", "CLASSIFIED"),
    ("GREEN_CONFIRMED", "poolbau villa", [], "UNKNOWN", "NO_SUFFICIENT_EVIDENCE"),
    ("GREEN_CONFIRMED", None, ["wir pflegen hochwertige privatgärten"], "PRIVATE_RESIDENTIAL_PREMIUM", "CLASSIFIED"),
]


def test_segments(spark):
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(SEGMENT_CASES)], "id int, effective_result string, description string, profiles array<string>, e_segment string, e_status string")
    rows = rows.withColumns({c: F.lit("") for c in ("title", "benefits", "qualifications", "responsibilities")})
    found = rules.segments(rows, SIGNALS)
    assert found.where("segment <> e_segment OR status <> e_status").count() == 0
    strength = {r.id: r.strength for r in found.collect()}
    assert strength[2] == "STRONG" and strength[5] == "MODERATE" and strength[9] == "MODERATE"


def test_positions(spark):
    cases = [("80-100 %", None, False), ("ab 1. August", None, False), ("2 Mitarbeitende gesucht", 2, True), ("zwei Teams", None, False), ("mehrere Mitarbeitende gesucht", None, True), ("50%2 Stellen", None, False), (None, None, False)]
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "id int, t string").select("id", position_count(F.col("t")).alias("p"))
    assert {r.id: (r.p.positions_count, r.p.multi_hire) for r in rows.collect()} == {k: c[1:] for k, c in enumerate(cases)}


def test_normalization(spark):
    row = spark.createDataFrame([("Gärtner*in  GROẞ-Straße, 80%",), (None,)], "t string").select(norm_dedup("t").alias("d"), norm_ws("t").alias("w"), norm_alnum("t").alias("a")).collect()
    assert row[0] == ("gärtnerin gross strasse 80%", "gärtner*in gross-strasse, 80%", "gärtner in gross strasse 80")
    assert row[1] == ("", "", "")


def test_jaccard_ties_to_even(spark):
    rows = spark.range(1).select(jaccard(F.array(*map(F.lit, "ab")), F.array(*map(F.lit, "bc"))).alias("x"), jaccard(F.array().cast("array<string>"), F.array(F.lit("a"))).alias("y"), tokens(F.lit("aa b aa cc")).alias("t")).first()
    assert float(rows.x) == 0.3333 and float(rows.y) == 0 and rows.t == ["aa", "cc"]


def test_requisition_and_urls(spark):
    rows = spark.createDataFrame([('{"a": [{"Requisition-ID": 7}], "jobReqId": " x "}',), ('{"a": [{"requisition-id": 7}]}',), ("no",), (None,)], "j string").select(requisition_id("j").alias("r")).collect()
    assert [r.r for r in rows] == ["x", "7", None, None]
    urls = ["https://a.ch/x", "//a.ch", "https://u:p@a.ch", "javascript:x", "https://a.ch/ b", "http://a.ch:bad/", None, "https:///x"]
    assert [r.u for r in spark.createDataFrame([(u,) for u in urls], "u string").select(safe_url("u").alias("u")).collect()] == ["https://a.ch/x"] + [""] * 7


def test_precedence(spark):
    cases = [("regional board", 6), ("public_portal", 5), ("specialist", 4), ("staffing", 3), ("Wettbewerb", 3), ("private direct", 2), ("canton", 1), (None, 1)]
    rows = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(precedence_rank(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == [k for _, k in cases]


def test_effective_result(spark):
    judged = spark.createDataFrame([(1, "REVIEW"), (2, "REVIEW"), (3, "NOT_GREEN"), (4, None), (5, "REVIEW"), (6, "REVIEW")], "assessment_id int, result string")
    human = spark.createDataFrame([(10, 1, "GREEN_CONFIRMED", 1, 1), (11, 1, "NOT_GREEN", 2, 2), (12, 2, "GREEN_CONFIRMED", 9, 1), (13, 3, "GREEN_CONFIRMED", 1, 1), (14, 5, "INSUFFICIENT", 1, 1)], "decision_id int, assessment_id int, outcome string, r int, c int")
    human = human.select("decision_id", "assessment_id", "outcome", F.timestamp_seconds("r").alias("reviewed_at"), F.timestamp_seconds("c").alias("created_at"))
    applied = spark.createDataFrame([(20, 6, 10), (21, 1, 10)], "application_id int, assessment_id int, source_decision_id int").withColumn("created_at", F.timestamp_seconds(F.lit(3)))
    found = rules.effective_result(judged, human, applied, F.timestamp_seconds(F.lit(5)))
    assert {r.assessment_id: r.effective_result for r in found.collect()} == {1: "NOT_GREEN", 2: "REVIEW", 3: "NOT_GREEN", 4: "MISSING", 5: "REVIEW", 6: "GREEN_CONFIRMED"}


BAD_FILTERS = [
    {"x": "1"}, {"page": "1"}, {"status": "OPEN"}, {"status": ["ACTIVE", "ACTIVE"]}, {"canton": "Z"}, {"canton": "Z1"}, {"canton": "ZHX"}, {"mapping": "NO"}, {"segment": "LUXURY"}, {"precision": "STREET"}, {"municipality": "x" * 201}, {"q": "x" * 201},
    {"published_from": "2024-02-01", "published_to": "2024-01-01"}, {"first_seen_from": "2024-02-01", "first_seen_to": "2024-01-31"}, {"published_to": "1.2.2024"},
]


@pytest.mark.parametrize("given", BAD_FILTERS)
def test_filters_are_refused(given):
    with pytest.raises(ValueError):
        snapshot.FilterSpec.parse(given)


def test_filters_cut_long_values_and_pass_over_empty_ones(spark):
    long = "M" * 150
    rows = spark.createDataFrame([(1, "AB", "m" * 100, "s" * 40, "t"), (2, "AB", "m" * 150, "s" * 150, "t"), (3, None, None, None, None)], "id int, canton_code string, municipality_name string, source_id string, title string").withColumn("employer", F.lit("e"))
    ids = lambda given: [r.id for r in rows.where(snapshot.FilterSpec.parse(given).condition()).orderBy("id").collect()]
    assert ids({"municipality": long, "source": ["s" * 150], "canton": "ab"}) == [1]
    assert ids({"canton": "xx"}) == [] and ids({"q": " ", "status": "", "canton": []}) == [1, 2, 3] and ids({"q": " T "}) == [1, 2] and ids({"q": "%"}) == []


def test_record_pages(spark):
    rows = spark.range(30).select(F.col("id").alias("vacancy_key"), F.when(F.col("id") < 25, "PUBLIC_GREEN_CONFIRMED").otherwise("REVIEW_NOT_PUBLIC").alias("visibility_status"), F.lit("ACTIVE").alias("vacancy_status"), F.timestamp_seconds("id").alias("first_seen_at"))
    found, total, pages = snapshot.record_page(rows, {"status": "ACTIVE"}, 3, 10)
    assert ([r.vacancy_key for r in found.collect()], total, pages) == ([4, 3, 2, 1, 0], 25, 3)
    assert snapshot.record_page(rows, {"status": "CLOSED_OBSERVED"})[1:] == (0, 1)
    with pytest.raises(ValueError, match="beyond"):
        snapshot.record_page(rows, {}, 4, 10)


def test_paging(spark):
    rows = spark.range(30)
    assert [r.id for r in snapshot.page(rows, [F.desc("id")], 2, 25).collect()] == [4, 3, 2, 1, 0]
    assert snapshot.page(rows.where("id < 0"), [F.desc("id")], 1).count() == 0
    for number, size in ((3, 25), (0, 25), (1, 101)):
        with pytest.raises(ValueError):
            snapshot.page(rows, [F.desc("id")], number, size)


@pytest.mark.parametrize("authorized,structural,expected", [(23, True, "NOT_READY"), (24, True, "AUTHORIZED"), (24, False, "NOT_READY")])
def test_readiness_threshold(authorized, structural, expected):
    assert readiness.status(False, False, True, 0, 0, authorized, 29, structural) == expected
    assert readiness.status(False, False, True, 0, 1, authorized, 29, structural) == "BLOCKED_QUALITY"
    assert readiness.status(False, False, True, 0, 0, 0, 0, True) == "NOT_READY"


def test_freshness_bound(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:01",), ("2024-01-01 00:00:00",), ("2023-12-31 23:59:59.999999",)], "t string")
    got = rows.select(readiness.fresh(F.to_timestamp("t"), F.lit("2024-01-04 00:00:00").cast("timestamp")).alias("f")).collect()
    assert [r.f for r in got] == [True, True, False]
