"""Candidate pairs, scores, barriers and clusters against plain loops."""

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from chronolith.operators import linkage
from chronolith.operators.components import components

T0 = datetime(2024, 1, 1)
SCHEMA = "posting_id string, employer string, location string, terms string, requisition string, url string, redirect string, title_tokens array<string>, text_tokens array<string>, location_tokens array<string>, first_seen_at timestamp, closed_at timestamp"


def postings(n=70, seed=2):
    chance = random.Random(seed)
    words = ["gaertner", "park", "stadt", "pflege", "leiter", "team", "bau"]
    for k in range(n):
        location = chance.choice(["", "zuerich", "bern stadt", "zuerich stadt"])
        closed = T0 + timedelta(days=chance.randint(0, 200)) if chance.random() < 0.3 else None
        yield (f"p{k:03d}", chance.choice(["", "a", "a", "b"]), location, chance.choice(["", "", "80", "100"]), chance.choice(["", "", "", "r1", "r2"]), chance.choice(["", f"u{k % 20}", f"u{k}"]), chance.choice(["", "", f"u{(k + 1) % 20}"]), sorted(set(chance.sample(words, chance.randint(0, 4)))), sorted(set(chance.sample(words, 3))), location.split(), T0 + timedelta(days=chance.randint(0, 300)), closed)


def similarity(a, b):
    if not a or not b:
        return Decimal(0)
    return (Decimal(len(set(a) & set(b))) / Decimal(len(set(a) | set(b)))).quantize(Decimal("0.0001"), ROUND_HALF_EVEN)


def expected(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in rows]
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            same = {f: bool(a[f]) and a[f] == b[f] for f in ("employer", "location", "terms", "requisition", "url")}
            hard = same["requisition"] or same["url"] or bool(a["redirect"]) and a["redirect"] == b["url"] or bool(b["redirect"]) and b["redirect"] == a["url"]
            title, text = similarity(a["title_tokens"], b["title_tokens"]), similarity(a["text_tokens"], b["text_tokens"])
            if not hard and not (same["employer"] and title >= Decimal("0.20")):
                continue
            parts = [(same["employer"], "0.25"), (title, "0.25"), (same["location"], "0.15"), (text, "0.20"), (same["terms"], "0.10"), (same["requisition"], "0.05")]
            score = sum((Decimal(v) * Decimal(w) for v, w in parts), Decimal(0)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
            bars = []
            if same["employer"] and a["requisition"] and b["requisition"] and not same["requisition"]:
                bars.append("DISTINCT_REQUISITION_IDS")
            if a["location"] and b["location"] and not set(a["location_tokens"]) & set(b["location_tokens"]):
                bars.append("MATERIALLY_DIFFERENT_LOCATION")
            if a["terms"] and b["terms"] and not same["terms"]:
                bars.append("INCOMPATIBLE_EXPLICIT_EMPLOYMENT_TERMS")
            first, later = (a, b) if a["first_seen_at"] <= b["first_seen_at"] else (b, a)
            if first["closed_at"] and later["first_seen_at"] > first["closed_at"] and not same["requisition"]:
                days = (later["first_seen_at"] - first["closed_at"]).total_seconds() / 86400
                if not (0 <= days <= 90 and score >= Decimal("0.90")):
                    bars.append("REPOST_WINDOW_EXCEEDED")
            merged = hard or score >= Decimal("0.90")
            yield a["posting_id"], b["posting_id"], score, bars, "KEEP_SEPARATE" if bars else "AUTO_MERGE" if merged else "REVIEW" if score >= Decimal("0.78") else "KEEP_SEPARATE"


def test_pairs_equal_the_loop(spark):
    rows = list(postings())
    frame = spark.createDataFrame(rows, SCHEMA)
    got = linkage.scored_pairs(frame, linkage.candidate_pairs(frame)).collect()
    assert sorted((r.a, r.b, r.score, r.barriers, r.outcome) for r in got) == sorted(expected(rows))


def with_copies(rows, seed=1):
    """Each posting some more times under other ids, and none closed before it was seen."""
    chance = random.Random(seed)
    kept = [(*r[:-2], r[-2], r[-1] and max(r[-1], r[-2])) for r in rows]
    return kept + [(f"c{k:03d}{n}", *r[1:]) for k, r in enumerate(kept) for n in range(chance.choice([0, 0, 1, 4]))]


def counted(pairs):
    merged = [(a, b) for a, b, _, _, how in pairs if how == "AUTO_MERGE"]
    barred = [p for p in pairs if p[3]]
    return {"candidate_pairs": len(pairs), "merged": len(merged), "review_pairs": sum(p[4] == "REVIEW" for p in pairs), "keep_separate_pairs": sum(p[4] == "KEEP_SEPARATE" for p in pairs), "hard_barrier_pairs": len(barred)}


def test_counters_of_class_pairs_equal_those_of_all_pairs(spark):
    for seed in (2, 5):
        rows = sorted(with_copies(list(postings(60, seed))))
        frame = spark.createDataFrame(rows, SCHEMA)
        members = linkage.classes(frame)
        pairs = linkage.class_pairs(frame, members).persist()
        every = list(expected(rows))
        got = linkage.run_counters(pairs).first().asDict()
        got["merged"] = got.pop("hard_key_merges") + got.pop("rule_auto_merges")
        assert got == counted(every)
        # Some pairs, copies among them, have been decided by humans: they count as candidates only.
        human = random.Random(seed).sample([(a, b) for a, b, *_ in every], 25)
        decided = linkage.decided_classes(spark.createDataFrame(human, "a string, b string"), members)
        got = linkage.run_counters(pairs, decided).first().asDict()
        got["merged"] = got.pop("hard_key_merges") + got.pop("rule_auto_merges")
        left = counted([p for p in every if p[:2] not in set(human)])
        assert got == left | {"candidate_pairs": len(every)}
    none = spark.createDataFrame([], SCHEMA)
    assert set(linkage.run_counters(linkage.class_pairs(none, linkage.classes(none))).first()) == {0}


def test_inherited_decisions(spark):
    pairs = spark.createDataFrame([(a, "z", "f", False, "REVIEW") for a in "abcd"], "a string, b string, fingerprint string, hard_key boolean, outcome string")
    direct = spark.createDataFrame([("z", "a", "f", "MERGE", 1)], "posting_a string, posting_b string, fingerprint string, human_outcome string, t int").withColumn("created_at", F.timestamp_seconds("t"))
    applied = [("a", "z", "f", "KEEP_SEPARATE", 2, 1), ("b", "z", "f", "MERGE", 2, 1), ("b", "z", "f", "KEEP_SEPARATE", 3, 1), ("c", "z", "f", "MERGE", 9, 1), ("c", "z", "f", "MERGE", 2, 9), ("d", "z", "other", "MERGE", 2, 1)]
    carried = spark.createDataFrame(applied, "posting_a string, posting_b string, fingerprint string, human_outcome string, t int, s int").withColumns({"created_at": F.timestamp_seconds("t"), "source_created_at": F.timestamp_seconds("s")})
    got = linkage.with_human_decisions(pairs, direct, F.timestamp_seconds(F.lit(5)), carried).collect()
    assert {r.a: (r.outcome, r.decided_by) for r in got} == {"a": ("MERGE", "DIRECT"), "b": ("KEEP_SEPARATE", "INHERITED"), "c": ("REVIEW", None), "d": ("REVIEW", None)}


def test_thresholds(spark):
    rows = spark.createDataFrame([("0.7799",), ("0.7800",), ("0.8999",), ("0.9000",)], "s string").select(F.col("s").cast("decimal(5,4)").alias("s"))
    free = rows.select(linkage.outcome(F.col("s"), F.lit(False), F.lit(False)).alias("o")).collect()
    assert [r.o for r in free] == ["KEEP_SEPARATE", "REVIEW", "REVIEW", "AUTO_MERGE"]
    assert {r.o for r in rows.select(linkage.outcome(F.col("s"), F.lit(True), F.lit(True)).alias("o")).collect()} == {"KEEP_SEPARATE"}


def test_components_equal_union_find(spark):
    chance = random.Random(9)
    links = [(chance.randint(0, 150), chance.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(1000, 1030)]
    links = [(a, b) for a, b in links if a != b]
    root = {n: n for pair in links for n in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vacancies(spark):
    rows = [("a", 2, 1, "CLOSED_OBSERVED", "2 Stellen"), ("b", 1, 5, "STILL_ACTIVE", "x"), ("c", 1, 5, "CLOSED_OBSERVED", "3 Personen"), ("d", 9, 1, "CLOSED_OBSERVED", "Lehrstellen")]
    frame = spark.createDataFrame(rows, "posting_id string, rank int, s int, lifecycle_state string, title string").select("*", F.timestamp_seconds("s").alias("first_seen_at"), F.timestamp_seconds("s").alias("last_seen_at"), F.lit("").alias("text"))
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")], "posting_id string, cluster string")
    got = {r.cluster: (r.canonical_posting, r.status, r.positions_count, r.multi_hire_possible, r.n_postings) for r in linkage.vacancies(frame, members).collect()}
    assert got == {"a": ("b", "ACTIVE", 3, True, 3), "d": ("d", "CLOSED_OBSERVED", None, True, 1)}


def test_human_decisions(spark):
    pairs = spark.createDataFrame([("a", "b", "f", False, "REVIEW"), ("a", "c", "f", True, "AUTO_MERGE")], "a string, b string, fingerprint string, hard_key boolean, outcome string")
    human = spark.createDataFrame([("b", "a", "f", "MERGE", 1), ("a", "c", "other", "KEEP_SEPARATE", 1), ("a", "c", "f", "KEEP_SEPARATE", 9)], "posting_a string, posting_b string, fingerprint string, human_outcome string, t int")
    human = human.withColumn("created_at", F.timestamp_seconds("t"))
    got = linkage.with_human_decisions(pairs, human, F.timestamp_seconds(F.lit(5))).collect()
    assert {(r.a, r.b): (r.outcome, r.method) for r in got} == {("a", "b"): ("MERGE", "HUMAN"), ("a", "c"): ("AUTO_MERGE", "HARD_KEY")}
