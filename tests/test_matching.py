"""Many patterns at once against one look at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chronolith.functions.matching import Pattern, matcher, names_of
from chronolith.operators import rules


def texts(chance, n):
    letters = "abé ß"
    return [None, "", " ", "a", "a a", *("".join(chance.choice(letters) for _ in range(chance.randint(1, 60))) for _ in range(n)), "ab " * 100_000]


@pytest.mark.parametrize("whole", [False, True])
def test_hits_equal_brute_force(spark, whole):
    chance = random.Random(3)
    made = ["", "a", "a a", "a", *("".join(chance.choice("abé ß") for _ in range(chance.randint(1, 5))).strip() for _ in range(200))]
    patterns = [Pattern(f"n{k}", t, f"b{k % 3}", (("x", "y"), ("y",), ("y", "x"))[k % 3]) for k, t in enumerate(made)]
    rows = [(k, t, chance.choice(texts(chance, 5)[:9])) for k, t in enumerate(texts(chance, 60))] + [(0, None, None)] * 2
    frame = spark.createDataFrame(rows, "id int, x string, y string")
    got = frame.select("id", "x", "y", matcher(spark, patterns, whole)(x=F.col("x"), y=F.col("y")).alias("h")).collect()

    def holds(text, needle):
        return bool(needle) and f" {needle} " in f" {text or ''} " if whole else needle in (text or "")

    want = [(k, [(p.bucket, p.name, s) for p in patterns for s in p.surfaces if holds({"x": x, "y": y}[s], p.text)]) for k, x, y in rows]
    key = lambda r: (r[0], str(r[1]))
    assert sorted(((r.id, [tuple(h) for h in r.h]) for r in got), key=key) == sorted(want, key=key)
    assert frame.limit(0).select(matcher(spark, patterns, whole)(x=F.col("x")).alias("h")).count() == 0
    assert frame.select(matcher(spark, [], whole)(x=F.col("x")).alias("h")).where("size(h) > 0").count() == 0


def test_a_large_taxonomy_needs_no_larger_plan(spark):
    chance = random.Random(1)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(chance.randint(3, 9)))
    kinds = sorted(rules.KINDS)
    terms = [rules.Term(f"t{k:05d}", f"{word()} {word()}" if k % 5 else word(), kinds[k % len(kinds)]) for k in range(20_000)]
    docs = [(k, f"{word()} {word()}", " ".join(word() for _ in range(200)), word()) for k in range(60)]
    rows = spark.createDataFrame(docs, "id int, title string, text string, organization string")
    found = rules.relevance(rows, terms)
    plan = lambda df: re.sub(r"#\d+L?|_\d+", "", df._jdf.queryExecution().optimizedPlan().toString())
    assert plan(found) == plan(rules.relevance(rows, terms[:6]))
    for r in found.collect():
        for kind in ("positive", "hidden", "signal", "organization", "exclusion"):
            own = [t.term_id for t in terms if rules.KINDS[t.term_type][1] == kind and any(t.search_term in r[s] for s in rules.KINDS[t.term_type][0])]
            assert r[f"matched_{kind}"] == own


def test_names(spark):
    rows = spark.createDataFrame([([("a", "n1", "x"), ("b", "n2", "x"), ("a", "n1", "y"), ("a", "n0", "x")],)], "h array<struct<bucket:string,name:string,surface:string>>")
    assert rows.select(names_of("h", "a").alias("n")).first().n == ["n1", "n0"]
