"""Closures and digest trees against plain loops."""

import random

from pyspark.sql import functions as F

from chronolith.operators import lineage

EDGE = "table string, key string, field string, target_table string, target_key string"
ROW = "table string, key string, digest string"


def test_closure_equals_a_search(spark):
    chance = random.Random(2)
    nodes = [(t, str(k)) for t in "abc" for k in range(60)]
    edges = [(*chance.choice(nodes), "f", *chance.choice(nodes)) for _ in range(160)] + [("a", "0", "f", "a", "0"), ("a", "1", "f", "b", "1"), ("b", "1", "f", "a", "1")]
    edges += [("hub", "1", f"f{k}", "leaf", str(k % 700)) for k in range(1000)] + edges[:5]
    roots = [("a", "0"), ("a", "1"), ("c", "5"), ("c", "5"), ("hub", "1"), ("none", "1")]
    depth = {r: 0 for r in roots}
    waiting = list(dict.fromkeys(roots))
    for node in waiting:
        for t, k, _, x, y in edges:
            if (t, k) == node and (x, y) not in depth:
                depth[(x, y)] = depth[node] + 1
                waiting.append((x, y))
    got = lineage.closure(spark.createDataFrame(edges, EDGE), spark.createDataFrame(roots, "table string, key string"))
    assert {(r.table, r.key): r.depth for r in got.collect()} == depth
    held = {"a": (spark.range(30), "id"), "leaf": (spark.range(5), "id")}
    there = {("a", str(k)) for k in range(30)} | {("leaf", str(k)) for k in range(5)}
    assert {(r.table, r.key) for r in lineage.missing(got, held).collect()} == depth.keys() - there
    empty = spark.createDataFrame([], EDGE)
    assert lineage.closure(empty, spark.createDataFrame(roots, "table string, key string")).count() == 5
    assert lineage.closure(empty, spark.createDataFrame([], "table string, key string")).count() == 0


def test_references(spark):
    rows = spark.createDataFrame([(1, 7, None), (2, None, "x")], "id int, u int, v string")
    got = lineage.references({"t": (rows, "id")}, {"t": {"u": "a", "v": "b"}}).collect()
    assert sorted(map(tuple, got)) == [("t", "1", "u", "a", "7"), ("t", "2", "v", "b", "x")]


def test_tampering_names_its_path(spark):
    rows = [(t, str(k), f"d{k}") for t in ("a", "b") for k in range(3000)]
    left = spark.createDataFrame(rows, ROW)
    other = [("a", "17", "tampered"), *rows[:17], *rows[18:5000], ("b", "new", "d")]
    right = spark.createDataFrame(other, ROW).repartition(7)
    one, two = lineage.digest_tree(left), lineage.digest_tree(right)
    found = {(r.table, r.key, r.state) for r in lineage.differences(one, two, left, right).collect()}
    assert found == {("a", "17", "CONFLICTING"), ("b", "new", "RIGHT_ONLY")} | {("b", str(k), "LEFT_ONLY") for k in range(2000, 3000)}
    again = lineage.digest_tree(left.repartition(5))
    assert one.exceptAll(again).isEmpty() and lineage.differences(one, again, left, left).isEmpty()
    assert {r.prefix for r in lineage.differences(one, two, left, right).where("key = '17'").collect()} == {r.p for r in spark.range(1).select(F.substring(F.sha2(F.lit("17"), 256), 1, 4).alias("p")).collect()}
    nothing = lineage.digest_tree(left.limit(0))
    assert lineage.differences(one, nothing, left, left.limit(0)).count() == 6000
