"""Clusters after increments against clusters from scratch."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import increments, linkage
from tests.test_linkage import SCHEMA, expected, postings, with_copies


def from_scratch(rows):
    """Least id of each posting's cluster, by plain loops over all pairs."""
    label = {r[0]: r[0] for r in rows}
    merged = [(a, b) for a, b, _, _, how in expected(rows) if how == "AUTO_MERGE"]
    moved = True
    while moved:
        moved = False
        for a, b in merged:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def found(labels):
    return {r.posting_id: r.cluster for r in labels.collect()}


@pytest.mark.parametrize("seed", [2, 11])
def test_labels_equal_a_run_from_scratch(spark, seed, tmp_path):
    chance = random.Random(seed)
    rows = sorted(with_copies(list(postings(70, seed)), seed))
    other = lambda r: (*r[:3], chance.choice(["", "80"]), *r[4:])
    first = [other(r) if chance.random() < 0.2 else r for r in rows if chance.random() < 0.7]
    second = [r for r in rows if chance.random() < 0.85]
    third = [other(r) if chance.random() < 0.05 else r for r in second if chance.random() < 0.9]
    index = None
    for k, step in enumerate((first, second, third, third)):
        frame = spark.createDataFrame(step, SCHEMA)
        index, report = increments.update(index, frame)
        assert found(index.labels) == from_scratch(sorted(step))
        told = report.first()
        assert told.n_postings == len(step)
        assert k < 3 or (told.n_changed, told.n_pairs_scored, told.n_reread) == (0, 0, 0)
        increments.save(index, f"{tmp_path}/{k}")
        index = increments.load(spark, f"{tmp_path}/{k}")
    scratch = linkage.vacancy_clusters(spark.createDataFrame(third, SCHEMA))
    assert found(scratch) == found(index.labels)


def test_only_touched_components_are_read_again(spark):
    rows = [(f"p{k:04d}", "a", "zuerich", "80", "", f"u{k // 4}", "", [f"w{k}"], ["t"], ["zuerich"], None, None) for k in range(400)]
    index, _ = increments.update(None, spark.createDataFrame(rows, SCHEMA))
    rows[17] = (*rows[17][:5], "u90", *rows[17][6:])
    index, report = increments.update(index, spark.createDataFrame(rows, SCHEMA))
    told = report.first()
    assert (told.n_changed, told.n_classes_gained, told.n_classes_lost, told.n_reread) == (1, 1, 1, 8)
    assert found(index.labels)["p0017"] == "p0017" and found(index.labels)["p0360"] == "p0017"


def test_a_star_outlives_its_centre(spark):
    """The first seen of many postings ties the others together; when it goes, they stay tied."""
    rows = [(f"p{k}", "a", "", "", "r1", "", "", [f"w{k}"], [], [], None, None) for k in range(6)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("first_seen_at", F.timestamp_seconds(F.substring("posting_id", 2, 1).cast("int")))
    index, _ = increments.update(None, frame)
    index, _ = increments.update(index, frame.where("posting_id <> 'p0'"))
    assert set(found(index.labels).values()) == {"p1"}
    index, _ = increments.update(index, frame.where("posting_id IN ('p3', 'p5')"))
    assert found(index.labels) == {"p3": "p3", "p5": "p3"}


def test_postings_with_a_redirect_only_all_merge(spark):
    rows = [(f"p{k}", "", "", "", "", "", "u1", [f"w{k}"], [], [], None, None) for k in range(3)] + [("q", "", "", "", "", "u1", "", [], [], [], None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("first_seen_at", F.timestamp_seconds(F.lit(0)))
    assert set(found(linkage.vacancy_clusters(frame)).values()) == {"p0"}
    assert set(found(increments.update(None, frame)[0].labels).values()) == {"p0"}


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    index, report = increments.update(None, empty)
    assert index.labels.count() == 0 and set(report.first()) == {0}
    rows = spark.createDataFrame(list(postings(5)), SCHEMA)
    index, _ = increments.update(index, rows)
    index, report = increments.update(index, empty)
    assert index.labels.count() == 0 and report.first().n_changed == 5
