"""Clusters kept up to date from cutoff to cutoff: an index that only what has changed is held against.

Postings whose features are all equal are a class, named by the digest of the features, so a class never changes: a
posting that changes leaves one and joins another. The index holds the living classes with their features, which posting
is in which, the links by which classes merge, and each posting's cluster.

An update compares only ids and digests of all postings. Classes that came are joined with all living ones under their keys
(``tiles``); where a class went, its neighbours in the links are held against all others again, since it may
have been what tied them together. Components are solved anew only where a class came, went or was linked, or where a
posting moved. The labels are those of a run from scratch.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators.components import components
from chronolith.operators.linkage import FEATURES, MERGE_KEYS, MERGE_TEXTS, MERGE_TITLES, assessed, hard_merge_candidates, scored_pairs
from chronolith.operators.lookup import look_up
from chronolith.operators.tiles import like_pairs
from chronolith.session import materialize

REPORT = "n_postings long, n_changed long, n_classes_gained long, n_classes_lost long, n_pairs_scored long, n_reread long"


@dataclass(frozen=True)
class Index:
    """What a cutoff leaves for the next one.

    ``classes``: posting_id (the class's digest) and features; ``members``: posting_id, class; ``links``: a, b (classes;
    a = b where a class's own copies merge); ``parts``: class, component, of the classes with a link; ``labels``:
    posting_id, cluster.
    """

    classes: DataFrame
    members: DataFrame
    links: DataFrame
    parts: DataFrame
    labels: DataFrame


def save(index: Index, path: str) -> None:
    """Write an index below a new folder; it exists once its last table does."""
    for f in fields(Index):
        getattr(index, f.name).write.parquet(f"{path.rstrip('/')}/{f.name}")
    index.classes.sparkSession.range(1).write.parquet(f"{path.rstrip('/')}/complete")


def load(spark: SparkSession, path: str) -> Index:
    """An index as it was saved; one that was not written to the end is refused."""
    spark.read.parquet(f"{path.rstrip('/')}/complete")
    return Index(**{f.name: spark.read.parquet(f"{path.rstrip('/')}/{f.name}") for f in fields(Index)})


def class_of() -> Column:
    """The digest of all features."""
    return F.sha2(F.to_json(F.struct(*FEATURES), {"ignoreNullFields": "false"}), 256)


def update(index: Index | None, rows: DataFrame) -> tuple[Index, DataFrame]:
    """The index and labels of ``rows`` (posting_id, unique, and all features: the postings at the new cutoff), from those
    of the cutoff before, if there is one; and one row of ``REPORT``: how many postings changed, how many pairs were
    scored, and of how many postings the clusters were solved again."""
    spark = rows.sparkSession
    named = rows.withColumn("class", class_of())
    now = materialize(named.select("posting_id", "class"), "members")
    if index is None:
        index = _nothing(rows, now)
    before = index.members.withColumnRenamed("class", "old")
    changed = materialize(now.join(before, "posting_id", "full_outer").where(~F.col("class").eqNullSafe(F.col("old"))).select("posting_id", "class", "old"), "changed")
    one = lambda c: changed.where(F.col(c).isNotNull()).select(F.col(c).alias("class")).distinct()
    known = index.classes.select(F.col("posting_id").alias("class"))
    gained = materialize(one("class").join(known, "class", "left_anti"), "gained")
    lost = materialize(one("old").join(now, "class", "left_anti"), "lost")
    chosen = changed.join(gained, "class", "left_semi").groupBy("class").agg(F.min("posting_id").alias("posting_id"))
    fresh = materialize(rows.join(chosen, "posting_id").select(F.col("class").alias("posting_id"), *FEATURES), "classes")
    gone = lost.select(F.col("class").alias("posting_id"))
    live = materialize(index.classes.join(gone, "posting_id", "left_anti").unionByName(fresh), "classes")

    ends = index.links.union(index.links.select("b", "a")).toDF("class", "other")
    widowed = ends.join(lost, "class", "left_semi").select(F.col("other").alias("class")).join(lost, "class", "left_anti")
    asked = materialize(gained.union(widowed).distinct().select(F.col("class").alias("posting_id")), "asked")
    alike = materialize(assessed(like_pairs(live, list(MERGE_KEYS), MERGE_TITLES, MERGE_TEXTS, asked)).select("a", "b", "outcome"), "alike")
    copies = gained.select(F.col("class").alias("a"), F.col("class").alias("b"))
    pairs = materialize(hard_merge_candidates(live, asked).union(copies).distinct(), "pairs")
    met_by = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "posting_id")
    merged = materialize(scored_pairs(live.join(met_by, "posting_id", "left_semi"), pairs).select("a", "b", "outcome").union(alike).where("outcome = 'AUTO_MERGE'").select("a", "b").distinct(), "links")
    apart = lambda df, c: df.join(lost.withColumnRenamed("class", c), c, "left_anti")
    links = materialize(apart(apart(index.links, "a"), "b").select("a", "b").union(merged).distinct(), "links")

    # Where something came, went, was linked or moved, with the whole components that it was in.
    touched = [gained, lost, one("class"), one("old"), widowed, merged.select("a"), merged.select("b")]
    seeds = materialize(reduce(DataFrame.union, touched).distinct(), "touched")
    old = index.parts.join(seeds, "class", "left_semi").select("component").distinct()
    whole = index.parts.join(old, "component", "left_semi").select("class")
    area = materialize(seeds.union(whole).distinct(), "area")
    inside = links.join(area.withColumnRenamed("class", "a"), "a", "left_semi")
    solved = components(inside).select(F.col("node").alias("class"), F.col("label").alias("component"))
    parts = materialize(index.parts.join(area, "class", "left_anti").unionByName(solved), "parts")

    reread = materialize(now.join(area, "class", "left_semi"), "reread")
    # The classes of the area that are linked; a component's label is its least posting.
    placed = materialize(reread.join(parts.join(area, "class", "left_semi"), "class").select("posting_id", "component"), "placed")
    least = materialize(placed.groupBy("component").agg(F.min("posting_id").alias("cluster")), "least")
    tied = look_up(placed, least, "component").select("posting_id", "cluster")
    alone = reread.join(placed, "posting_id", "left_anti").select("posting_id", F.col("posting_id").alias("cluster"))
    kept = index.labels.join(reread, "posting_id", "left_anti").join(now, "posting_id", "left_semi")
    labels = materialize(kept.unionByName(tied).unionByName(alone), "labels")
    counts = [now.count(), changed.count(), gained.count(), lost.count(), pairs.count() + alike.count(), reread.count()]
    return Index(live, now, links, parts, labels), spark.createDataFrame([tuple(counts)], REPORT)


def _nothing(rows: DataFrame, members: DataFrame) -> Index:
    spark, key = rows.sparkSession, rows.schema["posting_id"].dataType.simpleString()
    empty = lambda ddl: spark.createDataFrame([], ddl)
    classes = rows.select(F.lit("").alias("posting_id"), *FEATURES).limit(0)
    return Index(classes, members.limit(0), empty("a string, b string"), empty("class string, component string"), empty(f"posting_id {key}, cluster {key}"))
