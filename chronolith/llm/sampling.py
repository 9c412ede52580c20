"""Bounded samples for training, and the training folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``: the contracts' folds. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sampled_ids(rows: DataFrame, value: str, bound: int) -> DataFrame:
    """At most ``bound`` ``(sample_id, target)`` rows of non-null id and value, chosen by a hash of the id."""
    chosen = rows.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).select(F.col("doc_id").alias("sample_id"), F.col(value).alias("target"))
    return chosen.orderBy(F.xxhash64("sample_id", F.lit(7)), "sample_id", "target").limit(bound)


#: Parts of the hash by which samples of each value are narrowed down before they are ranked.
PARTS = 256


def sampled_of_each(rows: DataFrame, value: str, bound: int) -> DataFrame:
    """Of each non-null value at most ``bound`` ``(sample_id, target)`` rows of non-null id, chosen by a hash of the id."""
    chosen = rows.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).select(F.col("doc_id").alias("sample_id"), F.col(value).alias("target"))
    hashed = chosen.withColumn("hash", F.xxhash64("sample_id", F.lit(7))).withColumn("part", F.shiftrightunsigned("hash", 56))
    # The parts that hold the first ``bound`` rows of each value, so that a frequent value isn't ranked whole.
    before = F.sum("n").over(Window.partitionBy("target").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = hashed.groupBy("target", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < bound)
    last = parts.groupBy(F.col("target").alias("of")).agg(F.max("part").alias("last"))
    near = hashed.join(F.broadcast(last), F.col("target") == F.col("of")).where(F.col("part") <= F.col("last"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("part", "hash", "sample_id"))
    return near.withColumn("place", place).where(F.col("place") <= bound).select("sample_id", "target")


def with_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``(text, target)`` of the sampled documents; the sample has a documented bound, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("sample_id")).select("doc_id", "text", "target")
