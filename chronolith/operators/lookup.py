"""Equality joins that hold when one key stands on a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.session import materialize

#: Rows from which a key is hot, and the most keys that can be: each has more than such a share of the rows.
HOT_ROWS, HOT_KEYS = 256, 1 << 20
#: Rows that a table of few columns may have to be broadcast.
FEW = 1 << 19
#: Rows of either side of a hot key that meet in one group, about.
BLOCK = 1024


def look_up(rows: DataFrame, table: DataFrame, key: str | list[str]) -> DataFrame:
    """``rows`` joined to ``table``, in which ``key`` is unique.

    Keys that stand on many rows do not meet in one task: they are at most ``HOT_KEYS``, since each has more than a
    ``HOT_KEYS``-th of the rows, and their answers are broadcast. Both tables are read several times, so they should be
    written ones.
    """
    keys = [key] if isinstance(key, str) else key
    most = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys)
    often = rows.join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys)
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys)
    return often.unionByName(rest)


def beside(rows: DataFrame, table: DataFrame, key: str, how: str, name: str) -> DataFrame:
    """Written ``rows`` joined to a written table of few columns. The table is broadcast while it has ``FEW`` rows at most,
    so that wide rows stay where they are; else the rows are shuffled once, and written as ``name``."""
    return rows.join(F.broadcast(table), key, how) if table.count() <= FEW else materialize(rows.join(table, key, how), name)


def meet(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """All rows of two sides whose keys are equal. The rows of a hot key are dealt into blocks on both sides, and every
    pair of blocks is a group of its own; there are at most ``HOT_KEYS`` hot keys, so they are broadcast."""
    most = max(BLOCK, (left.count() + right.count()) // HOT_KEYS)
    sizes = left.select(*keys).union(right.select(*keys)).groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = F.broadcast(sizes.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).alias("_blocks")))

    def dealt(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        blocks = F.coalesce("_blocks", F.lit(1))
        place = F.pmod(F.xxhash64(name), blocks)
        return side.join(hot, keys, "left").withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("_blocks")

    joined = dealt(left, left_id, "_i", "_j").join(dealt(right, right_id, "_j", "_i"), [*keys, "_i", "_j"])
    return joined.drop("_i", "_j")
