"""What a package must hold so that nothing in it points outside, and where two packages differ.

The closure follows typed references from the roots round by round; a round joins only what the round before found. A
digest tree sums rows' digests by ever shorter prefixes of their keys' digests, so two packages are compared from the top
and only what differs is looked into.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.governance import relationships
from chronolith.operators.lookup import look_up
from chronolith.session import materialize

NODE = ["table", "key"]
#: Hexadecimal digits of a key's digest in the prefixes of a tree, from the top.
LEVELS = (0, 2, 4)


def references(tables: dict[str, tuple[DataFrame, str]], typed: dict[str, dict[str, str]]) -> DataFrame:
    """``table, key, field, target_table, target_key`` of all rows: ``tables`` by name with their keys' names; ``typed``:
    for each table, the table that each of its fields refers to. Null references are none."""
    each = [relationships(tables[name][0], name, tables[name][1], fields) for name, fields in typed.items()]
    return reduce(DataFrame.union, each)


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``table, key, depth`` of all that the roots (table, key) lead to, themselves included (0), by the least number of
    references. Only the newest rows join the references in each round, so every row is followed once; cycles end."""
    edges = materialize(edges.select(*NODE, "target_table", "target_key").distinct(), "references")
    newest = materialize(roots.select(*NODE).distinct(), "frontier")
    reached, depth = newest.withColumn("depth", F.lit(0)), 0
    while not newest.isEmpty():
        depth += 1
        step = look_up(edges, newest, NODE).select(F.col("target_table").alias("table"), F.col("target_key").alias("key")).distinct()
        newest = materialize(step.join(reached.select(*NODE), NODE, "left_anti"), "frontier")
        reached = materialize(reached.unionByName(newest.withColumn("depth", F.lit(depth))), "reached")
    return reached


def missing(closed: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows of a closure that no table holds."""
    there = [rows.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key")) for name, (rows, key) in tables.items()]
    return closed.join(reduce(DataFrame.union, there), NODE, "left_anti")


def _summed(rows: DataFrame, by: list[str], words: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), *(F.pmod(F.sum(w), F.lit(1 << 60).cast("decimal(38,0)")).cast("decimal(38,0)").alias(w) for w in words))


def digest_tree(rows: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``table, level, prefix, n, s0, s1``: sums of the digests of rows (table, key, digest), by prefixes of their keys'
    digests. No order or partitioning changes them."""
    place = F.sha2(F.col("key"), 256)
    word = lambda k: F.conv(F.substring(F.sha2(F.concat_ws(":", "table", "key", "digest"), 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)").alias(f"s{k}")
    fine = rows.select("table", F.substring(place, 1, levels[-1]).alias("prefix"), F.lit(1).cast("long").alias("n"), word(0), word(1))
    level = materialize(_summed(fine, ["table", "prefix"], ["s0", "s1"]), "tree")
    out = [level.withColumn("level", F.lit(levels[-1]))]
    for digits in reversed(levels[:-1]):
        level = _summed(level.withColumn("prefix", F.substring("prefix", 1, digits)), ["table", "prefix"], ["s0", "s1"])
        out.append(level.withColumn("level", F.lit(digits)))
    return materialize(reduce(DataFrame.unionByName, out), "tree")


def differences(left: DataFrame, right: DataFrame, left_rows: DataFrame, right_rows: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``table, prefix, key, state`` of the rows in which two packages differ (CONFLICTING, LEFT_ONLY, RIGHT_ONLY), by their
    digest trees: a prefix is looked into only if the one above it differs, and rows are read of differing prefixes only."""
    within: DataFrame | None = None
    above = 0
    for digits in levels:
        one, two = (t.where(F.col("level") == digits) for t in (left, right))
        if within is not None:
            cut = F.substring("prefix", 1, above)
            keep = within.select("table", F.col("prefix").alias("_above"))
            one, two = (t.withColumn("_above", cut).join(F.broadcast(keep), ["table", "_above"], "left_semi").drop("_above") for t in (one, two))
        a, b = one.alias("a"), two.alias("b")
        joined = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.prefix") == F.col("b.prefix")), "full_outer")
        differ = joined.where(~reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "s0", "s1"))))
        within = materialize(differ.select(F.coalesce("a.table", "b.table").alias("table"), F.coalesce("a.prefix", "b.prefix").alias("prefix")), "differing")
        above = digits
    prefix = F.substring(F.sha2(F.col("key"), 256), 1, levels[-1]).alias("prefix")
    side = lambda rows, d: rows.select("table", "key", prefix, F.col("digest").alias(d)).join(F.broadcast(within), ["table", "prefix"], "left_semi")
    both = side(left_rows, "l").join(side(right_rows, "r"), ["table", "prefix", "key"], "full_outer").where(~F.col("l").eqNullSafe(F.col("r")))
    state: Column = F.when(F.col("r").isNull(), "LEFT_ONLY").when(F.col("l").isNull(), "RIGHT_ONLY").otherwise("CONFLICTING")
    return both.select("table", "prefix", "key", state.alias("state"))
