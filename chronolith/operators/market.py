"""The daily state of a market, by sweeping over interval bounds.

An episode is open from its first day up to, not including, the day on which it was seen closed. What is open on a day is
what has begun less what has ended, so each interval gives two events, however long it is, and days are running sums: no
interval is spread over its days. Episodes are first counted by group, first and last day, where they lie, so what is
shuffled is bounded by the calendar and the number of groups, not by the episodes. A group is a level of grouping (some of
the dimensions) with their values; every group that has an episode at all has a row for every day of the calendar.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.session import materialize

#: The last day of an episode that is still open.
NEVER = "9999-12-31"


def recency() -> Column:
    """What adverts are ordered by: when the source published them, else when they were first seen."""
    return F.coalesce(F.col("source_published_at"), F.col("first_seen_at"))


def cells(rows: DataFrame, levels: list[list[str]], by: list[str], measures: dict[str, Column]) -> DataFrame:
    """``level``, all dimensions (null where the level has them not), ``by`` and sums of ``measures`` at every level in
    one pass; ``group`` names level and values, so that null values are values like any other."""
    dims = list(dict.fromkeys(d for level in levels for d in level))
    sets = [[F.col(c) for c in [*level, *by]] for level in levels]
    sums = {n: F.sum(m).alias(n) for n, m in measures.items()}
    grouped = rows.groupingSets(sets, *dims, *by).agg(F.grouping_id().alias("_id"), *sums.values())
    # The number's bits tell, first dimension first, which columns a level leaves out.
    held = [F.when(F.col("_id").bitwiseAND(F.lit(1 << (len(dims) + len(by) - 1 - k))) == 0, F.lit(d)) for k, d in enumerate(dims)]
    level = F.array_join(F.array(*held), ",") if dims else F.lit("")
    values = F.to_json(F.struct(level.alias("level"), *(F.col(d).cast("string").alias(d) for d in dims)), {"ignoreNullFields": "false"})
    return grouped.select(values.alias("group"), level.alias("level"), *dims, *by, *sums)


def sweep(counted: DataFrame, calendar: tuple[str, str], measures: list[str]) -> DataFrame:
    """``group, state_date`` and, of each measure, the sum over intervals that hold the day. ``counted``: group,
    opened_on, closed_on (exclusive), measures."""
    start, end = (F.lit(d).cast("date") for d in calendar)
    near = counted.where((F.col("opened_on") <= end) & (F.col("closed_on") > start) & (F.col("closed_on") > F.col("opened_on")))
    begin = near.select("group", F.greatest("opened_on", start).alias("state_date"), *(F.col(m).alias(m) for m in measures))
    finish = near.where(F.col("closed_on") <= end).select("group", F.col("closed_on").alias("state_date"), *((-F.col(m)).alias(m) for m in measures))
    events = begin.unionByName(finish).groupBy("group", "state_date").agg(*(F.sum(m).alias(m) for m in measures))
    days = counted.select("group").distinct().withColumn("state_date", F.explode(F.sequence(start, end)))
    so_far = Window.partitionBy("group").orderBy("state_date")
    joined = days.join(events, ["group", "state_date"], "left")
    return joined.select("group", "state_date", *(F.sum(F.coalesce(F.col(m), F.lit(0))).over(so_far).alias(m) for m in measures))


def merged_intervals(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The union of each key's intervals, as intervals that don't overlap: ``keys, opened_on, closed_on``."""
    before = Window.partitionBy(*keys).orderBy("opened_on", "closed_on").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("opened_on") > F.max("closed_on").over(before), 1).otherwise(0)
    island = F.sum("_fresh").over(Window.partitionBy(*keys).orderBy("opened_on", "closed_on").rowsBetween(Window.unboundedPreceding, 0))
    marked = counted.withColumn("_fresh", fresh).withColumn("_island", island)
    return marked.groupBy(*keys, "_island").agg(F.min("opened_on").alias("opened_on"), F.max("closed_on").alias("closed_on")).drop("_island")


def median_age(counted: DataFrame, calendar: tuple[str, str], weight: str) -> DataFrame:
    """``group, state_date, median_days``: the median of the days that the open episodes have been so; null without any.

    A group's counts by first and last day are its histogram: they add up, and the calendar bounds them. Days are swept in
    order, with the counts of first days kept up to date.
    """
    first, last = np.datetime64(calendar[0], "D").astype(int), np.datetime64(calendar[1], "D").astype(int)

    def medians(key: tuple, cells: pa.Table) -> pa.Table:
        opened, closed = (cells.column(c).cast(pa.int32()).to_numpy().astype(np.int64) for c in ("opened_on", "closed_on"))
        n = cells.column(weight).to_numpy()
        near = (opened <= last) & (closed > first) & (closed > opened)
        opened, closed, n = opened[near], closed[near], n[near]
        days, cohort = np.unique(opened, return_inverse=True)
        at = np.concatenate([np.maximum(opened, first), closed])
        order = np.argsort(at, kind="stable")
        at, cohort, change = at[order], np.concatenate([cohort, cohort])[order], np.concatenate([n, -n])[order]
        cut = np.searchsorted(at, np.arange(first, last + 2))
        held, out = np.zeros(len(days), np.int64), []
        for k, day in enumerate(range(first, last + 1)):
            np.add.at(held, cohort[cut[k] : cut[k + 1]], change[cut[k] : cut[k + 1]])
            so_far = np.cumsum(held)
            total = int(so_far[-1]) if len(so_far) else 0
            low, high = ((total - 1) // 2, total // 2) if total else (0, 0)
            out.append(day - (int(days[np.searchsorted(so_far, low, "right")]) + int(days[np.searchsorted(so_far, high, "right")])) / 2 if total else None)
        dates = pa.array(np.arange(first, last + 1, dtype=np.int32)).cast(pa.date32())
        return pa.table({"group": pa.array([key[0].as_py()] * len(out), pa.string()), "state_date": dates, "median_days": pa.array(out, pa.float64())})

    return counted.select("group", "opened_on", "closed_on", weight).groupBy("group").applyInArrow(medians, "group string, state_date date, median_days double")


def daily_state(episodes: DataFrame, levels: list[list[str]], calendar: tuple[str, str], postings: DataFrame | None = None) -> DataFrame:
    """The market on every day of the calendar (both ends included), at every level of grouping.

    ``episodes``: a row for each episode of a vacancy, with ``episode_number``, ``opened_on``, ``closed_on`` (null: open),
    ``positions_count`` (null: unknown), ``employer`` (null or empty: unknown), ``is_agency, is_public_direct,
    is_entry_accessible, is_apprenticeship`` (null: not classified) and the levels' dimensions. ``postings``: opened_on,
    closed_on and dimensions of single adverts. An episode that closes on its first day or before is open on none, but
    counted as new and as disappeared. Shares are null on days without an active vacancy (the entry share: without a
    classified one).
    """
    first = F.col("episode_number") == 1
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    rows = episodes.withColumn("closed_on", F.coalesce("closed_on", F.lit(NEVER).cast("date")))
    known = F.col("employer").isNotNull() & (F.length(F.col("employer").cast("string")) > 0)
    measures = {
        "active_unique_vacancies": F.lit(1).cast("long"),
        "estimated_positions": F.coalesce(F.col("positions_count").cast("long"), F.lit(0).cast("long")),
        "positions_known": one(F.col("positions_count").isNotNull()),
        "_reposted": one(~first),
        "_direct": one(F.col("is_public_direct")),
        "_agency": one(F.col("is_agency")),
        "_entry": one(F.col("is_entry_accessible")),
        "_entry_known": one(F.col("is_entry_accessible").isNotNull()),
        "_apprentice": one(F.col("is_apprenticeship")),
    }
    counted = materialize(cells(rows, levels, ["opened_on", "closed_on"], measures | {"_first": one(first)}), "cells")
    state = sweep(counted, calendar, list(measures))
    begun = counted.groupBy("group", F.col("opened_on").alias("state_date")).agg(F.sum("_first").alias("new_vacancies"), F.sum("_reposted").alias("reappeared_vacancies"))
    ended = counted.groupBy("group", F.col("closed_on").alias("state_date")).agg(F.sum("active_unique_vacancies").alias("disappeared_vacancies"))
    out = [state, begun, ended, median_age(counted, calendar, "active_unique_vacancies").withColumnRenamed("median_days", "median_days_online")]
    for name, some in (("unique_employers", known), ("unique_agencies", known & F.col("is_agency"))):
        own = cells(rows.where(some & (F.col("closed_on") > F.col("opened_on"))), levels, ["employer", "opened_on", "closed_on"], {name: F.lit(1)})
        apart = merged_intervals(own, ["group", "employer"]).groupBy("group", "opened_on", "closed_on").agg(F.count("*").alias(name))
        out.append(sweep(apart, calendar, [name]))
    if postings is not None:
        seen = postings.withColumn("closed_on", F.coalesce("closed_on", F.lit(NEVER).cast("date")))
        out.append(sweep(cells(seen, levels, ["opened_on", "closed_on"], {"active_postings": F.lit(1).cast("long")}), calendar, ["active_postings"]))
    joined = reduce(lambda a, b: a.join(b, ["group", "state_date"], "left"), out)
    dims = list(dict.fromkeys(d for level in levels for d in level))
    named = counted.select("group", "level", *dims).distinct()
    share = lambda part, whole: F.bround(F.try_divide(F.col(part), F.col(whole)), 6)
    zero = ["new_vacancies", "reappeared_vacancies", "disappeared_vacancies", "unique_employers", "unique_agencies", *(["active_postings"] if postings is not None else [])]
    ratios = {"public_direct_share": "_direct", "agency_share": "_agency", "apprenticeship_share": "_apprentice", "repost_rate": "_reposted"}
    told = joined.withColumns({z: F.coalesce(z, F.lit(0).cast("long")) for z in zero} | {n: share(c, "active_unique_vacancies") for n, c in ratios.items()} | {"entry_accessible_share": share("_entry", "_entry_known")})
    return named.join(told, "group").drop("group", *(c for c in told.columns if c.startswith("_")))
