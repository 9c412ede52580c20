"""Point-in-time selection: what was known about each key at a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, keys: list[str], order: list[Column], known: Column | None = None) -> DataFrame:
    """The first row of each key in ``order`` among the rows that were ``known``.

    Ranks of one are a group limit to Spark: each task keeps a row a key before anything is shuffled.
    """
    rows = rows if known is None else rows.where(known)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_at(rows: DataFrame, keys: list[str], moment: str, ties: list[str], cutoffs: dict[str, Column], columns: list[str]) -> DataFrame:
    """``as_of``, the keys and ``columns`` of each key's latest row at each of several cutoffs, in one pass: a task keeps
    a row for each key and cutoff."""
    by, row = F.struct(moment, *ties), F.struct(*columns)
    found = rows.groupBy(*keys).agg(*(F.max_by(row, F.when(F.col(moment) <= cutoff, by)).alias(f"_{k}") for k, cutoff in enumerate(cutoffs.values())))
    each = F.array(*(F.struct(F.lit(name).alias("as_of"), F.col(f"_{k}").alias("_row")) for k, name in enumerate(cutoffs)))
    return found.select(*keys, F.inline(each)).where("_row IS NOT NULL").select("as_of", *keys, *(F.col(f"_row.{c}").alias(c) for c in columns))


def posting_states(observations: DataFrame, events: DataFrame, as_of: Column, key: str = "posting_id") -> DataFrame:
    """Each posting's latest active content and, independently, its latest life-cycle state at a cutoff.

    ``observations``: key, observation_id, observed_at, observation_status, ...; ``events``: key, event_id,
    event_type, observed_at, created_at. Bounds are inclusive; without an event the state is ACTIVE_OBSERVED.
    """
    content = latest_by_key(observations, [key], [F.desc("observed_at"), F.desc("observation_id")], (F.col("observed_at") <= as_of) & (F.col("observation_status") == "ACTIVE"))
    state = latest_by_key(events, [key], [F.desc("observed_at"), F.desc("created_at"), F.desc("event_id")], F.col("observed_at") <= as_of)
    state = state.select(key, F.col("event_type").alias("_state"), F.col("event_id").alias("lifecycle_event_id"))
    return content.join(state, key, "left").withColumn("lifecycle_state", F.coalesce("_state", F.lit("ACTIVE_OBSERVED"))).drop("_state")


def known_profiles(observations: DataFrame, profiles: DataFrame, as_of: Column, keys: list[str]) -> DataFrame:
    """Every profile available at the cutoff of each observation's source, identity and employer, as a sorted array."""
    known = profiles.where(F.col("available_at") <= as_of)
    gathered = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("available_at", "profile_id", "evidence_text"))).alias("profiles"))
    return observations.join(gathered, keys, "left")


def first_after(rows: DataFrame, bound: DataFrame, key: str, moment: str, at: str, columns: list[str]) -> DataFrame:
    """For each key, the first row strictly after the key's bound."""
    joined = rows.join(bound, key).where(F.col(moment) > F.col(at))
    first = F.min_by(F.struct(*columns), F.struct(moment, *columns)).alias("first")
    return joined.groupBy(key).agg(first).select(key, "first.*")
