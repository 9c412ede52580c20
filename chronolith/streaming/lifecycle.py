"""Extension: the life-cycle state machine over a stream of presence rows.

State is kept by key with Structured Streaming. A key's rows must arrive in the order of their times, as scans of a
source do; a row older than the key's last one is late and is dropped. The 48-hour rule is judged at the next scan,
so no timer is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolith.operators.lifecycle import CLOSE_AFTER_SECONDS

OUT = "key string, ts timestamp, event string"
STATE = "last timestamp, first_negative timestamp, negatives int, closed boolean"


def fold(rows: list[tuple[pd.Timestamp, bool]], state: tuple | None) -> tuple[list[tuple[pd.Timestamp, str]], tuple | None]:
    """Events of one key's rows in order, after a state ``(last, first negative, negatives, closed)``."""
    events = []
    for moment, present in rows:
        if state is not None and moment < state[0]:
            continue
        if present:
            events.append((moment, "STILL_ACTIVE" if state else "NEW"))
            state = (moment, None, 0, False)
        elif state is not None:
            last, first, negatives, closed = state
            first = moment if first is None else first
            if not closed:
                closed = negatives >= 1 and (moment - first).total_seconds() >= CLOSE_AFTER_SECONDS
                events.append((moment, "CLOSED_OBSERVED" if closed else "DISAPPEARED_PENDING"))
            state = (moment, first, negatives + 1, closed)
    return events, state


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = sorted((r for frame in frames for r in zip(frame["ts"], frame["present"], strict=True)), key=lambda r: r[0])
    known = None
    if state.exists:
        last, first, negatives, closed = state.get
        known = (pd.Timestamp(last), None if first is None or pd.isna(first) else pd.Timestamp(first), negatives, closed)
    events, known = fold(rows, known)
    if known is not None:
        state.update((known[0].to_pydatetime(), None if known[1] is None else known[1].to_pydatetime(), known[2], known[3]))
    yield pd.DataFrame({"key": [key[0]] * len(events), "ts": [m for m, _ in events], "event": [e for _, e in events]})


def lifecycle_stream(rows: DataFrame) -> DataFrame:
    """Events of a stream of ``key, ts, present``."""
    return rows.select("key", "ts", "present").groupBy("key").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def activity_windows(rows: DataFrame, width: str, lateness: str) -> DataFrame:
    """Presence and absence counted in event-time windows; rows later than ``lateness`` are dropped."""
    late = rows.withWatermark("ts", lateness)
    return late.groupBy(F.window("ts", width)).agg(F.count_if("present").alias("present"), F.count_if(~F.col("present")).alias("absent"))


def once(rows: DataFrame, lateness: str) -> DataFrame:
    """Rows of a stream without those that repeat an ``event_key`` within ``lateness``."""
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_key"])


def by_scan(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand a stream over scan by scan: each micro-batch goes to ``write`` with its number, which a restart repeats for a
    batch that was not finished, so that ``write`` can tell what it has written."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
