"""Operators that add columns to every row: one pass over the table, each row carried along whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronolith.session import prepare


#: Bytes of text that an operator works on at a time.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about ``size`` bytes of ``text`` each: they bound what a task holds at a time."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    home = (np.cumsum(lengths) - lengths) // size
    begin = np.flatnonzero(np.diff(home, prepend=-1))
    for low, high in zip(begin.tolist(), [*begin[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(low, high - low)


def annotate(rows: DataFrame, compute: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str, size: int = SLICE_BYTES, given: tuple[str, ...] = ()) -> DataFrame:
    """``(row, ...)``: every row of ``rows`` as a struct, beside the columns that ``compute`` gives for runs of rows.

    The row's own columns stay inside ``row``, so none of their names can clash with an input or an output. With
    ``given``, ``rows`` are annotated rows, of which ``compute`` gets those columns as well.
    """
    prepare(rows.sparkSession)
    added = T.StructType.fromDDL(schema)
    out = T.StructType([rows.schema["row"] if given else T.StructField("row", rows.schema), *added.fields])
    names = [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size) if batch.num_rows else ():
                found = compute(part)
                yield pa.record_batch([part.column("row"), *(found[n] for n in names)], ["row", *names])

    if given:
        return rows.select("row", F.col("row.text").alias("text"), *given).mapInArrow(run, out)
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")
    return rows.select(whole, "text").mapInArrow(run, out)


def arrow_type(rows: DataFrame, column: str) -> pa.DataType:
    """The Arrow type of a column, whatever its type."""
    return to_arrow_type(rows.schema[column].dataType)


def unwrap(annotated: DataFrame) -> DataFrame:
    """The rows themselves, with their own columns."""
    return annotated.select("row.*")


#: Rows from which a key is answered by a broadcast, and the most keys that can be.
HOT_ROWS, HOT_KEYS = 256, 1 << 20


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``table``, in which ``key`` is unique.

    Keys that stand on many rows do not meet in one task: they are at most ``HOT_KEYS``, since each has more than a
    ``HOT_KEYS``-th of the rows, and their answers are broadcast. Both tables are read several times, so they should be
    written ones.
    """
    most = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key)
    often = rows.join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key)
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(table, key)
    return often.unionByName(rest)
