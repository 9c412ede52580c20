"""Vectors of whole numbers: which rows take part, and packed blocks of them for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers up to here are exact in floating point.
EXACT = 1 << 53
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Components beyond this magnitude become it, so that sums of millions of them are longs.
LARGEST = 1 << 40
PACKED = "n int, top double, ids binary, unnamed binary, labels binary, unlabelled binary, vectors binary"


def integral(rows: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, label, v)`` of the rows whose ``embedding`` is there and holds only finite numbers; ``v`` is
    floor(scale * x) of each component x, as longs (at most ``LARGEST`` in magnitude)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(LARGEST)), F.lit(-LARGEST)))
    kept = rows.where(F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def extent(vectors: DataFrame) -> tuple[int, int, int]:
    """Rows, most components of a row, and the largest magnitude of a component."""
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    found = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(size)).first()
    return int(found[0]), int(found[1] or 0), int(found[2] or 0)


def smallest_type(most: int) -> str:
    """The smallest type that holds all components."""
    return next((t for t in ("i2", "i4") if most <= np.iinfo(t).max), "i8")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of ``dim`` numbers; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 for null, and which are null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def blocks(batches: Iterator[pa.RecordBatch], most: int, dim: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows ``vec_id, label, v`` in their order, by at most ``most``: ids, which have none, labels, which have none,
    vectors."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        ids, unnamed = longs(batch.column("vec_id"))
        labels, unlabelled = longs(batch.column("label"))
        own = (ids, unnamed, labels, unlabelled, matrix(batch.column("v"), dim))
        at = 0
        while at < batch.num_rows:
            part = tuple(x[at : at + most - n] for x in own)
            held.append(part)
            n += len(part[0])
            at += len(part[0])
            if n == most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def packed(vectors: DataFrame, most: int, dim: int, kind: str) -> DataFrame:
    """Blocks of at most ``most`` rows, in each partition's order, one row of ``PACKED`` each; ``top`` is the largest norm."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, unnamed, labels, unlabelled, v in blocks(batches, most, dim):
            top = float(np.sqrt((v.astype(np.float64) ** 2).sum(1)).max())
            row = {"n": len(ids), "top": top, "ids": ids.tobytes(), "unnamed": unnamed.tobytes(), "labels": labels.tobytes(), "unlabelled": unlabelled.tobytes(), "vectors": v.astype(kind).tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("n", pa.int32()), ("top", pa.float64()), *((c, pa.binary()) for c in list(row)[2:])]))

    return vectors.select("vec_id", "label", "v").mapInArrow(pack, PACKED)


def unpack(row: dict, dim: int, kind: str) -> tuple[np.ndarray, ...]:
    """Ids, which have none, labels, which have none, and vectors of a packed block."""
    plain = lambda c, t: np.frombuffer(row[c], t)
    return plain("ids", np.int64), plain("unnamed", bool), plain("labels", np.int64), plain("unlabelled", bool), plain("vectors", kind).reshape(row["n"], dim)


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of all rows of ``a`` and ``b`` as longs; ``exact``: no sum leaves ``EXACT``. Else they are worked out
    in whole numbers of any size, and those beyond a long's range become the nearest long."""
    if exact:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)
