"""Vector compression by product codes, trained by Lloyd's method over heaps of slack.

A vector is cut into equal parts; each part position has a codebook, and a vector's code names the nearest entry for each
part. Training alternates between assigning all parts and moving each entry to the floor of its parts' mean.

A block of vectors is a row of a written table. For each entry it keeps a heap of the parts assigned to it, by the lower
bound of the distance to any other entry less the upper bound of the distance to its own. Moving entries eats into that
slack: by the own entry's drift and the largest drift of another. Sums of drifts are kept for each entry, and a part's key
is its slack plus the sum at the time, so that a round pops just the parts whose key the sum has reached, scans their
distances anew, exactly, and pushes them to their nearest entry's heap. All other parts can't have changed.

A round reads and writes the table of blocks once and shuffles no vectors: tasks give only what the sums and counts of
entries gain and lose, a bounded number of rows each. The codebooks, whose size the number of parts and entries bounds, are
all that the driver holds.

Rows take part whose vector is there and holds only finite numbers, with or without an id or label. Shorter vectors, and
lengths that don't divide into parts, end in zeros; components beyond 2^40 in magnitude become 2^40, errors and their sums
beyond the range of a long the largest long. The first entries are the parts of the rows of the smallest ids; rows
of equal ids are told apart by their components. Fewer rows than entries give fewer entries. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.vectors import EXACT, MOST, PACKED, blocks, extent, integral, packed, smallest_type, unpack
from chronolith.operators.lookup import look_up
from chronolith.session import materialize, prepare

#: Vectors of a block, and of a slice whose distances are worked out together.
BLOCK, SLICE = 8192, 2048
#: Distances are roots in floating point: slack within this share of the largest possible one counts as used up.
MARGIN = 1e-9
STATE = f"{PACKED}, codes binary, keys binary, members binary, sizes binary, slots array<long>, gains array<long>"
CODED = "vec_id long, label long, code string, error long"


@dataclass(frozen=True)
class Books:
    """Codebooks (part, entry, component), and for each entry the sum of what drifts have eaten since the start."""

    entries: np.ndarray
    spent: np.ndarray

    def moved(self, entries: np.ndarray) -> Books:
        drift = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(2))
        order = np.sort(drift, 1)
        others = np.where(drift == order[:, -1:], order[:, -2:-1] if drift.shape[1] > 1 else 0.0, order[:, -1:])
        tied = (drift == order[:, -1:]).sum(1, keepdims=True) > 1
        others = np.where(tied, order[:, -1:], others)
        return Books(entries, self.spent + drift + others)


def distances(parts: np.ndarray, entries: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of all parts to all entries; ``exact``: no number leaves what floating point holds. Else in whole
    numbers of any size, as objects."""
    a, b = (x.astype(np.float64 if exact else object) for x in (parts, entries))
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)


class Slack:
    """A block's heaps: for each part position and entry, ``(key, row)`` of the parts assigned to it."""

    def __init__(self, heaps: list[list[list[tuple[float, int]]]]) -> None:
        self.heaps = heaps

    @classmethod
    def empty(cls, n_parts: int, n_entries: int) -> Slack:
        return cls([[[] for _ in range(n_entries)] for _ in range(n_parts)])

    @classmethod
    def load(cls, row: dict, n_parts: int, n_entries: int) -> Slack:
        pairs = list(zip(np.frombuffer(row["keys"], np.float64).tolist(), np.frombuffer(row["members"], np.int32).tolist(), strict=True))
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32)).tolist()
        flat = [pairs[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return cls([flat[p * n_entries : (p + 1) * n_entries] for p in range(n_parts)])

    def dump(self) -> dict[str, bytes]:
        flat = [heap for part in self.heaps for heap in part]
        pairs = [x for heap in flat for x in heap]
        return {"keys": np.array([k for k, _ in pairs], np.float64).tobytes(), "members": np.array([i for _, i in pairs], np.int32).tobytes(), "sizes": np.array([len(h) for h in flat], np.int32).tobytes()}

    def pop(self, part: int, spent: np.ndarray) -> np.ndarray:
        """Rows whose slack is used up, taken off the heaps of a part position."""
        out: list[int] = []
        for heap, limit in zip(self.heaps[part], spent.tolist(), strict=True):
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def push(self, part: int, entries: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(entries, kind="stable")
        begin = np.flatnonzero(np.diff(entries[order], prepend=-1))
        for low, high in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
            own = order[low:high]
            heap, new = self.heaps[part][entries[own[0]]], list(zip(keys[own].tolist(), rows[own].tolist(), strict=True))
            if len(new) * 4 > len(heap):
                heap.extend(new)
                heapq.heapify(heap)
            else:
                for pair in new:
                    heapq.heappush(heap, pair)


def reassign(parts: np.ndarray, codes: np.ndarray, slack: Slack, books: Books, first: bool, exact: bool) -> int:
    """Give the parts (row, part, component) whose slack is used up, at first all, their nearest entry in ``codes``, the
    lowest of equally near ones; how many were scanned."""
    scanned = 0
    for p in range(parts.shape[1]):
        due = np.arange(len(parts)) if first else slack.pop(p, books.spent[p])
        scanned += len(due)
        for at in range(0, len(due), SLICE):
            rows = due[at : at + SLICE]
            square = distances(parts[rows, p], books.entries[p], exact)
            nearest = square.argmin(1)
            root = np.sqrt(np.maximum(square.astype(np.float64), 0))
            own = root[np.arange(len(rows)), nearest]
            root[np.arange(len(rows)), nearest] = np.inf
            codes[rows, p] = nearest
            slack.push(p, nearest, root.min(1) - own - MARGIN * (1 + own) + books.spent[p, nearest], rows)
    return scanned


def gained(parts: np.ndarray, before: np.ndarray | None, codes: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` (part, entry, components and count) what the entries gain and lose by new codes."""
    for p in range(parts.shape[1]):
        moved = np.arange(len(codes)) if before is None else np.flatnonzero(before[:, p] != codes[:, p])
        for sign, of in ((1, codes), (-1, before)):
            if of is not None:
                np.add.at(total[p, :, :-1], of[moved, p], sign * parts[moved, p])
                np.add.at(total[p, :, -1], of[moved, p], sign)


def compress(rows: DataFrame, n_parts: int = 4, n_entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """``CODED`` of every row that takes part, and the codebooks (part, entry, component).

    ``rows``: vec_id, embedding, label. Components are floor(scale * x); ``code`` has two hex digits for each part;
    ``error`` is the sum of squared distances of the parts to their entries.
    """
    if not 1 <= n_entries <= 256:
        raise ValueError("a code has two hex digits: there are 1 to 256 entries")
    spark = prepare(rows.sparkSession)
    vectors = materialize(integral(rows, scale), "vectors")
    n, longest, most = extent(vectors)
    size = max(1, -(-longest // n_parts))
    dim, kind = size * n_parts, smallest_type(most)
    exact = 4 * most * most * size < EXACT
    first = vectors.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "v").limit(n_entries).toArrow()
    seeds = [b[4].reshape(-1, n_parts, size) for b in blocks(first.to_batches(), n_entries, dim)]
    entries = seeds[0].transpose(1, 0, 2) if seeds else np.zeros((n_parts, 0, size), np.int64)
    if not entries.shape[1]:
        if n:
            raise ValueError("no row has an id: there is nothing to begin codebooks with")
        return spark.createDataFrame([], CODED), entries
    books = Books(entries.astype(np.int64), np.zeros(entries.shape[:2]))
    totals = np.zeros((n_parts, entries.shape[1], size + 1), np.int64)
    state = packed(vectors, BLOCK, dim, kind)
    for k in range(rounds):
        state = materialize(state.mapInArrow(stepper(spark.sparkContext.broadcast(books), k == 0, kind, exact), STATE), "codes")
        sums = state.where(F.col("slots").isNotNull()).select(F.explode(F.arrays_zip("slots", "gains")).alias("x")).groupBy(F.col("x.slots").alias("slot")).agg(F.sum("x.gains").alias("gain"))
        found = sums.toArrow()  # at most a number for each component of the codebooks
        totals.reshape(-1)[found.column("slot").to_numpy()] += found.column("gain").to_numpy()
        count = totals[:, :, -1:]
        books = books.moved(np.where(count > 0, totals[:, :, :-1] // np.maximum(count, 1), books.entries))
        state = state.where(F.col("slots").isNull())
    coded = state.mapInArrow(coder(spark.sparkContext.broadcast(books), rounds == 0, kind, exact), CODED)
    return coded, books.entries


def opened(row: dict, books: Books, first: bool, kind: str) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray | None, np.ndarray, Slack]:
    """A block's columns, its parts, the codes before (none at first), codes to change, and heaps."""
    n_parts, n_entries, size = books.entries.shape
    columns = unpack(row, n_parts * size, kind)
    parts = columns[4].reshape(-1, n_parts, size).astype(np.int64)
    if first:
        return columns, parts, None, np.zeros((len(parts), n_parts), np.uint8), Slack.empty(n_parts, n_entries)
    before = np.frombuffer(row["codes"], np.uint8).reshape(-1, n_parts)
    return columns, parts, before, before.copy(), Slack.load(row, n_parts, n_entries)


def stepper(shared, first: bool, kind: str, exact: bool):
    """A round over a task's blocks: their new codes and heaps, and one row of what entries gained."""
    schema = pa.schema([("n", pa.int32()), ("top", pa.float64()), *((c, pa.binary()) for c in ("ids", "unnamed", "labels", "unlabelled", "vectors", "codes", "keys", "members", "sizes")), ("slots", pa.list_(pa.int64())), ("gains", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        n_parts, n_entries, size = books.entries.shape
        total = np.zeros((n_parts, n_entries, size + 1), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                _, parts, before, codes, slack = opened(row, books, first, kind)
                reassign(parts, codes, slack, books, first, exact)
                gained(parts, before, codes, total)
                yield pa.RecordBatch.from_pylist([row | {"codes": codes.tobytes(), **slack.dump(), "slots": None, "gains": None}], schema)
        flat = total.reshape(-1)
        slots = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pylist([{"slots": slots.tolist(), "gains": flat[slots].tolist()}], schema)

    return run


def coder(shared, first: bool, kind: str, exact: bool):
    """The last assignment: a row for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        own = np.arange(books.entries.shape[0])
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                (ids, unnamed, labels, unlabelled, _), parts, _, codes, slack = opened(row, books, first, kind)
                reassign(parts, codes, slack, books, first, exact)
                off = parts.astype(np.int64 if exact else object) - books.entries[own, codes]
                error = (off * off).sum((1, 2))
                named = lambda v, none: pa.array(v, pa.int64(), mask=none)
                yield pa.record_batch({"vec_id": named(ids, unnamed), "label": named(labels, unlabelled), "code": [c.tobytes().hex() for c in codes], "error": np.minimum(error, MOST).astype(np.int64)})

    return run


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``CODED`` with ``label_error``: errors summed over all rows of the same label, those without one together. Labels of
    very many rows are summed before the shuffle and answered by a broadcast of bounded size."""
    keyed = materialize(coded.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0))}), "coded")
    sums = materialize(keyed.groupBy("_none", "_label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error")), "errors")
    return look_up(keyed, sums, ["_none", "_label"]).drop("_none", "_label")


def digest(entries: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
