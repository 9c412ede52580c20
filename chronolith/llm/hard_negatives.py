"""Hard-negative mining: exact search over buckets of candidates in order of norm.

Candidates are sorted by norm, by ranges over the cluster, and cut into buckets that know their largest norm. An anchor's
inner product with any row of a bucket is at most the product of the norms (Cauchy-Schwarz), so an anchor skips a bucket
whose bound lies under the lower limit of each of its windows, or under the score that the window's last place has so
far. Buckets are dealt to tasks in turn, so every task meets long vectors first and its running limits rise early.

Anchors are asked in blocks of bounded size: a block is broadcast, every task answers it from its own buckets, and the
few best of each task are ranked together. Neither side is ever held whole; all pairs of an anchor and a candidate that a
bound does not rule out are looked at, since that is what an exact search among all rows takes.

Rows that take part have an id, a label and a vector of finite numbers. Ids may repeat: a row with the anchor's own id is
never its positive, other repeated rows count one by one, and each row that is an anchor is answered. Shorter vectors end
in zeros. Components beyond 2^40 in magnitude become 2^40, scores beyond the range of a long the nearest long. Ties go to the smaller id. An empty table, or one
without anchors, gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.vectors import EXACT, LEAST, MOST, extent, integral, packed, products, smallest_type, unpack
from chronolith.session import materialize, prepare, shared_folder

#: Rows of a bucket; anchors that are multiplied with a bucket at a time; anchors of a broadcast block, by bytes of their vectors.
BUCKET, SLICE, BLOCK_BYTES = 1024, 256, 2 << 20
#: Buckets of a task at least, and tasks at most: each task gives some rows for each anchor.
TASK_BUCKETS, TASKS = 8, 4096
#: Bounds of norms are computed in floating point: what is within this share of them is looked at.
SLACK = 1e-9
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Best:
    """The ``k`` best rows of each of some windows: by score, ties by smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.scores, self.ids = np.full((n, k), LEAST), np.full((n, k), MOST)

    def beats(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which rows come before the last one that a window has so far."""
        last = self.scores[at, -1]
        return (scores > last) | (scores == last) & (ids < self.ids[at, -1])

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        k = self.scores.shape[1]
        own = np.unique(at)
        rows = np.concatenate([np.repeat(own, k), at])
        scores, ids = np.concatenate([self.scores[own].ravel(), scores]), np.concatenate([self.ids[own].ravel(), ids])
        order = np.lexsort((ids, ~scores, rows))  # ~x falls as x rises, without overflow
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < k
        self.scores[rows[best], place[best]], self.ids[rows[best], place[best]] = scores[order][best], ids[order][best]


class Block:
    """Anchors of a block, and the windows of scores that are asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1)) * (1 + SLACK)


def scan(block: Block, low: np.ndarray, high: np.ndarray, k: int, same: bool, buckets: Iterator[tuple], exact: bool) -> tuple[Best, int]:
    """The ``k`` best of each window (an anchor's row, a place) among the buckets' rows of the anchor's label (``same``, but
    for its own id) or of other labels; and how many pairs of an anchor and a bucket were looked at."""
    n, places = low.shape
    best = [Best(n, k) for _ in range(places)]
    looked = 0
    for top, ids, labels, vectors in buckets:
        # What a row must reach to matter to an anchor: the least of its windows' limits, lower ones and running ones.
        limit = np.min([np.maximum(low[:, j], best[j].scores[:, -1]) for j in range(places)], axis=0)
        near = np.flatnonzero(block.norms * (top * (1 + SLACK)) >= limit)
        looked += len(near)
        for at in range(0, len(near), SLICE):
            some = near[at : at + SLICE]
            scores = products(block.vectors[some], vectors, exact)
            alike = block.labels[some][:, None] == labels
            fits = alike & (block.ids[some][:, None] != ids) if same else ~alike
            r, c = np.nonzero(fits & (scores >= limit[some][:, None]))
            a, s, i = some[r], scores[r, c], ids[c]
            for j in range(places):
                own = (s >= low[a, j]) & (s <= high[a, j]) & best[j].beats(a, s, i)
                best[j].add(a[own], s[own], i[own])
    return best, looked


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256) -> DataFrame:
    """``MINED``: for each anchor, its ``n_positives`` best rows of the same label and, for each of those, the
    ``n_negatives`` best rows of other labels whose score is within ``window`` hundredths of the positive's.

    ``rows``: vec_id, embedding, label. ``is_anchor`` is a condition on them. A score is the inner product of components
    floor(scale * x).
    """
    spark = prepare(rows.sparkSession)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    kept = integral(rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()), scale).withColumn("norm", norm)
    vectors = materialize(kept, "vectors")
    n, dim, most = extent(vectors)
    kind, exact = smallest_type(most), most * most * max(dim, 1) < EXACT
    sorted_by = [F.desc("norm"), F.asc("vec_id")]
    ranges = max(1, n // (BUCKET * TASK_BUCKETS))
    buckets = materialize(packed(vectors.repartitionByRange(ranges, *sorted_by).sortWithinPartitions(*sorted_by), BUCKET, dim, kind), "buckets")
    tasks = max(1, min(TASKS, -(-n // (BUCKET * TASK_BUCKETS))))
    dealt = materialize(buckets.repartition(tasks).sortWithinPartitions(F.desc("top")), "dealt")
    anchors = vectors.where(is_anchor)
    asked = materialize(packed(anchors.repartitionByRange(max(1, n // (1 << 20)), *sorted_by).sortWithinPartitions(*sorted_by), BUCKET, dim, kind), "anchors")
    path = f"{shared_folder(spark).rstrip('/')}/mined-{uuid.uuid4().hex}"
    spark.createDataFrame([], MINED).write.parquet(path)
    for block in gathered(asked.toLocalIterator(), dim, kind):
        answer(dealt, block, n_positives, n_negatives, window, dim, kind, exact).write.mode("append").parquet(path)
    return spark.read.schema(MINED).parquet(path)


def gathered(rows: Iterator, dim: int, kind: str) -> Iterator[Block]:
    """Packed anchors in blocks of about ``BLOCK_BYTES``; the iterator holds one partition of the table at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    join = lambda parts: Block(*(np.concatenate([p[k] for p in parts]) for k in (0, 2, 4)))
    for row in rows:
        held.append(unpack(row.asDict(), dim, kind))
        size += len(row.vectors) + len(row.ids)
        if size >= BLOCK_BYTES:
            yield join(held)
            held, size = [], 0
    if held:
        yield join(held)


def answer(dealt: DataFrame, block: Block, n_positives: int, n_negatives: int, window: tuple[int, int], dim: int, kind: str, exact: bool) -> DataFrame:
    """A block's rows of ``MINED``, from all buckets."""
    spark = dealt.sparkSession
    n = len(block.ids)
    any_score = np.full((n, 1), LEAST), np.full((n, 1), MOST)
    found = ranked(dealt.mapInArrow(searcher(spark.sparkContext.broadcast((block, *any_score)), n_positives, True, dim, kind, exact), FOUND), n_positives).toArrow()
    at, place, ids, scores = (found.column(c).to_numpy() for c in ("anchor", "rank", "vec_id", "score"))  # n_positives for each anchor
    positives, score = np.zeros((n, n_positives), np.int64), np.zeros((n, n_positives), np.int64)
    low, high = np.full((n, n_positives), MOST), np.full((n, n_positives), LEAST)  # a window that holds nothing
    positives[at, place - 1], score[at, place - 1] = ids, scores
    limits = [(-(-window[0] * s // 100), window[1] * s // 100) if s >= 0 else (MOST, LEAST) for s in scores.tolist()]
    if limits:
        low[at, place - 1], high[at, place - 1] = np.array([x for x, _ in limits]), np.array([x for _, x in limits])
    shared = spark.sparkContext.broadcast((block, low, high))
    # No anchor wants a bucket whose bound is under all lower limits: the scan leaves such buckets out.
    reach = np.divide(low.min(1), block.norms, out=np.where(low.min(1) <= 0, -1.0, np.inf), where=block.norms > 0).min(initial=np.inf) * (1 - 3 * SLACK)
    near = dealt if reach <= 0 else dealt.where(F.col("top") >= float(reach))
    best = ranked(near.mapInArrow(searcher(shared, n_negatives, False, dim, kind, exact), FOUND), n_negatives)
    windows = pa.table({"anchor": np.repeat(np.arange(n, dtype=np.int32), n_positives), "place": np.tile(np.arange(n_positives, dtype=np.int32), n), "anchor_id": np.repeat(block.ids, n_positives), "positive_id": positives.ravel(), "positive_score": score.ravel()})
    named = best.join(F.broadcast(spark.createDataFrame(windows)), ["anchor", "place"])  # a block of anchors: bounded
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


FOUND = "anchor int, place int, vec_id long, score long"


def searcher(shared, k: int, same: bool, dim: int, kind: str, exact: bool) -> Callable:
    """A task's answer to a block of anchors: the best of its own buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, high = shared.value
        buckets = ((row["top"], *(x for k, x in enumerate(unpack(row, dim, kind)) if k in (0, 2, 4))) for batch in batches for row in batch.to_pylist())
        best, _ = scan(block, low, high, k, same, buckets, exact)
        for j, own in enumerate(best):
            at, place = np.nonzero((own.scores != LEAST) | (own.ids != MOST))
            if len(at):
                yield pa.record_batch({"anchor": at.astype(np.int32), "place": np.full(len(at), j, np.int32), "vec_id": own.ids[at, place], "score": own.scores[at, place]})

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each window over all tasks, with their ``rank`` from 1."""
    by = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
