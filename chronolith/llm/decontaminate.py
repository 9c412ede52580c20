"""Benchmark decontamination by winnowing.

A benchmark item of ``WINDOW`` words or more is fingerprinted by the least hash of each ``SPAN`` consecutive
``GRAM``-word hashes, with ``GRAM + SPAN - 1 = WINDOW``: two texts that share ``WINDOW`` consecutive words share a
run of ``SPAN`` grams, hence that run's least hash, so every such span is found. Document fingerprints are joined
with the benchmark's on the map side. All windows under a shared fingerprint, however often its gram recurs, are looked
up among the benchmark's windows and compared word by word. Shorter items are looked up whole.

The benchmark is a stated query set: it is held in blocks of ``BLOCK_BYTES``. ``AT_ONCE`` blocks are broadcast and
looked up in one pass over the documents; a larger benchmark takes several passes, each of which writes its finds beside
the documents, so that neither driver nor executors ever hold more. Documents are never shuffled.

Edge cases: a null text has no words, so it hits nothing and, as an item, never occurs; repeated items count once
by id; items without an id hit, and together count as one item that the digest does not name; repeated documents give a row each; without items nothing is hit; an empty table gives no rows; other
columns are carried along or ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.rows import annotate, unwrap
from chronolith.llm.text import ALNUM, hash_spans, mix, raw_texts, words
from chronolith.session import materialize, prepare

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
BLOCK_BYTES, AT_ONCE = 32 << 20, 2
#: Windows that are compared word by word at a time.
VERIFIED = 1 << 15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(word_hashes: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of ``size`` words, or of those that begin at ``at``."""
    n = max(0, len(word_hashes) - size + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n if at is None else len(at), np.uint64)
        for k in range(size):
            total = total * _STEP + (word_hashes[k : k + n] if at is None else word_hashes[at + k])
        return np.minimum(mix(total), _NONE - np.uint64(1))


def whole(owner: np.ndarray, size: int) -> np.ndarray:
    """Whether each run of ``size`` words lies within one text."""
    return owner[: max(0, len(owner) - size + 1)] == owner[size - 1 :]


def window_minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each ``SPAN`` consecutive hashes."""
    n = len(hashes) - SPAN + 1
    return np.lib.stride_tricks.sliding_window_view(hashes, SPAN).min(1) if n > 0 else np.zeros(0, np.uint64)


class Benchmark:
    """One block of items: their words, the fingerprints of the long ones, and the places of all windows by hash."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        found = self.found = words([text for _, text in rows], ALNUM)
        self.ids = [item for item, _ in rows]
        self.hashed = hash_spans(found.data, found.start, found.end)
        owner = np.repeat(np.arange(len(rows)), found.per_document)
        sizes = np.minimum(found.per_document, WINDOW)
        self.prints = np.unique(window_minima(gram_hashes(self.hashed, GRAM))[whole(owner, WINDOW)])
        self.tables = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            place = np.flatnonzero(whole(owner, size) & (sizes[owner[: max(0, len(owner) - size + 1)]] == size))
            key, item = gram_hashes(self.hashed, size, place), owner[place]
            order = np.lexsort((item, key))
            key, item, place = key[order], item[order], place[order]
            # An item that repeats a window has it once.
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
            self.tables[size] = key[once], item[once], place[once]

    @property
    def words(self) -> list[list[bytes]]:
        found = self.found
        spelled = [found.data[a:b].tobytes() for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]
        return [spelled[a:b] for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)]


def among(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``sorted_keys``."""
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


def candidates(hashed: np.ndarray, owner: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """All windows whose least gram hash is a fingerprint. A run of windows with one least hash is looked up once."""
    least = window_minima(gram_hashes(hashed, GRAM))
    begin = np.flatnonzero(np.diff(least, prepend=_NONE))
    known = np.repeat(among(prints, least[begin]), np.diff(begin, append=len(least)))
    return np.flatnonzero(known & whole(owner, WINDOW))


def same_words(found, at: np.ndarray, bench: Benchmark, place: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from each of ``at`` are those from ``place``, byte by byte."""
    theirs = bench.found
    out = np.ones(len(at), bool)
    for k in range(size):
        a, b = found.start[at + k], theirs.start[place + k]
        length = found.end[at + k] - a
        out &= length == theirs.end[place + k] - b
        rows = np.flatnonzero(out)
        if not len(rows):
            break
        length = length[rows]
        begin = np.cumsum(length) - length
        inner = np.arange(length.sum()) - np.repeat(begin, length)
        equal = found.data[np.repeat(a[rows], length) + inner] == theirs.data[np.repeat(b[rows], length) + inner]
        out[rows] = np.logical_and.reduceat(equal, begin)
    return out


def hits(found, hashed: np.ndarray, owner: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, set[tuple[int, int]]]:
    """Which words of a batch are hit, and the (document, item) pairs."""
    hit = np.zeros(len(hashed), bool)
    pairs: set[tuple[int, int]] = set()
    for size, (keys, items, places) in bench.tables.items():
        if size == WINDOW:
            at = candidates(hashed, owner, bench.prints)
        else:
            at = np.flatnonzero(whole(owner, size))
        key = gram_hashes(hashed, size, at)
        match = among(keys, key)
        at, key = at[match], key[match]
        if not len(at):
            continue
        # A document that repeats a window asks for it once.
        order = np.lexsort((key, owner[at]))
        at, key = at[order], key[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[at[1:]] != owner[at[:-1]])
        first = np.flatnonzero(fresh)
        low, high = np.searchsorted(keys, key[first]), np.searchsorted(keys, key[first], "right")
        for a, b in parts(high - low):
            n = (high - low)[a:b]
            row = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            asks = np.repeat(at[first[a:b]], n)
            same = np.flatnonzero(same_words(found, asks, bench, places[row], size))
            pairs.update(zip(owner[asks[same]].tolist(), items[row[same]].tolist(), strict=True))
        place = places[np.repeat(low, np.diff(first, append=len(at)))]
        for a in range(0, len(at), VERIFIED):
            spots = at[a : a + VERIFIED]
            spots = spots[same_words(found, spots, bench, place[a : a + VERIFIED], size)]
            for k in range(size):
                hit[spots + k] = True
    return hit, pairs


def parts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows with about ``VERIFIED`` in all, or one row that has more."""
    begin = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // VERIFIED, prepend=-1))
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(sizes)], strict=True))


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcasts of ``(name, rows)``, and whether each is the last: the benchmark's rows in blocks of about
    ``block_bytes`` of text. A name is never used again, so tables that a Python worker made of another block can't be
    taken for this one's."""
    spark = benchmark.sparkSession
    total = benchmark.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    for block in range(blocks):
        rows = [(r.item_id, r.text.encode("utf-8", "surrogatepass")) for r in items.where(F.col("block") == block).distinct().collect()]
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, rows)), block == blocks - 1


_made: dict[str, Benchmark] = {}


def mark(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``n_words, n_hit, items, spans``: the occurring items (null last) and the
    hit words as ``[first, last + 1]`` pairs of word positions."""
    prepare(docs.sparkSession)
    found, blocks = docs, []
    for block, last in benchmark_blocks(benchmark, block_bytes):
        blocks.append(block)
        if last or len(blocks) == AT_ONCE:
            found = _pass(found, blocks, found is not docs)
            if not last:
                found = materialize(found, "marked")
                for used in blocks:
                    used.destroy()
                blocks = []
    return found


def _pass(rows: DataFrame, blocks: list[Broadcast], again: bool) -> DataFrame:
    """Rows marked by some blocks' items, and by what they were marked with before if this is done ``again``."""

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = raw_texts(batch.column("text"))
        found = words(texts, ALNUM)
        hashed = hash_spans(found.data, found.start, found.end)
        owner = np.repeat(np.arange(len(texts)), found.per_document)
        hit = np.zeros(len(hashed), bool)
        items: list[set[str | None]] = [set() for _ in texts]
        if again:
            items = [set(x) for x in batch.column("items").to_pylist()]
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                for low, high in spans:
                    hit[found.first[k] + low : found.first[k] + high] = True
        for block in blocks:
            bench = _benchmark(block)
            own, pairs = hits(found, hashed, owner, bench)
            hit |= own
            for doc, item in pairs:
                items[doc].add(bench.ids[item])
        spans = []
        for k in range(len(texts)):
            own = hit[found.first[k] : found.first[k + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
            spans.append(edge.reshape(-1, 2).tolist())
        counted = np.concatenate(([0], np.cumsum(hit)))
        return {
            "n_words": pa.array(found.per_document.astype(np.int64)),
            "n_hit": pa.array(counted[found.first[1:]] - counted[found.first[:-1]], pa.int64()),
            "items": pa.array([sorted(x - {None}) + [None] * (None in x) for x in items], pa.list_(pa.string())),
            "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
        }

    return annotate(rows, compute, "n_words long, n_hit long, items array<string>, spans array<array<long>>", given=("items", "spans") if again else ())


def _benchmark(block) -> Benchmark:
    """The block's tables, made once for each Python worker while it stays in use."""
    name, rows = block.value
    if name not in _made:
        while len(_made) >= AT_ONCE:
            _made.pop(next(iter(_made)))
        _made[name] = Benchmark(rows)
    return _made[name]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark window."""
    return unwrap(mark(docs, benchmark).where("n_hit = 0"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document."""
    found = mark(docs, benchmark)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
