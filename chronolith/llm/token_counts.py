"""Unigram token counts by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of the corpus are counted and sorted into ranges, so neighbours share prefixes. Runs of them
are inserted in tries; a trie's nodes are solved level by level, each once for all words below it: a node's forward
score is the best log probability of any segmentation of its prefix into pieces of the vocabulary, and words that end
at a node store its token count. Of equally good segmentations the one with the longer last piece counts. Documents
then get their distinct pre-tokens' counts and scores through the key exchange and sum them.

The pieces are a given vocabulary; their probabilities are estimated from the whole corpus. They begin by rank (Zipf's
law, log p = -log(rank + 1) - log H), and each of ``ROUNDS`` rounds of expectation-maximisation replaces them by the
pieces' expected counts: forward and backward sums over the same tries, weighted by the words' counts, plus ``PRIOR``.
A trie holds the words of a run of ``TRIE_WORDS`` global ranks, whatever the partitioning, and what it expects is rounded
to whole numbers of ``UNIT`` before tries are summed: the same corpus gives the same scores to the last digit.

A word of more than ``LONG`` bytes shares no prefix but is solved along its own bytes, in time linear in its length.

Edge cases: a null or empty text has no tokens and score 0; repeated rows give a row each; an empty table gives no
rows; other columns are ignored; a vocabulary must hold every single byte.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.byte_bpe import chunk_words, vocabulary
from chronolith.llm.exchange import Keys, bucket_count, corpus_bytes, exchange, into_chunks, narrow
from chronolith.llm.text import _digits, hash_array, mix, powers, prefix_sums
from chronolith.session import materialize, prepare

#: Rounds of estimation, and what is added to each piece's expected count.
ROUNDS, PRIOR = 2, 0.1
#: Expected counts are summed in this unit.
UNIT = 2.0**-32
#: Words with more bytes are solved one by one.
LONG = 64
#: Words of one trie; bytes of long words at a time, about; distinct words that a task holds before it hands them on.
TRIE_WORDS, TRIE_BYTES, MOST_WORDS = 1 << 16, 2 << 20, 1 << 19
#: Bytes of a long word whose pieces are looked up at a time.
LOOKED = 1 << 17
_FILTER = 20


@dataclass
class Pieces:
    """The vocabulary: sorted hashes, each hash's piece, the pieces' lengths, and a table of the hashes' last bits."""

    hashes: np.ndarray
    piece: np.ndarray
    lengths: list[int]
    known: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are pieces, and which pieces."""
        at = np.flatnonzero(self.known[(keys & np.uint64((1 << _FILTER) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, keys[at]), len(self.hashes) - 1)
        right = self.hashes[place] == keys[at]
        return at[right], self.piece[place[right]]


_made: dict[bytes, Pieces] = {}


def pieces_of(ranks_file: bytes) -> Pieces:
    """The vocabulary's tables, made once for each worker; a piece's number is its place in the order of ranks."""
    key = hashlib.sha256(ranks_file).digest()
    if key not in _made:
        ranks = vocabulary(ranks_file)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary must hold every single byte")
        ordered = sorted(ranks, key=ranks.get)
        hashes = hash_array(pa.array(ordered, pa.large_binary()))
        order = np.argsort(hashes)
        known = np.zeros(1 << _FILTER, bool)
        known[(hashes & np.uint64((1 << _FILTER) - 1)).astype(np.int64)] = True
        _made[key] = Pieces(hashes[order], order, sorted({len(p) for p in ordered}), known)
    return _made[key]


def by_rank(size: int) -> np.ndarray:
    """log probability of each piece by its rank."""
    return -np.log(np.arange(1, size + 1)) - np.log(np.sum(1 / np.arange(1, size + 1)))


class Trie:
    """The nodes of some sorted distinct words, level by level from the root, and the pieces that end at each.

    ``level[d]`` is the first node of depth ``d``; ``end[k]`` the node of word ``k``. Matches are sorted by the node
    at which they end, the longer first: ``above`` the node where the piece begins, ``piece`` its number.
    """

    def __init__(self, words: pa.Array, pieces: Pieces):
        offset = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        start, size = offset[:-1], np.diff(offset)
        power, inverse = powers(LONG + 1)
        self.end = np.zeros(len(words), np.int64)
        parents, hashes, self.level = [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)], [0, 1]
        live, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        for depth in range(1, int(size.max(initial=0)) + 1):
            keep = size[live] >= depth
            live, node = live[keep], node[keep]
            byte = data[start[live] + depth - 1]
            fresh = np.concatenate(([True], (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])))
            parents.append(node[fresh])
            with np.errstate(over="ignore"):
                hashes.append(hashes[-1][node[fresh] - self.level[depth - 1]] + _digits()[byte[fresh]] * power[depth - 1])
            node = self.level[depth] + np.cumsum(fresh) - 1
            self.level.append(self.level[depth] + int(fresh.sum()))
            done = size[live] == depth
            self.end[live[done]] = node[done]
        parent, total = np.concatenate(parents), np.concatenate(hashes)
        depths = np.repeat(np.arange(len(self.level) - 1), np.diff(self.level))
        ancestor, found = np.arange(len(parent)), []
        for length in range(1, min(len(self.level) - 2, pieces.lengths[-1]) + 1):
            first = self.level[length]
            ancestor[first:] = parent[ancestor[first:]]
            if length in pieces.lengths:
                above = ancestor[first:]
                with np.errstate(over="ignore"):
                    at, piece = pieces.find(mix((total[first:] - total[above]) * inverse[depths[above]] + np.uint64(length)))
                found.append((at + first, above[at], piece, np.full(len(at), length)))
        node, above, piece, length = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((-length, node))
        self.node, self.above, self.piece = node[order], above[order], piece[order]
        self.size = len(parent)

    def levels(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(first match, last + 1, first match of each node)`` of every level below the root."""
        begin = np.searchsorted(self.node, np.arange(self.size + 1))
        for low, high in zip(self.level[1:-1], self.level[2:], strict=True):
            yield int(begin[low]), int(begin[high]), begin[low:high] - begin[low]

    def best(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token count and score of each word's best segmentation."""
        top, count = np.zeros(self.size), np.zeros(self.size, np.int64)
        for (a, b, begin), low in zip(self.levels(), self.level[1:], strict=False):
            value = top[self.above[a:b]] + scores[self.piece[a:b]]
            own = np.maximum.reduceat(value, begin)
            at = np.where(value == np.repeat(own, np.diff(begin, append=b - a)), np.arange(b - a), b - a)
            first = np.minimum.reduceat(at, begin)
            top[low : low + len(begin)] = own
            count[low : low + len(begin)] = count[self.above[a:b][first]] + 1
        return count[self.end], top[self.end]

    def expected(self, scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations of the words, which count ``weights`` times."""
        forward = np.zeros(self.size)
        for (a, b, begin), low in zip(self.levels(), self.level[1:], strict=False):
            value = forward[self.above[a:b]] + scores[self.piece[a:b]]
            own = np.maximum.reduceat(value, begin)
            forward[low : low + len(begin)] = own + np.log(np.add.reduceat(np.exp(value - np.repeat(own, np.diff(begin, append=b - a))), begin))
        # Of each node, the log of the words' weights below, each over its own probability, along all ways to its end.
        with np.errstate(divide="ignore"):
            backward = np.log(np.bincount(self.end, weights, self.size)) - forward
        order = np.argsort(self.above, kind="stable")
        begin = np.searchsorted(self.above[order], np.arange(self.size + 1))
        for low, high in reversed(list(zip(self.level[:-1], self.level[1:], strict=True))):
            own = order[begin[low] : begin[high]]
            if not len(own):
                continue
            nodes = np.flatnonzero(begin[low + 1 : high + 1] > begin[low:high])
            cut = begin[low:high][nodes] - begin[low]
            value = backward[self.node[own]] + scores[self.piece[own]]
            top = np.maximum(np.maximum.reduceat(value, cut), backward[low + nodes])
            rest = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(cut, append=len(own)))), cut)
            backward[low + nodes] = top + np.log(rest + np.exp(backward[low + nodes] - top))
        share = np.exp(forward[self.above] + scores[self.piece] + backward[self.node])
        return np.bincount(self.piece, share, len(scores))


def matches(word: bytes, pieces: Pieces) -> tuple[list[int], list[int], list[int]]:
    """Pieces in a long word: where the matches that end at each place begin, and their lengths and pieces, the longer
    first."""
    data = np.frombuffer(word, np.uint8)
    ends, sizes, found = [], [], []
    for low in range(0, len(data), LOOKED):
        back = max(0, low - pieces.lengths[-1])
        part = data[back : low + LOOKED]
        power, inverse = powers(len(part) + 1)
        total = prefix_sums(part, power[: len(part)])
        for length in pieces.lengths:
            first = max(low - back - length + 1, 0)  # pieces that end in this block
            begin = np.arange(first, len(part) - length + 1)
            if not len(begin):
                continue
            with np.errstate(over="ignore"):
                at, piece = pieces.find(mix((total[begin + length] - total[begin]) * inverse[begin] + np.uint64(length)))
            ends.append(back + begin[at] + length)
            sizes.append(np.full(len(at), length))
            found.append(piece)
    end, size, piece = np.concatenate(ends), np.concatenate(sizes), np.concatenate(found)
    order = np.lexsort((-size, end))
    return np.searchsorted(end[order], np.arange(1, len(data) + 2)).tolist(), size[order].tolist(), piece[order].tolist()


def best_of_long(word: bytes, pieces: Pieces, scores: np.ndarray) -> tuple[int, float]:
    """Token count and score of a long word's best segmentation."""
    begin, size, piece = matches(word, pieces)
    value, top, count = scores[np.array(piece)].tolist(), [0.0] * (len(word) + 1), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        best, tokens = -math.inf, 0
        for k in range(begin[end - 1], begin[end]):
            before = end - size[k]
            own = top[before] + value[k]
            if own > best:
                best, tokens = own, count[before] + 1
        top[end], count[end] = best, tokens
    return count[-1], top[-1]


def expected_of_long(word: bytes, pieces: Pieces, scores: np.ndarray, weight: float) -> np.ndarray:
    """Expected count of each piece over all segmentations of a long word."""
    begin, size, piece = matches(word, pieces)
    value, n, minus = scores[np.array(piece)].tolist(), len(word), -math.inf
    add = lambda a, b: b if a == minus else max(a, b) + math.log1p(math.exp(-abs(a - b)))
    forward, backward, out = [minus] * (n + 1), [minus] * (n + 1), np.zeros(len(scores))
    forward[0] = backward[n] = 0.0
    for end in range(1, n + 1):
        for k in range(begin[end - 1], begin[end]):
            forward[end] = add(forward[end], forward[end - size[k]] + value[k])
    share = [0.0] * len(piece)
    for end in range(n, 0, -1):
        for k in range(begin[end - 1], begin[end]):
            own = backward[end] + value[k]
            backward[end - size[k]] = add(backward[end - size[k]], own)
            share[k] = forward[end - size[k]] + own
    np.add.at(out, np.array(piece), weight * np.exp(np.array(share) - forward[n]))
    return out


def merged(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and their counts' sums."""
    coded = pa.concat_arrays([pa.array([], pa.large_binary()), *(w for w, _ in parts)]).dictionary_encode()
    counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), counts, len(coded.dictionary)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: every distinct pre-token of the corpus, in ranges of sorted words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        for batch in batches:
            words, codes, _ = chunk_words(pa.Table.from_batches([batch]))
            held.append((words, np.bincount(codes, minlength=len(words))))
            if sum(len(w) for w, _ in held) > MOST_WORDS:
                held = [merged(held)]
                if len(held[0][0]) > MOST_WORDS // 2:
                    yield pa.record_batch({"word": held[0][0].cast(pa.binary()), "n": pa.array(held[0][1])})
                    held = []
        words, n = merged(held)
        yield pa.record_batch({"word": words.cast(pa.binary()), "n": pa.array(n)})

    counted = materialize(docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ranges = max(1, -(-counted.count() // (4 * TRIE_WORDS)))
    short = F.octet_length("word") <= LONG
    # Ranks of short words: their place in a range, which the number tells, and the words of the ranges before it.
    ordered = materialize(counted.where(short).repartitionByRange(ranges, "word").sortWithinPartitions("word").withColumn("place", F.monotonically_increasing_id()), "ordered_words")
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each range
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = ordered.sparkSession.createDataFrame([(part, start) for (part, _), start in zip(sizes, before, strict=False)], "part long, start long")
    ranked = ordered.join(F.broadcast(starts), F.shiftright("place", 33) == F.col("part"))
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    runs = ranked.select("word", "n", F.floor(rank / TRIE_WORDS).alias("run"))
    long = counted.where(~short).select("word", "n", (-1 - F.pmod(F.xxhash64("word"), F.lit(ranges))).alias("run"))
    return materialize(runs.unionByName(long).repartition(ranges, "run").sortWithinPartitions("run", "word"), "sorted_words")


def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Sorted words with their counts: of each run of short words, which is a trie, and of long words some bytes at a time."""
    held, size, run = [], 0, None
    for batch in batches:
        runs = batch.column("run").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if held and (runs[low] != run or run < 0 and size >= TRIE_BYTES):
                yield _run(held)
                held, size = [], 0
            run = runs[low]
            held.append(batch.slice(low, high - low))
            size += held[-1].column("word").get_total_buffer_size() if run < 0 else 0
    if held:
        yield _run(held)


def _run(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return table.column("word").cast(pa.large_binary()).combine_chunks(), table.column("n").to_numpy()


def _short(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy() <= LONG


def solved(words: pa.Array, pieces: Pieces, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token count and score of the best segmentation of each of some sorted distinct words."""
    count, score, short = np.zeros(len(words), np.int64), np.zeros(len(words)), _short(words)
    if short.any():
        count[short], score[short] = Trie(words.filter(pa.array(short)), pieces).best(scores)
    for k in np.flatnonzero(~short).tolist():
        count[k], score[k] = best_of_long(words[k].as_py(), pieces, scores)
    return count, score


def expected(words: pa.Array, weights: np.ndarray, pieces: Pieces, scores: np.ndarray) -> np.ndarray:
    """Expected count of each piece in some sorted distinct words."""
    out, short = np.zeros(len(scores)), _short(words)
    if short.any():
        out += Trie(words.filter(pa.array(short)), pieces).expected(scores, weights[short])
    for k in np.flatnonzero(~short).tolist():
        out += expected_of_long(words[k].as_py(), pieces, scores, float(weights[k]))
    return out


def in_units(words: pa.Array, weights: np.ndarray, pieces: Pieces, scores: np.ndarray) -> np.ndarray:
    """``expected`` as two rows of whole numbers, of ones and of ``UNIT``: rounded for the trie of the short words, and for
    each long word."""
    out, short = np.zeros((2, len(scores)), np.int64), _short(words)
    parts = [np.flatnonzero(short), *([k] for k in np.flatnonzero(~short))]
    for own in parts:
        if len(own):
            counts = expected(words.take(pa.array(own)), weights[own], pieces, scores)
            out += [np.floor(counts).astype(np.int64), np.rint((counts - np.floor(counts)) / UNIT).astype(np.int64)]
    return out


def estimate(words: DataFrame, ranks_file: bytes, rounds: int = ROUNDS) -> np.ndarray:
    """log probability of each piece, estimated from the corpus's words."""
    ranks = words.sparkSession.sparkContext.broadcast(ranks_file)
    scores = by_rank(len(vocabulary(ranks_file)))
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(scores)  # a number for each piece

        def gather(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, len(shared.value)), np.int64)
            for run, weights in tries(batches):
                total += in_units(run, weights, pieces_of(ranks.value), shared.value)
            piece = np.flatnonzero(total.any(0))
            yield pa.record_batch({"piece": pa.array(piece, pa.int32()), "ones": pa.array(total[0, piece]), "units": pa.array(total[1, piece])})

        counts = np.full(len(scores), PRIOR)
        sums = words.mapInArrow(gather, "piece int, ones long, units long").groupBy("piece").agg(F.sum("ones"), F.sum("units"))
        for piece, ones, units in sums.collect():  # a row for each piece at most
            counts[piece] += ones + units * UNIT
        scores = np.log(counts / counts.sum())
    return scores


def count_tokens(docs: DataFrame, ranks_file: bytes, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, score`` for every row; ``score`` is the text's log probability (natural)."""
    spark = prepare(docs.sparkSession)
    total = corpus_bytes(docs)
    chunks, buckets = into_chunks(docs, total), bucket_count(total)
    words = word_counts(docs)
    ranks = spark.sparkContext.broadcast(ranks_file)  # the vocabulary, some tens of thousands of lines
    shared = spark.sparkContext.broadcast(estimate(words, ranks_file, rounds))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, _ in tries(batches):
            count, score = solved(run, pieces_of(ranks.value), shared.value)
            bucket = (hash_array(run) % np.uint64(buckets)).astype(np.int32)
            yield pa.record_batch({"bucket": pa.array(bucket), "word": run.cast(pa.binary()), "count": pa.array(count), "score": pa.array(score)})

    def keys_of(chunk: pa.Table) -> list[Keys]:
        return [Keys.of_bytes(chunk_words(chunk)[0])]

    def answer(kind: int, parts: list[pa.Table], rows: pa.Table) -> list[pa.Table]:
        known = rows.column("word").cast(pa.large_binary()).combine_chunks()
        count, score = rows.column("count").to_numpy(), rows.column("score").to_numpy()
        out = []
        for part in parts:
            at = pc.index_in(part.column("key"), value_set=known).to_numpy()
            # One row of two lists compresses better than a row for each word.
            out.append(pa.table({"count": pa.array([narrow(count[at])]), "score": pa.array([score[at]])}))
        return out

    def finish(chunk: pa.Table, answers: list[list[pa.Table]]) -> pa.Table:
        words, codes, first = chunk_words(chunk)
        found = Keys.of_bytes(words)
        count, score = (found.restore(np.concatenate([t.column(c)[0].values.to_numpy() for t in answers[0]]), buckets) for c in ("count", "score"))
        own = np.diff(first)
        owner = np.repeat(np.arange(len(own)), own)
        return pa.table(
            {
                "doc_id": chunk.column("doc_id"),
                "n_pretokens": own.astype(np.int64),
                "n_tokens": np.bincount(owner, count[codes], len(own)).astype(np.int64),
                "score": np.bincount(owner, score[codes], len(own)).astype(float),
            }
        )

    known = words.mapInArrow(solve, "bucket int, word binary, count long, score double")
    return exchange(chunks, buckets, keys_of, answer, finish, f"doc_id {doc_type}, n_pretokens long, n_tokens long, score double", known)
