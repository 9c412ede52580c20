"""Language-model scoring by prediction by partial matching over a byte-context trie.

The trie of contexts of up to ``ORDER`` bytes is held as counts of (context, next byte) grams of the training
documents. A gram's probability follows the trie from the longest known context towards the root: at each node the
escape estimate of method D (half the distinct symbols over the symbols; each symbol gives up a half) is taken, and
symbols of the longer contexts are excluded from the shorter ones. A document's score is the log10 probability of its bytes and
one end symbol under the pretrained counts; ``code_length_bits`` is the same as a code length.

Gram counts are summed over the corpus by Spark. The counts of all contexts that end in the same three bytes meet in
one part of about ``SOLVED`` grams: there the nodes of order three and more are complete, the nodes of order two are
joined to it, and every gram's probability is worked out once. Nodes of orders nought and one are 65,536 numbers at
most, and are broadcast. Chunks of documents then get the probabilities of their distinct grams through the key
exchange.

The baseline is a smoothed unigram model of words.

Edge cases: a null text is empty and scores its end symbol; with no training rows every byte has probability
1/256; repeated rows give a row each and count each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.exchange import Keys, bucket_count, corpus_bytes, exchange, into_chunks
from chronolith.llm.text import LOWER, SPACED, mix, raw_texts, spans_to_array, words
from chronolith.session import materialize, prepare

#: Longest context, in bytes.
ORDER = 5
#: Bytes that UTF-8 never uses: what stands before a text, and the symbol that ends it.
BEFORE, END = 0xFE, 0xFF
#: The key of the end token; words hold no space.
END_TOKEN = b" "
#: Distinct grams that a task holds before it hands them on.
MOST_GRAMS = 4 << 20
#: Grams whose probabilities are worked out together, about.
SOLVED = 1 << 16
#: Bytes of text whose grams are sorted at a time.
SLICE_BYTES = 2 << 20


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLICE_BYTES``."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text) + 1
        if size >= SLICE_BYTES:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, symbol) of every symbol of the texts, and the symbols of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    pad = bytes([BEFORE]) * ORDER
    end = bytes([END])
    data = LOWER[np.frombuffer(b"".join(x for text in texts for x in (pad, text, end)), np.uint8)]
    packed = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        packed = (packed << np.uint64(8)) | data[k : len(data) - ORDER + k]
    # Grams whose symbol is padding of the next text stand between the texts.
    keep = np.ones(len(packed), bool)
    joints = np.cumsum(sizes + ORDER)[:-1] - ORDER
    for k in range(ORDER):
        keep[joints + k] = False
    return packed[keep], sizes


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts' sums."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def chunk_grams(texts: list[bytes], training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a chunk and how often each stands in its training documents."""
    keys, counts = [], []
    for low, high in slices(texts):
        for taught in (True, False):
            own = [t for t, x in zip(texts[low:high], training[low:high], strict=True) if x == taught]
            if own:
                found, n = np.unique(grams(own)[0], return_counts=True)
                keys.append(found)
                counts.append(n if taught else np.zeros(len(n), np.int64))
    return merge(keys, counts)


class Lookup:
    """Values of distinct 64-bit keys by open addressing, for many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << self.bits, values.dtype)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], probe)
            free = self.slots[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.slots[slot[free]] = keys[left[free]]
            took = self.slots[slot] == keys[left]
            self.values[slot[took]] = values[left[took]]
            left, probe = left[~took], probe + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            home = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((home + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys, 0)
        out = self.values[slot]
        left, probe = np.flatnonzero(self.slots[slot] != keys), 1
        while len(left):
            slot = self._slot(keys[left], probe)
            out[left] = self.values[slot]
            left, probe = left[self.slots[slot] != keys[left]], probe + 1
        return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * (order + 1))) - 1)


def log_probabilities(packed: np.ndarray, counts: np.ndarray, triples: np.ndarray, seen: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's symbol after its context.

    ``packed``: distinct grams, all training grams that share their last three context bytes among them; ``counts``:
    how often each was seen in training; ``triples``, ``seen``: the nodes of order two (sorted) for these grams' last
    two context bytes, and their counts; ``pairs``: 256 x 256 counts of (byte before, symbol).
    """
    n_sym, n_ctx, d_ctx = {}, {}, {}  # by order, for each gram: count of its symbol, of its context, distinct symbols
    level: dict[int, tuple] = {}
    for order in range(ORDER, 1, -1):
        if order > 2:
            nodes, place = np.unique(packed & _mask(order), return_inverse=True)
            n = np.bincount(place, counts, len(nodes))
        else:
            nodes, n, place = triples, seen, np.searchsorted(triples, packed & _mask(2))
        contexts, of = np.unique(nodes >> np.uint64(8), return_inverse=True)
        total, distinct = np.bincount(of, n, len(contexts)), np.bincount(of, n > 0, len(contexts))
        level[order] = nodes, n, of, len(contexts), place
        n_sym[order], n_ctx[order], d_ctx[order] = n[place], total[of][place], distinct[of][place]
    before, symbol = ((packed >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (packed & np.uint64(255)).astype(np.int64)
    single = pairs.sum(0)
    n_sym[1], n_ctx[1], d_ctx[1] = pairs[before, symbol], pairs.sum(1)[before], (pairs > 0).sum(1)[before]
    n_sym[0], n_ctx[0], d_ctx[0] = single[symbol], np.full(len(packed), single.sum()), np.full(len(packed), (single > 0).sum())
    # Counts, at each context, of the symbols that its one byte longer context excludes.
    excluded = {0: ((pairs > 0) * single).sum(1)[before]}
    for order in range(ORDER - 1, 0, -1):
        nodes, n, of, size, place = level[order + 1]
        if order > 1:
            shorter, m = level[order][:2]
            known = m[np.searchsorted(shorter, nodes & _mask(order))]
        else:
            known = pairs[((nodes >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (nodes & np.uint64(255)).astype(np.int64)]
        excluded[order] = np.bincount(of, np.where(n > 0, known, 0), size)[of][place]
    out = np.zeros(len(packed))
    open_ = np.ones(len(packed), bool)
    for order in range(ORDER, -1, -1):
        n, d = n_ctx[order].astype(float), d_ctx[order].astype(float)
        if order < ORDER:
            longer = n_ctx[order + 1] > 0
            n = np.where(longer, n - excluded[order], n)
            d = np.where(longer, d - d_ctx[order + 1], d)
        active = open_ & (d > 0)
        hit = active & (n_sym[order] > 0)
        escape = active & ~hit
        out[hit] += np.log10((n_sym[order][hit] - 0.5) / n[hit])
        out[escape] += np.log10(0.5 * d[escape] / n[escape])
        open_ &= ~hit
    out[open_] -= np.log10(256 - (single > 0).sum())
    return out


def gram_counts(docs: DataFrame, held_out: Column) -> DataFrame:
    """``(gram, n)``: every gram of the corpus and how often it stands in training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = merge([], [])
        for batch in batches:
            training = ~pc.fill_null(batch.column("held"), False).to_numpy(zero_copy_only=False).astype(bool)
            more, m = chunk_grams(raw_texts(batch.column("text")), training)
            found, n = merge([found, more], [n, m])
            if len(found) > MOST_GRAMS:
                yield pa.record_batch({"gram": pa.array(found.view(np.int64)), "n": pa.array(n)})
                found, n = merge([], [])
        yield pa.record_batch({"gram": pa.array(found.view(np.int64)), "n": pa.array(n)})

    counted = docs.select("text", held_out.alias("held")).mapInArrow(count, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def byte_pairs(counts: DataFrame) -> np.ndarray:
    """Counts of (byte before, symbol): the trie's nodes of orders nought and one."""
    pairs = np.zeros(1 << 16, np.int64)
    for pair, n in counts.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n")).collect():  # 65,536 rows at most
        pairs[pair] = n
    return pairs.reshape(256, 256)


def home(packed: np.ndarray) -> np.ndarray:
    return mix(packed)


def probabilities(counts: DataFrame, pairs: np.ndarray, buckets: int) -> DataFrame:
    """``(bucket, gram, logp)`` of every gram, worked out where all grams of its last three context bytes meet."""
    shared = counts.sparkSession.sparkContext.broadcast(pairs)

    def arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        packed = rows.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(packed)
        return packed[order], rows.column("n").to_numpy()[order]

    def solve(key: tuple, rows: pa.Table, nodes: pa.Table) -> pa.Table:
        packed, n = arrays(rows)
        bucket = (home(packed) % np.uint64(buckets)).astype(np.int32) + buckets
        return pa.table({"bucket": bucket, "gram": packed.view(np.int64), "logp": log_probabilities(packed, n, *arrays(nodes), shared.value)})

    parts = max(1, -(-counts.count() // SOLVED))
    after = lambda n: F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * n) - 1))
    dealt = counts.select(F.pmod(F.xxhash64(after(3)), F.lit(parts)).cast("int").alias("part"), "gram", "n")
    triples = counts.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("gram")).agg(F.sum("n").alias("n")).withColumn("suffix", after(2))
    # A suffix has 256 nodes of order two at most and is asked for once by each part.
    asked = dealt.select(F.col("part").alias("asking"), after(2).alias("suffix")).distinct()
    nodes = triples.join(asked, "suffix").select("asking", F.col("gram").alias("node"), F.col("n").alias("seen")).toDF("asking", "gram", "n")
    return dealt.groupBy("part").cogroup(nodes.groupBy("asking")).applyInArrow(solve, "bucket int, gram long, logp double")


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Score every document, learning from those that are not held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_length_bits``.
    """
    spark = prepare(docs.sparkSession)
    total = corpus_bytes(docs)
    buckets = bucket_count(total)
    chunks = into_chunks(docs, total, held_out.alias("held"))
    counts = materialize(gram_counts(docs, held_out), "grams")
    known = probabilities(counts, byte_pairs(counts), buckets)
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def chunk_tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct tokens, each token's index among them, each token's document."""
        pieces, owners = [], []
        for low, high in slices(texts):
            found = words(texts[low:high], SPACED)
            pieces.append(spans_to_array(found.data, found.start, found.end))
            owners.append(np.repeat(np.arange(low, high), found.per_document))
        pieces.append(pa.array([END_TOKEN] * len(texts), pa.large_binary()))
        owners.append(np.arange(len(texts)))
        coded = pa.concat_arrays(pieces).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.concatenate(owners)

    def gram_keys(texts: list[bytes]) -> Keys:
        found, _ = chunk_grams(texts, np.ones(len(texts), bool))
        return Keys(pa.array(found), home(found))

    def read(chunk: pa.Table) -> tuple[list[bytes], np.ndarray]:
        held = pc.fill_null(chunk.column("held"), False).to_numpy().astype(bool)
        return [t for c in chunk.column("text").chunks for t in raw_texts(c)], ~held

    def keys_of(chunk: pa.Table) -> list[Keys]:
        texts, training = read(chunk)
        tokens, codes, owners = chunk_tokens(texts)
        n = np.bincount(codes, training[owners], len(tokens)).astype(np.int64)
        return [Keys.of_bytes(tokens, {"n": n}), gram_keys(texts)]

    def answer(kind: int, parts: list[pa.Table], rows: pa.Table) -> list[pa.Table]:
        if kind == 1:
            packed, logp = rows.column("gram").to_numpy().view(np.uint64), rows.column("logp").to_numpy()
            order = np.argsort(packed)
            packed, logp = packed[order], logp[order]
            return [pa.table({"value": logp[np.searchsorted(packed, p.column("key").to_numpy())]}) for p in parts]
        sizes = np.cumsum([0] + [p.num_rows for p in parts])
        coded = pa.concat_arrays([c for p in parts for c in p.column("key").chunks]).dictionary_encode()
        place = coded.indices.to_numpy()
        c = np.bincount(place, np.concatenate([p.column("n").to_numpy() for p in parts]), len(coded.dictionary)).astype(np.int64)
        about = {"tokens": str(int(c.sum())), "distinct": str(int((c > 0).sum()))}
        return [pa.table({"value": c[place[a:b]]}).replace_schema_metadata(about) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]

    def finish(chunk: pa.Table, answers: list[list[pa.Table]]) -> pa.Table:
        texts, training = read(chunk)
        tokens, codes, owners = chunk_tokens(texts)
        values = [np.concatenate([t.column("value").to_numpy() for t in tables]) for tables in answers]
        known = Keys.of_bytes(tokens).restore(values[0], buckets)
        about = [t.schema.metadata for t in answers[0]]
        n_all, distinct = (sum(int(m[k]) for m in about) for k in (b"tokens", b"distinct"))
        c, size = known[codes], len(texts)
        n_tokens = np.bincount(owners, minlength=size)
        base = np.bincount(owners, np.log10(c + 0.5), size) - n_tokens * np.log10(n_all + 0.5 * (distinct + 1))
        found = gram_keys(texts)
        logp = Lookup(found.keys.to_numpy(), found.restore(values[1], buckets))
        scores = np.zeros(size)
        for low, high in slices(texts):
            packed, sizes = grams(texts[low:high])
            scores[low:high] = np.add.reduceat(logp(packed), np.concatenate(([0], np.cumsum(sizes)[:-1])))
        return pa.table(
            {
                "doc_id": chunk.column("doc_id"),
                "held_out": ~training,
                "n_tokens": n_tokens.astype(np.int64),
                "n_known": np.bincount(owners, c > 0, size).astype(np.int64),
                "train_tokens": np.full(size, n_all, np.int64),
                "base_score": base,
                "score": scores,
                "code_length_bits": scores * -np.log2(10),
            }
        )

    schema = f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, code_length_bits double"
    return exchange(chunks, buckets, keys_of, answer, finish, schema, known)
