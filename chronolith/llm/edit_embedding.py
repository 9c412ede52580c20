"""Document fingerprints by randomised edit embedding.

Every text walks over its characters with the same random bits: at step ``j`` the character under the walk is
written out, and the walk moves on if the bit for (``j``, character) is one. Texts at a small edit distance write
out strings at a small Hamming distance. A fingerprint samples that string at fixed places: ``SAMPLES`` in each
octave of steps, so it covers whole texts of any length with a few hundred digits. Likeness is the share of equal
samples, weighted by the steps each stands for and corrected for chance.

Near-duplicates are found by banding sampled digits (``similar``): texts that agree on a band of either of two walks
meet under its key, and each is linked to the least text of its keys that is like it. Of texts of 400 characters or
more with up to three edits, at least nine in ten are found (measured by a test).

``with_next`` needs each document's successor: documents are dealt into ranges of ids of about equal size, the first
of a range goes to the range before it as well, and each range is sorted and streamed, so texts are shuffled once.

Edge cases: null is an empty text, whose fingerprint is all zeros; the document after the last is the first, and a
single document follows itself; documents of one id follow each other in the order of their texts, a null id comes
first; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.exchange import chunk_count, corpus_bytes
from chronolith.llm.rows import arrow_type, look_up
from chronolith.llm.text import mix
from chronolith.session import materialize, prepare

#: The random bits repeat after so many steps; characters are told apart up to this many classes.
PERIOD, CLASSES = 4096, 256
SAMPLES = 32
FIRST_OCTAVE = 5
#: Values of a sampled digit; 0 stands beyond the text's end.
DIGITS = 16
#: Bands of ``BAND`` digits each, taken from the octave that holds most of a text's second half.
BANDS, BAND = 4, 8
SIMILAR = 0.8
#: Texts of a key that are verified against each other at a time, about.
BLOCK = 1024
#: Characters that walk together.
GROUP_CHARS = 8 << 20


@lru_cache(2)
def _stays(number: int = 0) -> np.ndarray:
    """How many steps a walk stays, for each step (modulo the period) and class of character; walks are numbered."""
    bits = np.random.default_rng(97 + number).integers(0, 2, (PERIOD, CLASSES), dtype=np.uint8)
    bits[-1] = 1  # so that every stay ends within two periods
    stays = np.zeros((2 * PERIOD, CLASSES), np.uint16)
    both = np.concatenate((bits, bits))
    run = np.zeros(CLASSES, np.uint16)
    for j in range(2 * PERIOD - 1, -1, -1):
        run = np.where(both[j] == 1, 1, run + 1)
        stays[j] = run
    return stays[:PERIOD].ravel()


@lru_cache(1)
def _digit() -> np.ndarray:
    return (1 + mix(np.arange(CLASSES, dtype=np.uint64)) % np.uint64(DIGITS - 1)).astype(np.uint8)


@lru_cache(64)
def _places(octaves: int) -> np.ndarray:
    """The sampled steps: all below ``2**FIRST_OCTAVE``, then ``SAMPLES`` in each octave."""
    random = np.random.default_rng(31)
    parts = [np.arange(1 << FIRST_OCTAVE)]
    for octave in range(FIRST_OCTAVE, FIRST_OCTAVE + octaves):
        parts.append((1 << octave) + np.sort(random.choice(1 << octave, SAMPLES, replace=False) if octave < 22 else random.integers(0, 1 << octave, SAMPLES)))
    return np.concatenate(parts)


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Class of every character of the texts, and each text's first."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return (mix(points.astype(np.uint64)) % np.uint64(CLASSES)).astype(np.uint8), np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))).astype(np.int64)


def walk(kinds: np.ndarray, first: np.ndarray, begin: np.ndarray, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each character is reached, and at which each text ends; texts begin at steps ``begin``."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, sorted_size = first[:-1][order], size[order]
    steps = begin[order].astype(np.int64)
    reached = np.zeros(len(kinds), np.int64)
    stays = _stays(number)
    longest = int(sorted_size[0]) if len(size) else 0
    live = len(size) - np.searchsorted(sorted_size[::-1], np.arange(longest), "right")
    for t, n in enumerate(live.tolist()):
        rows = start[:n] + t
        now = steps[:n]
        reached[rows] = now
        now += stays[((now & (PERIOD - 1)) << 8) | kinds[rows]]
    end = np.empty_like(steps)
    end[order] = steps
    return reached, end


def digits(pieces: list[tuple[np.ndarray, np.ndarray]], end: int) -> np.ndarray:
    """Sampled digits of a walk made of ``(steps reached, classes)`` pieces, which ends at step ``end``."""
    octaves = max(0, int(max(end - 1, 0)).bit_length() - FIRST_OCTAVE)
    places = _places(octaves)
    out = np.zeros(len(places), np.uint8)
    table = _digit()
    for reached, kinds in pieces:
        if len(reached):
            at = np.searchsorted(reached, places, "right") - 1
            inside = (at >= 0) & (places < end)
            out[inside] = table[kinds[at[inside]]]
    return out


def spelled(found: np.ndarray) -> str:
    return (found[0::2] << 4 | found[1::2]).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, from 0 (as often as chance) to 1."""
    return float(likenesses(a, b[None])[0])


def likenesses(a: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The likeness of ``a`` to each row of ``table``."""
    size = max(len(a), table.shape[1])
    a, table = np.pad(a, (0, size - len(a))), np.pad(table, ((0, 0), (0, size - table.shape[1])))
    octave = np.maximum(np.arange(size) // SAMPLES - 1, -1) + FIRST_OCTAVE
    weight = np.where(np.arange(size) < 1 << FIRST_OCTAVE, 1.0, 2.0**octave / SAMPLES)
    valid = (table > 0) | (a > 0)
    total = valid @ weight
    equal = np.divide((valid & (table == a)) @ weight, total, out=np.ones(len(table)), where=total > 0)
    chance = 1 / (DIGITS - 1)
    return np.clip((equal - chance) / (1 - chance), 0.0, 1.0)


def compare(texts: list[str]) -> Iterator[tuple]:
    """For each text but the last: its and its edited version's digits, digest and likenesses."""
    kinds, first = classes(texts)
    reached, end = walk(kinds, first, np.zeros(len(texts), np.int64))
    own = [digits([(reached[first[k] : first[k + 1]], kinds[first[k] : first[k + 1]])], int(end[k])) for k in range(len(texts))]
    size = np.diff(first)
    cut = first[:-1] + size - size // 2
    taken = np.minimum(size[:-1] // 2, size[1:])
    tails = np.concatenate([kinds[first[k + 1] : first[k + 1] + taken[k]] for k in range(len(taken))]) if len(taken) else kinds[:0]
    tail_first = np.concatenate(([0], np.cumsum(taken))).astype(np.int64)
    begin = np.where(size > 1, reached[np.minimum(cut, max(0, len(reached) - 1))] if len(reached) else 0, end)[:-1]
    tail_reached, tail_end = walk(tails, tail_first, begin)
    for k in range(len(texts) - 1):
        low, high = tail_first[k], tail_first[k + 1]
        edited = digits([(reached[first[k] : cut[k]], kinds[first[k] : cut[k]]), (tail_reached[low:high], tails[low:high])], int(tail_end[k]))
        body = texts[k][: int(cut[k] - first[k])] + texts[k + 1][: int(taken[k])]
        digest = hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()
        yield int(size[k]), digest, spelled(own[k]), spelled(edited), likeness(own[k], edited), likeness(own[k], own[k + 1])


def fingerprint(texts: list[str], number: int = 0) -> list[str]:
    """The fingerprint of each text, by the walk of that number."""
    kinds, first = classes(texts)
    reached, end = walk(kinds, first, np.zeros(len(texts), np.int64), number)
    return [spelled(digits([(reached[first[k] : first[k + 1]], kinds[first[k] : first[k + 1]])], int(end[k]))) for k in range(len(texts))]


def _heads(docs: DataFrame, ranges: int) -> list:
    """The first id of each of about ``ranges`` ranges that hold about equally many documents: one id a range."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(ranges, "doc_id")
    return sorted(r.least for r in ids.groupBy(F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("least")).collect())


def _array(ids: pa.Array, first: object) -> np.ndarray:
    """Ids that can be compared, null as ``first``."""
    return ids.fill_null(first).to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array([first if i is None else i for i in ids.to_pylist()], object)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    A text's edited version has its second half replaced by as much of the next document's beginning. Ids may be of any
    type that has an order.
    """
    spark = prepare(docs.sparkSession)
    heads = _heads(docs, chunk_count(corpus_bytes(docs))) or [0]  # without an id, all rows are one range
    nulls = not docs.where("doc_id IS NULL").isEmpty()
    shared = spark.sparkContext.broadcast(heads)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each row its range; the first of a range goes to the range before it, too."""
        first = shared.value[0]
        for batch in batches:
            given = batch.column("doc_id")
            known = np.array(shared.value, np.int64 if pa.types.is_integer(given.type) else object)
            ids = _array(given, first)
            home = np.searchsorted(known, ids, "right") - 1
            yield pa.record_batch({"home": pa.array(home, pa.int32()), "late": pa.array(np.zeros(len(ids)), pa.int32()), **{c: batch.column(c) for c in ("doc_id", "text")}})
            leads = known[home] == ids
            if nulls:  # they come before the first id
                leads = np.where(home > 0, leads, pc.is_null(given).to_numpy(zero_copy_only=False))
            head = np.flatnonzero(leads)
            if len(head):
                before = batch.take(pa.array(head))
                yield pa.record_batch({"home": pa.array((home[head] - 1) % len(known), pa.int32()), "late": pa.array(np.ones(len(head)), pa.int32()), **{c: before.column(c) for c in ("doc_id", "text")}})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by range; each with its successor in the same range or the late row that ends the range."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            rows = zip(batch.column("home").to_pylist(), batch.column("late").to_pylist(), batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist(), strict=True)
            for row in rows:
                if row[1] and (not held or held[-1][1]):
                    continue  # a further row of the next range's first id
                held.append(row)
                size += len(row[3])
                if size > GROUP_CHARS:
                    yield from pairs(held)
                    held, size = held[-1:], len(row[3])
        yield from pairs(held)

    def pairs(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = list(compare([r[3] for r in held])) if len(held) > 1 else []
        kept = [(row[2], *values) for row, values in zip(held[:-1], found, strict=True) if not row[1]]
        if kept:
            yield pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*kept, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [arrow_type(docs, "doc_id"), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text").mapInArrow(deal, f"home int, late int, doc_id {id_type}, text string")
    sorted_ = dealt.repartition("home").sortWithinPartitions("home", "late", "doc_id", "text")
    return sorted_.mapInArrow(stream, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def similar(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, leader`` for every row: each text's least verified partner among those, itself included,
    that share one of its bands.

    Texts are marked by two walks: an edit may throw one of them off for long, but seldom both, so texts share a band or
    are alike if either mark says so. A text is verified against its keys' least texts first. Where that fails, it is verified against all texts of the
    key: both are dealt into blocks of about ``BLOCK``, and each pair of blocks is a group of its own. A null id leads
    nobody.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(marks(pc.fill_null(batch.column("text"), "").to_pylist()), pa.string())], ["doc_id", "fingerprint"])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [mark_keys(x) for x in batch.column("fingerprint").to_pylist()]
            yield pa.record_batch([batch.column("fingerprint"), batch.column("least"), pa.array(keys, pa.list_(pa.string()))], ["fingerprint", "least", "keys"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [float(nearness(a, [b])[0]) for a, b in zip(batch.column("fingerprint").to_pylist(), batch.column("leading").to_pylist(), strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("fingerprint", "least", "leader", "met")), pa.array(near, pa.float64())], ["fingerprint", "least", "leader", "met", "near"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by pair of blocks, in each the known texts by id and then those that ask."""
        unit, known, leads, table = None, [], [], None
        for batch in batches:
            asking, leader = [], []
            units = zip(*(batch.column(c).to_pylist() for c in ("key", "theirs", "own")), strict=True)
            for now, asks, text, least in zip(units, *(batch.column(c).to_pylist() for c in ("asks", "fingerprint", "least")), strict=True):
                if now != unit:
                    unit, known, leads, table = now, [], [], None
                if not asks:
                    known.append(text)
                    leads.append(least)
                elif known:
                    if table is None:
                        table = [stacked(part) for part in zip(*(x.split(":") for x in known), strict=True)]
                    found = np.flatnonzero(nearness(text, table) >= SIMILAR)
                    if len(found):
                        asking.append(text)
                        leader.append(leads[found[0]])
            yield pa.record_batch([pa.array(asking, pa.string()), pa.array(leader, batch.column("least").type)], ["fingerprint", "leader"])

    marked = materialize(docs.select("doc_id", "text").mapInArrow(mark, f"doc_id {id_type}, fingerprint string"), "fingerprints")
    nodes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    listed = nodes.mapInArrow(bands, f"fingerprint string, least {id_type}, keys array<string>")
    keyed = materialize(listed.select("fingerprint", "least", F.explode(F.array_distinct("keys")).alias("key")), "bands")
    leading = keyed.where("least IS NOT NULL")
    leaders = leading.groupBy("key").agg(F.min_by("fingerprint", "least").alias("leading"), F.min("least").alias("leader"), F.count("*").alias("members"))
    met = keyed.join(leaders, "key").groupBy("fingerprint", "least", "leading", "leader").agg(F.collect_list(F.struct("key", "members")).alias("met"))  # a text has few bands
    verified = materialize(met.mapInArrow(verify, f"fingerprint string, least {id_type}, leader {id_type}, met array<struct<key:string,members:bigint>>, near double"), "verified")
    unlike = verified.where(F.col("near") < SIMILAR).select("fingerprint", "least", F.explode("met").alias("met")).select("fingerprint", "least", "met.key", "met.members")
    open_keys = unlike.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("ask_blocks"), F.ceil(F.first("members") / BLOCK).alias("blocks"))
    block = lambda n: F.pmod(F.xxhash64("fingerprint"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = unlike.join(open_keys, "key").select("key", block("ask_blocks").alias("own"), every("blocks").alias("theirs"), F.lit(1).alias("asks"), "fingerprint", "least")
    known = leading.join(open_keys, "key").select("key", every("ask_blocks").alias("own"), block("blocks").alias("theirs"), F.lit(0).alias("asks"), "fingerprint", "least")
    dealt = asks.union(known).repartition("key", "theirs", "own").sortWithinPartitions("key", "theirs", "own", "asks", "least")
    searched = dealt.mapInArrow(search, f"fingerprint string, leader {id_type}")
    found = verified.where(F.col("near") >= SIMILAR).select("fingerprint", "leader").union(searched).union(nodes.select("fingerprint", "least"))
    best = found.groupBy("fingerprint").agg(F.min("leader").alias("leader"))
    return look_up(marked, materialize(best, "leaders"), "fingerprint").select("doc_id", F.substring_index("fingerprint", ":", 1).alias("fingerprint"), "leader")


def marks(texts: list[str]) -> list[str]:
    """The fingerprints of each text by two walks."""
    return [f"{a}:{b}" for a, b in zip(fingerprint(texts), fingerprint(texts, 1), strict=True)]


def mark_keys(mark: str) -> list[str]:
    return [f"{number}:{key}" for number, part in enumerate(mark.split(":")) for key in band_keys(part)]


def nearness(mark: str, known: list) -> np.ndarray:
    """The greater of both walks' likeness of a text to some others, given as marks or as tables of digits."""
    tables = known if isinstance(known[0], np.ndarray) else [stacked(part) for part in zip(*(x.split(":") for x in known), strict=True)]
    return np.maximum(*(likenesses(unspelled(part), table) for part, table in zip(mark.split(":"), tables, strict=True)))


def stacked(spelled_texts: list[str]) -> np.ndarray:
    """Digits of fingerprints, a row each, filled up with zeros."""
    found = [unspelled(x) for x in spelled_texts]
    table = np.zeros((len(found), max(map(len, found))), np.uint8)
    for row, own in zip(table, found, strict=True):
        row[: len(own)] = own
    return table


def unspelled(text: str) -> np.ndarray:
    both = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.stack((both >> 4, both & 15), 1).ravel()


def band_keys(text: str) -> list[str]:
    """Keys of a fingerprint's bands: digits of the two octaves before its last, which the text surely fills."""
    last = max(1, len(text) // SAMPLES - 1)
    octaves = [text[k * SAMPLES : (k + 1) * SAMPLES] for k in (last - 1, last - 2) if k >= 0]
    return [f"{last - n}:{b}:{octave[b * BAND : (b + 1) * BAND]}" for n, octave in enumerate(octaves, 1) for b in range(BANDS)]
