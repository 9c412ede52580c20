"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are exploded into pre-tokens with their positions; every distinct pre-token of the corpus is encoded once,
in the bucket that its hash chooses; ids are joined back and documents reassembled by position. Decoding joins the
ids with the token-byte table.

Edge cases: a null or empty text has no tokens and decodes to no bytes; rows that repeat give a row each; an empty
table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

from chronolith.llm.exchange import Keys, bucket_count, corpus_bytes, exchange, into_chunks, narrow
from chronolith.llm.text import pretokens
from chronolith.session import prepare

#: Characters of text that are cut into pre-tokens at a time.
SLICE_CHARS = 1 << 19

_encoders: dict[bytes, tuple] = {}


def load_ranks(path: str) -> bytes:
    """The vocabulary file's bytes: at most some tens of thousands of lines, so small enough to broadcast."""
    with open(path, "rb") as file:
        return file.read()


def vocabulary(ranks_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks_file.splitlines() if line)}


def _encoder(ranks_file: bytes, pattern: str) -> tuple:
    """The encoder and the token-byte table, made once for each Python worker."""
    import tiktoken

    key = hashlib.sha256(ranks_file + pattern.encode()).digest()
    if key not in _encoders:
        ranks = vocabulary(ranks_file)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _encoders[key] = ranks, encoding.encode_ordinary, pa.array(table, pa.binary())
    return _encoders[key]


def chunk_words(chunk: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a chunk, every pre-token's index among them, and each document's first."""
    texts = pc.fill_null(chunk.column("text"), "").combine_chunks()
    size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    cuts = np.searchsorted(size, np.arange(SLICE_CHARS, (size[-1] if len(size) else 0) + SLICE_CHARS, SLICE_CHARS))
    pieces, first, at, done = [], [np.zeros(1, np.int64)], 0, 0
    for cut in dict.fromkeys(np.minimum(cuts + 1, len(texts)).tolist()):
        tokens, begin = pretokens(texts.slice(at, cut - at).to_pylist())
        pieces.append(tokens)
        first.append(begin[1:] + done)
        at, done = cut, done + len(tokens)
    if at < len(texts):
        first.append(np.full(len(texts) - at, done, np.int64))
    coded = pa.concat_arrays([pa.array([], pa.large_binary()), *pieces]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.concatenate(first)


def encode(docs: DataFrame, ranks_file: bytes, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every text and decode it again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` (array of int) and
    ``decoded`` (binary).
    """
    spark = prepare(docs.sparkSession)
    total = corpus_bytes(docs)
    chunks, buckets = into_chunks(docs, total), bucket_count(total)
    ranks: Broadcast = spark.sparkContext.broadcast(ranks_file)
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def keys_of(chunk: pa.Table) -> list[Keys]:
        return [Keys.of_bytes(chunk_words(chunk)[0])]

    def answer(kind: int, parts: list[pa.Table]) -> list[pa.Table]:
        known, encode_word, _ = _encoder(ranks.value, pattern)
        seen: dict[bytes, list[int]] = {}
        out = []
        for part in parts:
            ids = []
            for word in part.column("key").to_pylist():
                got = seen.get(word)
                if got is None:
                    rank = known.get(word)
                    got = seen[word] = [rank] if rank is not None else encode_word(word.decode("utf-8", "surrogatepass"))
                ids.append(got)
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((i for word in ids for i in word), np.int32, int(sizes.sum()))
            # One row of two lists: sizes and ids compress far better than a list's offsets do.
            out.append(pa.table({"sizes": pa.array([narrow(sizes)]), "ids": pa.array([narrow(flat)])}))
        return out

    def finish(chunk: pa.Table, answers: list[list[pa.Table]]) -> pa.Table:
        table = _encoder(ranks.value, pattern)[2]
        words, codes, first = chunk_words(chunk)
        place = Keys.of_bytes(words).restore(np.arange(len(words)), buckets)
        sizes, flat = (np.concatenate([t.column(c)[0].values.to_numpy() for t in answers[0]]).astype(np.int32) for c in ("sizes", "ids"))
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        ids = pa.ListArray.from_arrays(ends, flat).take(pa.array(place))
        sizes = np.diff(ids.offsets.to_numpy())
        flat = ids.flatten()
        decimal = _joined(pc.binary_join_element_wise(flat.cast(pa.string()), "", " "), sizes)
        decoded = _joined(table.take(flat), sizes)
        n_docs = chunk.num_rows
        counts, id_hash, text_hash, texts = np.zeros(n_docs, np.int64), [], [], []
        for k in range(n_docs):
            own = codes[first[k] : first[k + 1]]
            counts[k] = sizes[own].sum()
            id_hash.append(hashlib.sha256(_body(decimal, own)[:-1]).hexdigest())
            body = _body(decoded, own)
            text_hash.append(hashlib.sha256(body).hexdigest())
            if with_ids:
                texts.append(bytes(body))
        columns = {"doc_id": chunk.column("doc_id"), "n_tokens": counts, "ids_sha256": pa.array(id_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
        if with_ids:
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            columns |= {"ids": pa.ListArray.from_arrays(ends, ids.take(pa.array(codes)).flatten()), "decoded": pa.array(texts, pa.binary())}
        return pa.table(columns)

    schema = f"doc_id {doc_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return exchange(chunks, buckets, keys_of, answer, finish, schema)


def _joined(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Runs of ``sizes`` neighbouring values, each joined into one."""
    values = values.cast(pa.large_binary())
    if not len(values):
        return pa.array([b""] * len(sizes), pa.large_binary())
    offset = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offset[ends].copy()), values.buffers()[2]])


def _body(words: pa.Array, codes: np.ndarray) -> memoryview:
    """The chosen words one after another."""
    taken = words.take(pa.array(codes))
    if not len(taken) or taken.buffers()[2] is None:
        return memoryview(b"")
    offset = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
    return memoryview(taken.buffers()[2])[int(offset[0]) : int(offset[-1])]
