"""The distinct-key exchange behind the operators that need one answer per distinct token of the whole corpus.

Documents are dealt into chunks of bounded size. Each chunk sends its *distinct* keys, not its tokens, to buckets
chosen by the keys' hash (shuffle one); a bucket answers each distinct key once and returns, for every chunk, the
answers in the order in which that chunk's keys sort (shuffle two); the chunk then reassembles its documents by
position from its own text. A frequent key costs one entry a chunk, so no key makes a task hot, and what moves
besides the compressed text is a few bytes for each distinct key of a chunk.

Chunks grow with the fourth root of the corpus (14 MB at 1 GB, 250 MB at 100 TB) and buckets with nearly the number
of chunks, so that a chunk's and a bucket's memory stay bounded while the pieces between them do not become too
many and small: at 100 TB some 400,000 chunks of 90,000 pieces of a few dozen keys each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.text import hash_array

#: Bytes of text in a chunk: a 64th of the corpus, but no less than the first and no more than the second number,
#: which is for a corpus of 1 MB and grows with the fourth root.
CHUNK_BYTES = (4 << 20, 5 << 19)

#: Neighbouring rows of a file that go to one chunk together.
NEIGHBOURS = 64

#: Compression of keys and answers, which are worth more effort, and of texts.
KEYS, TEXTS = 9, 3


def pack(table: pa.Table, level: int = KEYS) -> bytes:
    """A table as compressed Arrow IPC bytes."""
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def corpus_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in ``docs``: sizes chunks and buckets, changes no result."""
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def chunk_count(total: int) -> int:
    least, most = CHUNK_BYTES
    return max(1, math.ceil(total / max(least, min(total / 64, most * (total / 2**20) ** 0.25))))


def _place(docs: DataFrame) -> Column:
    """A hash of where a row stands: of its run of neighbours in its file, so that equal rows are dealt apart; of its id
    and text where the table is no file, so that equal rows stay together. Either is the same whenever it is asked."""
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        docs.select(file, row).schema  # noqa: B018
    except AnalysisException:
        return F.xxhash64("doc_id", "text")
    return F.xxhash64(file, F.floor(row / NEIGHBOURS))


def into_chunks(docs: DataFrame, total: int, *columns: Column) -> DataFrame:
    """``(chunk, part)``: documents dealt evenly to chunks, ``doc_id, text, ...`` of several in a compressed part."""
    chunk = F.pmod(_place(docs), F.lit(chunk_count(total))).cast("int").alias("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = batch.column("chunk").to_numpy()
            order = np.argsort(home, kind="stable")
            begin = np.flatnonzero(np.diff(home[order], prepend=-1))
            rows = pa.Table.from_batches([batch]).drop_columns(["chunk"])
            parts = [pack(rows.take(pa.array(own)), TEXTS) for own in np.split(order, begin[1:])] if len(order) else []
            yield pa.record_batch({"chunk": pa.array(home[order][begin], pa.int32()), "part": pa.array(parts, pa.binary())})

    return docs.select(chunk, "doc_id", "text", *columns).mapInArrow(run, "chunk int, part binary")


def opened(parts: pa.Table) -> pa.Table:
    """A chunk's documents."""
    return pa.concat_tables([unpack(part) for part in parts.column("part").to_pylist()])


def bucket_count(total: int) -> int:
    return max(4, math.ceil(1.5 * chunk_count(total) ** 0.85))


@dataclass
class Keys:
    """Distinct keys of a chunk, columns that go with them, and a hash that chooses each key's bucket."""

    keys: pa.Array
    home: np.ndarray
    columns: dict = field(default_factory=dict)

    @classmethod
    def of_bytes(cls, keys: pa.Array, columns: dict | None = None) -> Keys:
        return cls(keys, hash_array(keys) if len(keys) else np.zeros(0, np.uint64), columns or {})

    def order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The order that sorts the keys by bucket, then value; and where each bucket begins in it."""
        home = (self.home % np.uint64(buckets)).astype(np.int32)
        order = pc.sort_indices(pa.table({"home": home, "key": self.keys}), [("home", "ascending"), ("key", "ascending")]).to_numpy()
        return order, np.searchsorted(home[order], np.arange(buckets + 1))

    def restore(self, answers: np.ndarray, buckets: int) -> np.ndarray:
        """Answers in the order of ``keys``, from answers in bucket order."""
        order, _ = self.order(buckets)
        out = np.empty(len(order), answers.dtype)
        out[order] = answers
        return out


def exchange(
    chunks: DataFrame,
    buckets: int,
    keys_of: Callable[[pa.Table], list[Keys]],
    answer: Callable[..., list[pa.Table]],
    finish: Callable[[pa.Table, list[list[pa.Table]]], pa.Table],
    schema: str,
    known: DataFrame | None = None,
) -> DataFrame:
    """Run the exchange over ``chunks``, for one or more kinds of keys at once.

    ``keys_of(chunk)`` gives the chunk's distinct keys of each kind; ``answer(kind, parts)`` gets, for one bucket,
    every chunk's ``(key, ...)`` table and returns a table of answers for each, row for row; every bucket answers
    every chunk, if only with an empty table, so that metadata of the answers' schemas reaches all chunks.
    With ``known``, a table whose column ``bucket`` is a key's ``home`` modulo ``buckets`` plus ``kind * buckets``,
    ``answer`` gets that bucket's rows of it as a third argument. ``finish(chunk, answers)`` gets each kind's tables, bucket by bucket, in the order of ``Keys.order`` and returns the result's rows.
    """

    def send(key: tuple, chunk: pa.Table) -> pa.Table:
        homes, parts = [], []
        for kind, found in enumerate(keys_of(opened(chunk))):
            order, begin = found.order(buckets)
            table = pa.table({"key": found.keys, **found.columns}).take(order)
            for b in range(buckets):
                homes.append(kind * buckets + b)
                parts.append(pack(table.slice(begin[b], begin[b + 1] - begin[b])))
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(homes), pa.int32()), "bucket": pa.array(homes, pa.int32()), "part": pa.array(parts, pa.binary())})

    def respond(key: tuple, parts: pa.Table, *rows: pa.Table) -> pa.Table:
        answers = answer(key[0].as_py() // buckets, [unpack(b) for b in parts.column("part").to_pylist()], *rows)
        return pa.table({"chunk": parts.column("chunk"), "bucket": parts.column("bucket"), "answers": pa.array([pack(a) for a in answers], pa.binary())})

    def close(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        found = sorted(zip(replies.column("bucket").to_pylist(), replies.column("answers").to_pylist(), strict=True))
        kinds: dict[int, list[pa.Table]] = {}
        for bucket, blob in found:
            kinds.setdefault(bucket // buckets, []).append(unpack(blob))
        return finish(opened(chunk), [tables for _, tables in sorted(kinds.items())])

    def reply(key: tuple, parts: pa.Table) -> pa.Table:
        return respond(key, parts)

    def reply_known(key: tuple, parts: pa.Table, rows: pa.Table) -> pa.Table:
        return respond(key, parts, rows)

    sent = chunks.groupBy("chunk").applyInArrow(send, "chunk int, bucket int, part binary").groupBy("bucket")
    replies = "chunk int, bucket int, answers binary"
    replied = sent.applyInArrow(reply, replies) if known is None else sent.cogroup(known.groupBy("bucket")).applyInArrow(reply_known, replies)
    return chunks.groupBy("chunk").cogroup(replied.groupBy("chunk")).applyInArrow(close, schema)
