"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and
texts are escaped reversibly: between ``<`` and ``|`` stands one more backslash than before, so no escaped text
holds ``<|``. The rendering is encoded once with character offsets; the three marks are tokens of their own, so
tokens never straddle a text's bounds, and sorted text spans are intersected with token spans by binary search to
give the loss mask of the assistant's texts.

Rows are sorted by conversation and turn and streamed. A conversation beyond ``PART_CHARS`` is encoded in parts cut
between turns, which gives the same tokens, as marks always end a pre-token; memory is bounded by a part.

Edge cases: a null text or role is empty; rows of one turn are ordered by role, then text; repeated rows are turns
of their own; a null conversation id is a conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronolith.llm.rows import arrow_type
from chronolith.session import prepare

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"
PART_CHARS = 1 << 20

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_READ = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)

_tokenizers: dict[int, object] = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of ``(role, text)`` turns, and the spans of the trained texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        lead, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == TRAINED_ROLE:
            spans.append((at + len(lead), at + len(lead) + len(body)))
        out += [lead, body, END]
        at += len(lead) + len(body) + len(END)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _READ.findall(formatted)]


def tokenizer(definition: str):
    """The tokenizer with the marks added and offsets that cover every character; made once for each worker."""
    from tokenizers import Tokenizer, processors

    key = hash(definition)
    if key not in _tokenizers:
        made = Tokenizer.from_str(definition)
        made.add_special_tokens([TURN, TEXT, END])
        made.post_processor = processors.ByteLevel(trim_offsets=False)
        _tokenizers[key] = made
    return _tokenizers[key]


@dataclass
class Part:
    """A formatted run of turns: text, token ids, token spans, and which tokens are trained."""

    text: str
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    mask: np.ndarray
    trained: list[tuple[int, int]]


def encode(turns: list[tuple[str, str]], definition: str) -> Part:
    text, spans = render(turns)
    found = tokenizer(definition).encode(text, add_special_tokens=False)
    ids, offsets = np.array(found.ids, np.int32), np.array(found.offsets, np.int64).reshape(-1, 2)
    start, end = offsets[:, 0], offsets[:, 1]
    mask = np.zeros(len(ids), bool)
    trained = []
    for low, high in spans:
        first, last = int(np.searchsorted(end, low, "right")), int(np.searchsorted(start, high, "left"))
        if last > first and high > low:
            mask[first:last] = True
            trained.append((first, last))
    return Part(text, ids, start, end, mask, trained)


def loss_texts(part: Part) -> list[str]:
    """The trained texts, read from the spans of the masked tokens."""
    return [unescape(part.text[int(part.start[a]) : int(part.end[b - 1])]) for a, b in part.trained]


def _parts(batches: Iterator[pa.RecordBatch], definition: str) -> Iterator[tuple[object, bool, Part]]:
    """``(conversation, ends, part)`` of rows sorted by conversation and turn."""
    turns: list[tuple[str, str]] = []
    current, size = None, 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and conv != current:
                yield current, True, encode(turns, definition)
                turns, size = [], 0
            elif size > PART_CHARS:
                yield current, False, encode(turns, definition)
                turns, size = [], 0
            current = conv
            turns.append((role or "", text or ""))
            size += len(turns[-1][1])
    if turns:
        yield current, True, encode(turns, definition)


def _sorted(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, definition: str) -> DataFrame:
    """``conv_id, part, formatted, ids, loss_mask``: the formatted conversations with tokens and masks."""
    spark = prepare(conversations.sparkSession)
    shared = spark.sparkContext.broadcast(definition)  # a vocabulary file
    conv_type = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for conv, ends, part in _parts(batches, shared.value):
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": number, "formatted": part.text, "ids": part.ids.tolist(), "loss_mask": part.mask.tolist()}], out)
            number = 0 if ends else number + 1

    out = pa.schema({"conv_id": arrow_type(conversations, "conv_id"), "part": pa.int32(), "formatted": pa.string(), "ids": pa.list_(pa.int32()), "loss_mask": pa.list_(pa.bool_())})
    return _sorted(conversations).mapInArrow(run, f"conv_id {conv_type}, part int, formatted string, ids array<int>, loss_mask array<boolean>")


def digests(conversations: DataFrame, definition: str) -> DataFrame:
    """For every conversation, digests of the turns and trained texts that are read back from the formatted text."""
    spark = prepare(conversations.sparkSession)
    shared = spark.sparkContext.broadcast(definition)
    conv_type = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = chars = n_tokens = n_loss = 0
        rows = []
        for conv, ends, part in _parts(batches, shared.value):
            for role, text in read_back(part.text):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n_turns += 1
            for text in loss_texts(part):
                loss.update(text.encode("utf-8", "surrogatepass"))
                loss_chars += len(text)
            chars += len(part.text)
            n_tokens += len(part.ids)
            n_loss += int(part.mask.sum())
            if ends:
                rows.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_tokens, n_loss))
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n_turns = loss_chars = chars = n_tokens = n_loss = 0
            if len(rows) >= 1000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
    types = [arrow_type(conversations, "conv_id"), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    schema = f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    return _sorted(conversations).mapInArrow(run, schema)
