"""Vectorised text helpers used inside tasks: word spans, pre-token spans, span hashes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Bytes of words that end at ASCII white space.
SPACED = _table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words made of lower-case ASCII letters, digits and everything beyond ASCII.
ALNUM = _table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a few documents: ``data[start:end]`` each; document ``k`` owns words ``first[k]:first[k + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def per_document(self) -> np.ndarray:
        return np.diff(self.first)


def raw_texts(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()


def words(texts: list[bytes], table: np.ndarray) -> Words:
    """Lower-case A-Z and cut each text into maximal runs of the bytes in ``table``."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = LOWER[np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)] if texts else np.zeros(0, np.uint8)
    begin = np.concatenate(([0], np.cumsum(lengths)))
    inside = table[data]
    inside[begin[1:] - 1] = False  # the byte between two texts
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    return Words(data, start, end, np.searchsorted(start, begin))


def spans_to_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Spans of ``data`` as a binary array, in order."""
    length = end - start
    offset = np.concatenate(([0], np.cumsum(length)))
    if not len(start):
        return pa.array([], pa.large_binary())
    keep = np.zeros(len(data) + 1, np.int8)
    keep[start] += 1
    keep[end] -= 1
    body = data[np.cumsum(keep[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offset), pa.py_buffer(body)])


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(1)
def _digits() -> np.ndarray:
    return np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes whose spans are hashed at a time; a longer span is hashed whole.
HASHED_BYTES = 1 << 18


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span, equal for equal bytes wherever they stand. Spans come in order and
    don't overlap."""
    out, low = np.empty(len(start), np.uint64), 0
    while low < len(start):
        base = int(start[low])
        high = max(low + 1, int(np.searchsorted(end, base + HASHED_BYTES, "right")))
        part = data[base : int(end[high - 1])]
        a, b = start[low:high] - base, end[low:high] - base
        power, inverse = powers(len(part))
        with np.errstate(over="ignore"):
            total = prefix_sums(part, power[: len(part)])
            out[low:high] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        low = high
    return out


def prefix_sums(data: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Sums of the bytes' digits times ``factor`` before each place."""
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_digits()[data] * factor, out=total[1:])
    return total


def hash_parts(data: np.ndarray, size: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``hash_spans`` for spans inside words that stand one after another, ``size`` bytes each, in any order and as
    often as asked: the words are summed once."""
    place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    power, inverse = powers(int(size.max(initial=0)))
    total = prefix_sums(data, power[place])

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((total[end] - total[start]) * inverse[place[start]] + (end - start).astype(np.uint64))

    return of


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, or more, of the hash's base and of its inverse; only small tables are kept."""
    return _small_powers() if n <= HASHED_BYTES else _powers(n)


@lru_cache(1)
def _small_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(HASHED_BYTES)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base), dtype=np.uint64))) for base in (_BASE, inverse))


def hash_array(values: pa.Array) -> np.ndarray:
    """``hash_spans`` of a binary array without empty values."""
    offset = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    low = int(offset[0])
    data = np.frombuffer(values.buffers()[2], np.uint8)[low : int(offset[-1])] if len(values) else np.zeros(0, np.uint8)
    return hash_spans(data, offset[:-1] - low, offset[1:] - low)


#: Code points with the Unicode property White_Space. Fixed values.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


def _joins(lead: str, codes: np.ndarray) -> np.ndarray:
    """Which code points the tokenizer library's own expressions put into one pre-token after ``lead``.

    With a vocabulary of single bytes and of ``lead`` before any byte, a code point in ``lead``'s pre-token shows as
    a merged token.
    """
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {lead.encode() + bytes([b]): 256 + b for b in range(128, 256)}
    probe = tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]", mergeable_ranks=ranks, special_tokens={})
    found = np.array(probe.encode_ordinary("".join(f"{lead}{chr(c)}\n" for c in codes.tolist())))
    line = np.concatenate(([0], np.cumsum(found == 10)[:-1]))
    out = np.zeros(len(codes), bool)
    out[line[found >= 256]] = True
    return out


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point as the tokenizer library sees it: letter, number, white space or other."""
    table = np.zeros(0x110000, np.uint8)
    ascii_ = np.arange(128)
    table[[c for c in ascii_ if chr(c).isalpha()]] = _LETTER
    table[[c for c in ascii_ if chr(c).isdigit()]] = _NUMBER
    codes = np.concatenate((np.arange(128, 0xD800), np.arange(0xE000, 0x40000)))  # no letter or number lies beyond
    table[codes[_joins("a", codes)]] = _LETTER
    table[codes[_joins("1", codes)]] = _NUMBER
    table[list(WHITE_SPACE)] = _SPACE
    return table


def pretokens(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of ``public_tokenizers.PATTERN`` for each text, and the index of each text's first.

    The pattern's matches tile a text, so only the places where a match begins are computed, for all texts at
    once: where the class of characters changes, where a run of white space gives its last space to the next
    match, and around contractions.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bound = np.concatenate(([0], np.cumsum(sizes)))
    n = len(points)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    kind = _classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[bound] = True
    opens = begins.copy()  # a text begins here
    space = kind == _SPACE
    begins[1:n] |= kind[1:] != kind[:-1]
    # The last character of a run of white space before a visible one is its own match, or leads the next one.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~opens[1:n]
    begins[:n] |= last
    lead = last & (points == 0x20)
    at = np.flatnonzero(lead)
    begins[at + 1] = False
    # Contractions: an apostrophe that begins a match.
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        before = np.where(quote > 0, kind[quote - 1], _OTHER)
        fresh = opens[quote] | (before == _LETTER) | (before == _NUMBER) | ((before == _SPACE) & (points[quote - 1] != 0x20))
        padded = np.concatenate((points, np.zeros(3, np.uint32)))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~opens[quote + 1]
        long = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        inner = np.minimum(quote + 2, n)
        long &= ~opens[quote + 1] & ~opens[inner]
        for hit, size in ((fresh & short, 2), (fresh & long, 3)):
            q = quote[hit]
            begins[q] = True
            for k in range(1, size):
                begins[q + k] = False
            begins[q + size] = True
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    to_byte = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    begin = np.flatnonzero(begins)
    offset = to_byte[begin]
    data = "".join(texts).encode("utf-8", "surrogatepass")
    pieces = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(offset), pa.py_buffer(data)])
    return pieces, np.searchsorted(begin, bound)
