"""Language ID by a linear-chain conditional random field over words.

A word's emission scores are sums of hashed weights of its affixes, character n-grams and itself (the lexicon);
transitions between the languages of neighbouring words are learned with them from sequences that are spliced from
texts of different languages, so code-switched text is labelled word by word by forward-backward. A document's
language is the one with the greatest mean marginal over its words, and its score is that mean's share of all languages'.

Beside the languages stands a background label, trained on segments whose letters are dealt anew at random: letters that
form words of no language. It is never predicted, but texts whose words are nearly all background are rejected by
``keep_identified``, whatever the number of languages; texts in several languages are not.

Training uses a bounded sample: at most ``SAMPLE`` documents of each language of the training fold, however rare, from
each at most ``SEGMENTS`` evenly spaced segments of ``SEGMENT_WORDS`` words; a longer run without white space than
``PIECE_LETTERS`` counts as several words. The driver holds the words' forms; rounds take them in blocks.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is every text if no document teaches
anything; repeated rows give a row each; an empty table gives no rows; other columns are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.rows import annotate, slices, unwrap
from chronolith.llm.sampling import sampled_of_each, with_texts
from chronolith.llm.text import _classes, mix
from chronolith.session import prepare

SAMPLE, SEGMENTS, SEGMENT_WORDS, PIECE_LETTERS = 1000, 4, 40, 32
#: Bytes of text whose words run through the field in step, and those whose emissions are scored at a time.
STEP_BYTES, SCORED_BYTES = 4 << 20, 1 << 20
#: Words whose forms or features are made at a time, and words of sequences whose marginals are in training.
BLOCK_WORDS, BLOCK_SEQUENCES = 1 << 14, 1 << 17
#: Hashed features.
FEATURES = 1 << 16
UNDETERMINED = "und"
#: Documents whose background has a mean marginal of this or more are rejected.
REJECT = 0.9


@lru_cache(1)
def _lower_letters() -> np.ndarray:
    """The lower-case form of each letter (where it is one character), 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for code in np.flatnonzero(_classes() == 1).tolist():
        low = chr(code).lower()
        table[code] = ord(low) if len(low) == 1 else code
    return table


@dataclass
class Letters:
    """Words (runs of letters) of some texts: code points, spans, and each text's first word."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def letter_words(texts: list[str]) -> Letters:
    joined = "\n".join(texts) + "\n"
    points = _lower_letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edge = np.flatnonzero(np.diff((points > 0).view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return Letters(points, start, end, np.searchsorted(start, begin))


def word_features(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: ``(feature, word)`` pairs, sorted by word.

    With boundary marks, a word's n-grams of one to four characters hold its prefixes and suffixes of up to three;
    the whole word is the lexicon entry.
    """
    size = end - start
    # Each word between two marks, all words in one array.
    begin = np.concatenate(([0], np.cumsum(size + 2)))
    flat = np.zeros(begin[-1], np.uint64)
    owner = np.repeat(np.arange(len(size)), size + 2)
    inner = np.arange(begin[-1]) - begin[:-1][owner]
    letter = (inner > 0) & (inner <= size[owner])
    flat[letter] = points[start[owner[letter]] + inner[letter] - 1]
    flat[~letter] = 1
    left = begin[1:][owner] - np.arange(begin[-1])
    found, words = [], []
    with np.errstate(over="ignore"):
        gram = np.zeros(len(flat), np.uint64)
        for n in range(1, 5):
            shifted = np.concatenate((flat[n - 1 :], np.zeros(n - 1, np.uint64)))
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)
            fits = left >= n if n > 1 else letter
            found.append(mix(gram[fits]) % np.uint64(FEATURES))
            words.append(owner[fits])
        whole = np.add.reduceat(mix(flat + (inner.astype(np.uint64) << np.uint64(21))), begin[:-1]) if len(size) else np.zeros(0, np.uint64)
        found.append(mix(whole) % np.uint64(FEATURES))
        words.append(np.arange(len(size)))
    feature, word = np.concatenate(found).astype(np.int32), np.concatenate(words)
    order = np.argsort(word, kind="stable")
    return feature[order], word[order]


def distinct_words(found: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one word of each form, and each word's form."""
    size = found.end - found.start
    key = np.empty(len(size), np.uint64)
    for low in range(0, len(size), BLOCK_WORDS):
        part = size[low : low + BLOCK_WORDS]
        inner = _inner(part)
        at = np.repeat(found.start[low : low + BLOCK_WORDS], part) + inner
        with np.errstate(over="ignore"):
            # Position within the word enters as a factor, so order matters.
            digit = mix(found.points[at].astype(np.uint64) + np.uint64(1)) + inner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            key[low : low + BLOCK_WORDS] = np.add.reduceat(mix(digit), np.cumsum(part) - part)
    _, first, form = np.unique(key, return_index=True, return_inverse=True)
    return first, form


def _inner(size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)


@dataclass
class Crf:
    """Languages, feature weights (features x labels: the languages, then the background if it was trained), transitions."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, found: Letters) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each form, and each word's form."""
        first, form = distinct_words(found)
        feature, word = word_features(found.points, found.start[first], found.end[first])
        scores = np.zeros((len(first), self.weights.shape[1]), np.float32)
        if len(first):
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            scores = np.add.reduceat(self.weights[feature], begins, axis=0)
            scores /= np.sqrt(np.diff(begins, append=len(word)))[:, None]
        return scores, form


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, count: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals by forward-backward, all sequences in step; and, if asked for, the expected transitions.

    ``scores``: a row for each word; sequence ``k`` owns rows ``first[k]:first[k + 1]``.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    size, start = size[size > 0], start[size > 0]
    n_labels = scores.shape[1]
    emission = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    step = np.exp(transitions).astype(emission.dtype)
    forward, backward = np.empty_like(emission), np.empty_like(emission)
    live = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")
    state = np.empty((0, n_labels), emission.dtype)
    for t, n in enumerate(live.tolist()):
        rows = start[:n] + t
        state = emission[rows] if t == 0 else (state[:n] @ step) * emission[rows]
        state /= state.sum(1, keepdims=True)
        forward[rows] = state
    expected = np.zeros_like(step, dtype=np.float64)
    state = np.ones((0, n_labels), emission.dtype)
    for t in range(len(live) - 1, -1, -1):
        n = int(live[t])
        rows = start[:n] + t
        fresh = np.ones((n, n_labels), emission.dtype)
        if len(state):
            m = len(state)
            ahead = emission[rows[:m] + 1] * state
            fresh[:m] = ahead @ step.T
            if count:
                joint = forward[rows[:m]][:, :, None] * step[None] * ahead[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            fresh[:m] /= fresh[:m].sum(1, keepdims=True)
        backward[rows] = fresh
        state = fresh
    both = forward * backward
    return both / both.sum(1, keepdims=True), expected


def blocks_of_features(found: Letters, first_form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of one word of each form, and their number for each form."""
    features, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for low in range(0, len(first_form), BLOCK_WORDS):
        at = first_form[low : low + BLOCK_WORDS]
        feature, word = word_features(found.points, found.start[at], found.end[at])
        features.append(feature)
        sizes.append(np.bincount(word, minlength=len(at)))
    return np.concatenate(features), np.concatenate(sizes)


def redealt(segments: list[tuple[str, str]], share: float) -> list[str]:
    """A share of the segments, evenly spaced, with the letters of each dealt anew over its words."""
    out, chance = [], np.random.default_rng(17)
    for k in range(round(len(segments) * share)):
        text = segments[int(k / share)][1]
        at = [i for i, c in enumerate(text) if c.isalpha()]
        letters = list(text)
        for i, j in zip(at, chance.permutation(at).tolist(), strict=True):
            letters[i] = text[j]
        out.append("".join(letters))
    return out


def train(segments: list[tuple[str, str]], rounds: int = 40, rate: float = 0.5, background: bool = False) -> Crf | None:
    """Fit the field to ``(language, segment)`` pairs by gradient ascent on the sequences' log likelihood; with
    ``background``, to as many segments of redealt letters as a language has on average as well."""
    languages = sorted({label for label, _ in segments})
    if not languages:
        return None
    labels: list[str | None] = [*languages, None] if background else [*languages]
    if background:
        segments = segments + [(None, text) for text in redealt(segments, 1 / len(languages))]
    target = np.array([labels.index(label) for label, _ in segments])
    found = letter_words([text for _, text in segments])
    first_form, form = distinct_words(found)
    feature, repeat = blocks_of_features(found, first_form)
    begins = np.cumsum(repeat) - repeat
    scale = np.sqrt(repeat)[:, None]
    gold = np.repeat(target, np.diff(found.first))
    # Sequences of four segments in an order that mixes languages: the field sees switches within a sequence.
    order = np.random.default_rng(11).permutation(len(segments))
    pieces = [np.arange(found.first[k], found.first[k + 1]) for k in order]
    rows = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    first = np.append(ends[:-1:4], ends[-1])
    model = Crf(languages, np.zeros((FEATURES, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    if not len(rows):
        return model
    inside = np.ones(len(rows), bool)
    inside[first[:-1][first[:-1] < len(rows)]] = False
    seen = np.zeros((len(labels), len(labels)))
    at = np.flatnonzero(inside)
    np.add.at(seen, (gold[rows[at - 1]], gold[rows[at]]), 1)
    square, square_t = np.zeros_like(model.weights), np.zeros_like(seen)
    # Whole sequences, about BLOCK_SEQUENCES words at a time; forms likewise.
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(rows), BLOCK_SEQUENCES)), len(first) - 1))
    shapes = [(low, min(low + BLOCK_WORDS, len(first_form))) for low in range(0, len(first_form), BLOCK_WORDS)]
    span = lambda low, high: slice(int(begins[low]), int(begins[high - 1] + repeat[high - 1]))
    scores = np.empty((len(first_form), len(labels)), np.float32)
    for _ in range(rounds):
        for low, high in shapes:
            scores[low:high] = np.add.reduceat(model.weights[feature[span(low, high)]], begins[low:high] - begins[low], axis=0) / scale[low:high]
        of_form, expected = np.zeros((len(first_form), len(labels))), np.zeros_like(seen)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = rows[first[low] : first[high]]
            if not len(part):
                continue
            belief, moved = marginals(scores[form[part]], first[low : high + 1] - first[low], model.transitions, count=True)
            expected += moved
            rest = -belief.astype(np.float64)
            rest[np.arange(len(part)), gold[part]] += 1
            np.add.at(of_form, form[part], rest)
        of_form /= scale
        gradient = np.zeros(model.weights.shape)
        for low, high in shapes:
            for k in range(len(labels)):
                gradient[:, k] += np.bincount(feature[span(low, high)], np.repeat(of_form[low:high, k], repeat[low:high]), FEATURES)
        gradient = gradient / len(rows) - 1e-6 * model.weights
        square += gradient**2
        model.weights += (rate * gradient / (np.sqrt(square) + 1e-8)).astype(np.float32)
        step = (seen - expected) / max(1, len(at)) - 1e-4 * model.transitions
        square_t += step**2
        model.transitions += rate * step / (np.sqrt(square_t) + 1e-8)
    return model


def segments_of(text: str) -> list[str]:
    """Evenly spaced segments of at most ``SEGMENT_WORDS`` words, or pieces of words, of ``PIECE_LETTERS`` at most."""
    pieces = [(" " if not at else "") + word[at : at + PIECE_LETTERS] for word in text.split() for at in range(0, len(word), PIECE_LETTERS)]
    last = max(0, len(pieces) - SEGMENT_WORDS)
    return ["".join(pieces[at : at + SEGMENT_WORDS]).strip() for at in sorted({last * k // max(1, SEGMENTS - 1) for k in range(SEGMENTS)})]


def learn(docs: DataFrame, training: Column) -> Crf | None:
    """Train on the bounded sample of the documents for which ``training`` holds."""
    prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, segments = [], []
            for text, language in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True):
                for segment in segments_of(text or ""):
                    languages.append(language)
                    segments.append(segment)
            yield pa.record_batch({"language": pa.array(languages, pa.string()), "segment": pa.array(segments, pa.string())})

    sample = with_texts(docs, sampled_of_each(docs.where(training), "lang", SAMPLE)).select("text", F.col("target").cast("string").alias("target"))
    rows = sample.mapInArrow(cut, "language string, segment string").collect()  # at most SAMPLE * SEGMENTS segments of each language
    return train(sorted((r.language, r.segment) for r in rows), background=True)


def label_words(text: str, model: Crf) -> list[tuple[str, str]]:
    """Each word of a text with its language."""
    found = letter_words([text])
    scores, form = model.emissions(found)
    if not len(form):
        return []
    belief, _ = marginals(scores[form], found.first, model.transitions)
    spelled = [text_of(found, k) for k in range(len(found.start))]
    return [(w, model.labels[k]) for w, k in zip(spelled, belief[:, : len(model.labels)].argmax(1).tolist(), strict=True)]


def text_of(found: Letters, k: int) -> str:
    return "".join(map(chr, found.points[found.start[k] : found.end[k]].tolist()))


def identify(docs: DataFrame, model: Crf | None) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``lang_pred, score, background``."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # FEATURES x labels numbers

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        field = shared.value
        n = batch.num_rows
        predicted, score, background = np.full(n, -1), np.zeros(n), np.zeros(n)
        if field is not None:
            scores, size = [], []
            for part in slices(batch, SCORED_BYTES):
                found = letter_words(pc.fill_null(part.column("text"), "").to_pylist())
                of_form, form = field.emissions(found)
                scores.append(of_form[form])
                size.append(np.diff(found.first))
            scores, size = np.concatenate(scores), np.concatenate(size)
            if len(scores):
                belief, _ = marginals(scores, np.concatenate(([0], np.cumsum(size))), field.transitions)
                owner = np.repeat(np.arange(n), size)
                mean = np.stack([np.bincount(owner, belief[:, k], n) for k in range(belief.shape[1])], 1) / np.maximum(size, 1)[:, None]
                spoken = mean[:, : len(field.labels)]
                predicted = np.where(size > 0, spoken.argmax(1), -1)
                score = np.where(size > 0, np.minimum(spoken.max(1) / np.maximum(spoken.sum(1), 1e-300), 1.0), 0.0)
                background = np.minimum(mean[:, len(field.labels) :].sum(1), 1.0)
        names = [UNDETERMINED if k < 0 else field.labels[k] for k in predicted.tolist()]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "background": pa.array(background)}

    return annotate(docs, compute, "lang_pred string, score double, background double", STEP_BYTES)


def keep_identified(docs: DataFrame, model: Crf | None) -> DataFrame:
    """The documents that are in a language: with a letter, and not nearly all background. Their ``lang``, if they have
    that column, becomes the one predicted."""
    kept = identify(docs, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("background") < REJECT))
    if "lang" not in docs.columns:
        return unwrap(kept)
    named = F.col("lang_pred").cast(docs.schema["lang"].dataType).alias("lang")
    return kept.select(*(named if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))
