"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded (a layer over its shape
statistics), gated attention learned from document labels weighs the passages, and a logistic unit scores the
weighted representation: the label says only that something in the document decided it, and attention learns what.

A passage's features are relative frequencies of pairs of neighbouring character classes, and shares of repeated
words, so they hold for any language and for whole texts of any length.

Training uses a bounded sample: at most ``SAMPLE`` labelled documents, at most ``BAG`` evenly spaced passages each.
Scoring uses every passage.

Edge cases: a null or empty text is one empty passage, and has a score; without labels every score is 0.5; null
labels teach nothing; repeated rows give a row each; an empty table gives no rows; other columns are carried along
or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.rows import annotate, slices, unwrap
from chronolith.llm.sampling import sampled_ids, with_texts
from chronolith.llm.text import SPACED, hash_spans, raw_texts, words
from chronolith.session import prepare

PASSAGE_WORDS = 64
SAMPLE, BAG = 2000, 8
HIDDEN = 24
THRESHOLD = 0.7
CLASSES = 16
SHAPE = CLASSES * CLASSES
FEATURES = SHAPE + 4


def _class_table() -> np.ndarray:
    """Character class of a byte: letters by case, digits, spaces, kinds of punctuation."""
    table = np.full(256, 15, np.uint8)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "*#", "&%$", "'\"", "()[]{}<>", "-_/\\@=+~^"]
    for k, group in enumerate(groups):
        table[[ord(c) for c in group]] = k
    table[128:] = 0  # letters of any language look alike
    return table


_CLASS = _class_table()


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and each text's first passage."""
    found = words(texts, SPACED)
    count = np.maximum(1, -(-found.per_document // PASSAGE_WORDS))
    first = np.concatenate(([0], np.cumsum(count)))
    n = int(first[-1])
    out = np.zeros((n, FEATURES), np.float32)
    if not n:
        return out, first
    owner = np.repeat(np.arange(len(texts)), found.per_document)
    inner = np.arange(len(owner)) - found.first[:-1][owner]
    passage = first[:-1][owner] + inner // PASSAGE_WORDS
    raw = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
    # A byte belongs to the passage of the last word that began, from the text's first byte on.
    jump = np.zeros(len(raw) + 1, np.int32)
    opens = np.flatnonzero((inner % PASSAGE_WORDS == 0) & (inner > 0))
    jump[found.start[opens]] = 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joints = np.cumsum(lengths)[:-1]
    jump[joints] = 1
    of_byte = np.cumsum(jump[: len(raw)], dtype=np.int32)
    kind = _CLASS[raw]
    pair = kind[:-1].astype(np.int64) * CLASSES + kind[1:]
    inside = np.ones(len(raw) - 1, bool)
    inside[joints - 1] = False
    if len(joints):
        inside[np.maximum(joints - 2, 0)] = False
    inside[-1:] = False
    counts = np.bincount((of_byte[:-1].astype(np.int64) * SHAPE + pair)[inside], minlength=n * SHAPE).reshape(n, SHAPE)
    out[:, :SHAPE] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    if len(owner):
        hashed = hash_spans(found.data, found.start, found.end)
        total = np.maximum(1, np.bincount(passage, minlength=n))
        same = np.concatenate(([False], (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])))
        out[:, SHAPE] = np.bincount(passage, same, n) / total
        _, form = np.unique(hashed, return_inverse=True)
        fresh = np.unique(passage * (form.max() + 1) + form) // (form.max() + 1)
        out[:, SHAPE + 1] = np.bincount(fresh, minlength=n) / total
        out[:, SHAPE + 2] = np.minimum(1, np.bincount(passage, found.end - found.start, n) / total / 16)
        out[:, SHAPE + 3] = np.minimum(total, PASSAGE_WORDS) / PASSAGE_WORDS * (np.bincount(passage, minlength=n) > 0)
    return out, first


@dataclass
class Attention:
    """Encoder, gated attention and classifier weights."""

    mean: np.ndarray
    spread: np.ndarray
    params: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        x = (features - self.mean) / self.spread
        h = np.tanh(x @ p["encode"] + p["encode_bias"])
        gate, value = 1 / (1 + np.exp(-(h @ p["gate"]))), np.tanh(h @ p["value"])
        energy = (gate * value) @ p["attend"]
        begin = first[:-1]
        owner = np.repeat(np.arange(len(begin)), np.diff(first))
        energy = np.exp(energy - np.maximum.reduceat(energy, begin)[owner])
        weight = energy / np.add.reduceat(energy, begin)[owner]
        bag = np.add.reduceat(h * weight[:, None], begin, axis=0)
        logit = bag @ p["score"] + p["score_bias"]
        return {"x": x, "h": h, "gate": gate, "value": value, "weight": weight, "bag": bag, "logit": logit, "owner": owner}

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(features, first)["logit"], -60, 60)))


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.03) -> Attention | None:
    """Fit by Adam on the documents' log loss."""
    if not len(labels):
        return None
    random = np.random.default_rng(5)
    shape = {"encode": (FEATURES, HIDDEN), "encode_bias": (HIDDEN,), "gate": (HIDDEN, HIDDEN), "value": (HIDDEN, HIDDEN), "attend": (HIDDEN,), "score": (HIDDEN,), "score_bias": ()}
    params = {k: random.normal(0, 0.1, s) if len(s) and "bias" not in k else np.zeros(s) for k, s in shape.items()}
    params = {k: np.asarray(v, np.float32) for k, v in params.items()}
    model = Attention(features.mean(0), features.std(0) + np.float32(1e-2), params)
    m, v = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        f, p = model.forward(features, first), model.params
        d_logit = ((1 / (1 + np.exp(-np.clip(f["logit"], -60, 60))) - labels) / len(labels)).astype(np.float32)
        g = {"score": f["bag"].T @ d_logit, "score_bias": d_logit.sum()}
        d_bag = d_logit[:, None] * p["score"]
        d_weight = (f["h"] * d_bag[f["owner"]]).sum(1)
        d_h = f["weight"][:, None] * d_bag[f["owner"]]
        centre = np.add.reduceat(f["weight"] * d_weight, first[:-1])
        d_energy = f["weight"] * (d_weight - centre[f["owner"]])
        g["attend"] = (f["gate"] * f["value"]).T @ d_energy
        d_inner = d_energy[:, None] * p["attend"]
        d_gate = d_inner * f["value"] * f["gate"] * (1 - f["gate"])
        d_value = d_inner * f["gate"] * (1 - f["value"] ** 2)
        g["gate"], g["value"] = f["h"].T @ d_gate, f["h"].T @ d_value
        d_h += d_gate @ p["gate"].T + d_value @ p["value"].T
        d_x = d_h * (1 - f["h"] ** 2)
        g["encode"], g["encode_bias"] = f["x"].T @ d_x, d_x.sum(0)
        for k in shape:
            grad = g[k] + (1e-3 * p[k] if "bias" not in k else 0)
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            p[k] = np.asarray(p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8), np.float32)
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Attention | None:
    """Train on the bounded sample of ``labels`` (``doc_id, quality``)."""
    prepare(docs.sparkSession)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches if whole.num_rows for part in slices(whole)):
            found, first = passages(raw_texts(batch.column("text")))
            rows = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                chosen = a + np.unique(np.arange(BAG) * (b - a - 1) // (BAG - 1)) if b - a > BAG else np.arange(a, b)
                rows.append(found[chosen].astype(np.float16).tobytes())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "target": batch.column("target"), "bag": pa.array(rows, pa.binary())})

    sample = with_texts(docs, sampled_ids(labels, "quality", SAMPLE)).select(F.col("doc_id").cast("string"), F.col("target").cast("int"), "text")
    rows = sample.mapInArrow(bags, "doc_id string, target int, bag binary").collect()  # SAMPLE bags at most
    rows.sort(key=lambda r: (r.doc_id, r.target, r.bag))
    found = [np.frombuffer(r.bag, np.float16).reshape(-1, FEATURES).astype(np.float32) for r in rows]
    first = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
    return train(np.concatenate(found), first, np.array([float(r.target == 1) for r in rows])) if rows else None


def classify(docs: DataFrame, model: Attention | None) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``score, predicted``."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found, first = passages(raw_texts(batch.column("text")))
        score = shared.value.score(found, first) if shared.value is not None else np.full(len(first) - 1, 0.5)
        return {"score": pa.array(score.astype(float)), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))}

    return annotate(docs, compute, "score double, predicted int")


def keep_good(docs: DataFrame, model: Attention | None) -> DataFrame:
    """The documents that are predicted to be of good quality."""
    return unwrap(classify(docs, model).where("predicted = 1"))
