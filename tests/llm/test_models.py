"""The trained models: their queries against plain loops, gradients, and held-out figures."""

import math
import os
import zlib

import numpy as np
import pytest

import __spark_entry__
from chronolith.llm import language, main_text, quality
from chronolith.llm.sampling import remainder

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def table(spark, name, folder=SF):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus


def test_attention_gradient():
    chance = np.random.default_rng(4)
    features, first, labels = chance.normal(size=(9, quality.FEATURES)), np.array([0, 4, 6, 9]), np.array([1.0, 0.0, 1.0])
    before = quality.train(features, first, labels, rounds=0)
    steps, loss = {}, lambda: float(np.mean([-math.log(p if y else 1 - p) for p, y in zip(before.score(features, first), labels)]))
    for name in ("encode", "gate", "value", "attend", "score", "score_bias"):
        before.params[name] = before.params[name].astype(np.float64)
    after = quality.train(features, first, labels, rounds=1)  # Adam's first step is the gradient's sign
    for name in ("encode", "gate", "value", "attend", "score"):
        flat = before.params[name].reshape(-1)
        for k in chance.choice(len(flat), min(6, len(flat)), replace=False):
            kept, h = flat[k], 1e-4
            flat[k] = kept + h
            up = loss() + 5e-4 * flat[k] ** 2
            flat[k] = kept - h
            slope = (up - loss() - 5e-4 * flat[k] ** 2) / (2 * h)
            flat[k] = kept
            steps[name, int(k)] = (slope, float(after.params[name].reshape(-1)[k] - kept))
    clear = [(slope, step) for slope, step in steps.values() if abs(slope) > 1e-5]
    assert len(clear) > 10 and all(slope * step < 0 for slope, step in clear)


def plain_quality(text, model):
    """One text's score: its passages' features and the gated attention, loop by loop."""
    data = (text or "").encode()
    places, at = [], 0
    for word in data.split():
        at = data.index(word, at)
        places.append((at, word.lower()))
        at += len(word)
    starts = [0] + [places[k][0] for k in range(64, len(places), 64)]
    rows = []
    for number, low in enumerate(starts):
        high = starts[number + 1] if number + 1 < len(starts) else len(data)
        counts = np.zeros((16, 16))
        for i in range(low, min(high, len(data) - 1)):
            counts[quality._CLASS[data[i]], quality._CLASS[data[i + 1]]] += 1
        own = [w for _, w in places[64 * number : 64 * number + 64]]
        before = places[64 * number - 1][1] if number else None
        same = sum(w == (own[k - 1] if k else before) for k, w in enumerate(own))
        n = max(1, len(own))
        rows.append([*np.sqrt(counts / max(1, counts.sum())).ravel(), same / n, len(set(own)) / n, min(1, sum(map(len, own)) / n / 16), len(own) / 64])
    p, energy, hidden = model.params, [], []
    for row in rows:
        h = np.tanh(((np.array(row) - model.mean) / model.spread) @ p["encode"] + p["encode_bias"])
        energy.append(math.exp(float((1 / (1 + np.exp(-(h @ p["gate"]))) * np.tanh(h @ p["value"])) @ p["attend"])))
        hidden.append(h)
    bag = sum(e * h for e, h in zip(energy, hidden)) / sum(energy)
    return 1 / (1 + math.exp(-float(bag @ p["score"] + p["score_bias"])))


def test_quality_query_equals_plain_loops(spark):
    docs = table(spark, "documents")
    model = quality.learn(docs, table(spark, "labels").where(remainder(4) != 2))
    got = {r.doc_id: r for r in __spark_entry__.queries()["op5_mil_quality"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    plain = {r.doc_id: plain_quality(r.text, model) for r in rows if r.text is None or r.text.isascii()}
    assert len(plain) > 50
    for doc, score in plain.items():
        assert got[doc].score == pytest.approx(score, abs=2e-3) and got[doc].held_out == (fold(doc, 4) == 2)
        assert got[doc].predicted == int(got[doc].score >= 0.7)


def plain_language(text, model):
    """One text's mean marginals by forward and backward sums over its words, loop by loop."""
    found = language.letter_words([text or ""])
    scores = []
    for a, b in zip(found.start, found.end):
        feature, _ = language.word_features(found.points, np.array([a]), np.array([b]))
        scores.append(model.weights[feature].astype(float).sum(0) / math.sqrt(len(feature)))
    if not scores:
        return None
    n, step = len(scores), np.array(model.transitions, float)
    size = len(step)
    forward, backward = [scores[0]], [np.zeros(size)]
    total = lambda x: float(np.logaddexp.reduce(x))
    for k in range(1, n):
        forward.append(np.array([scores[k][y] + total([forward[-1][x] + step[x][y] for x in range(size)]) for y in range(size)]))
        backward.append(np.array([total([step[x][y] + scores[n - k][y] + backward[-1][y] for y in range(size)]) for x in range(size)]))
    backward.reverse()
    mean = sum(np.exp(f + b - total(f + b)) for f, b in zip(forward, backward)) / n
    return mean


def test_language_query_equals_plain_loops(spark):
    docs = table(spark, "documents")
    model = language.learn(docs, remainder(4) != 2)
    rows = [r for r in docs.collect() if len(r.text or "") < 1500]
    got = {r.doc_id: r for r in __spark_entry__.queries()["op8_language_crf"](spark, SF).collect()}
    assert len(rows) > 50
    for r in rows:
        mean = plain_language(r.text, model)
        if mean is None:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        spoken = mean[: len(model.labels)]
        assert got[r.doc_id].score == pytest.approx(spoken.max() / spoken.sum(), abs=2e-3)
        assert got[r.doc_id].lang_pred == model.labels[int(spoken.argmax())] and got[r.doc_id].held_out == (fold(r.doc_id, 4) == 2)


def plain_main_text(html, weights, edges):
    """A page's text by sums over the tree, node by node."""
    tree = main_text.parse(html)
    forest = main_text.Forest([tree])
    n, below = len(tree.tags), [[] for _ in tree.tags]
    for k in range(1, n):
        below[tree.parents[k]].append(k)
    own = [[0.0, float(sum(weights[f] for f in forest.feature[forest.node == k]))] for k in range(n)]
    pair = lambda k, x, y: edges[int(tree.tags[k] == main_text.TEXT)][x][y]
    up = [None] * n
    for k in range(n - 1, -1, -1):  # children stand behind their parents
        belief = [own[k][y] + sum(up[c][y] for c in below[k]) for y in (0, 1)]
        up[k] = [float(np.logaddexp(pair(k, x, 0) + belief[0], pair(k, x, 1) + belief[1])) for x in (0, 1)]
        own[k].append(belief)
    full = [own[0][2]] + [None] * (n - 1)
    for k in range(1, n):
        rest = [full[tree.parents[k]][x] - up[k][x] for x in (0, 1)]
        full[k] = [float(np.logaddexp(rest[0] + pair(k, 0, y), rest[1] + pair(k, 1, y))) + own[k][2][y] for y in (0, 1)]
    blocks = {}
    for k in range(n):
        if tree.tags[k] == main_text.TEXT and full[k][1] >= full[k][0]:
            blocks.setdefault(tree.blocks[k], []).append(tree.texts[k])
    return " ".join(t for t in (" ".join("".join(parts).split()) for parts in blocks.values()) if t)


def test_main_text_query_equals_plain_sums(spark):
    got = {r.page_id: r for r in __spark_entry__.queries()["op9_main_text"](spark, SF).collect()}
    pages = table(spark, "pages").collect()
    assert len(got) == len(pages)
    weights, edges = main_text.model()
    for r in pages[:80]:
        assert got[r.page_id].text == plain_main_text(r.html or "", weights, edges) and got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test data")
def test_held_out_figures(spark):
    """PPM beats the word unigram on texts that it has not seen; language and quality are learned."""
    scored = __spark_entry__.queries()["op1_ppm"](spark, LARGE).where("held_out").selectExpr("sum(score) AS ppm", "sum(base_score) AS base", "avg(CAST(score > base_score AS DOUBLE)) AS better").first()
    assert scored.ppm > 0.97 * scored.base and scored.better > 0.75  # both are negative
    told = __spark_entry__.queries()["op8_language_crf"](spark, LARGE).where("held_out").join(table(spark, "documents", LARGE), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    assert told.selectExpr("avg(CAST(lang_pred = lang AS DOUBLE)) AS a").first().a > 0.99
    judged = __spark_entry__.queries()["op5_mil_quality"](spark, LARGE).where("held_out").join(table(spark, "labels", LARGE), "doc_id")
    assert judged.selectExpr("avg(CAST(predicted = quality AS DOUBLE)) AS a").first().a > 0.97
