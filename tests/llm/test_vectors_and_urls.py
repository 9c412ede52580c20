"""URL verdicts, hard negatives and vector codes against plain loops, on odd rows and empty tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import hard_negatives, url_filter, vector_codes, vectors
from chronolith.llm.queries import URL_RULES

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHING = ["v", "norm", "n", "top", "ids", "code", "error", "score", "row", "text", "host"]


def vector_rows():
    """Ordinary rows, copies of one vector, ties, short, empty, null, infinite and huge vectors, ids and labels missing."""
    chance = random.Random(5)
    new = lambda n=8: [chance.uniform(-1, 1) for _ in range(n)]
    common = new()
    rows = [(k, [x * chance.choice([0.1, 1, 1, 5]) for x in new()], chance.randint(-2, 4)) for k in range(300)]
    rows += [(300 + k, common, 1 + k % 2) for k in range(150)]
    rows += [(450, new(3), 1), (451, [], 2), (452, None, 1), (453, [1.0, None], 1), (454, [math.nan] * 8, 1), (455, [math.inf] * 8, 1)]
    rows += [(456, new(), None), (None, new(), 1), (rows[50]), (rows[50]), (-50, new(), 0)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


def kept(rows, scale, dim=8):
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v):
            whole = [math.floor(scale * float(np.float32(x))) for x in v]
            yield i, whole + [0] * (dim - len(whole)), label


def mined(rows, modulus):
    rows = [r for r in kept(rows, 256) if r[0] is not None and r[2] is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, v, label in rows:
        if i % modulus == 0:
            scored = sorted(((-dot(v, w), j, m) for j, w, m in rows), key=lambda x: x[:2])
            for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
                fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
                out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 1e6])  # the second is worked out in whole numbers beyond floating point
def test_hard_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "BUCKET", 32)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 200)
    rows = [(i, v and [x if x is None else x * scale for x in v], m) for i, v, m in vector_rows()]
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, 10)
    assert hard_negatives.mine(table(spark, rows), F.col("vec_id") == 1000).count() == 0
    assert hard_negatives.mine(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_beyond_longs_become_the_nearest(spark):
    rows = [(0, [3e30, 1.0], 1), (1, [3e30, 2.0], 1), (2, [3e30, 3.0], 2)]
    assert hard_negatives.mine(table(spark, rows), F.col("vec_id") == 0).count() == 0  # a negative of the same score is over the window
    vectors_ = vectors.integral(table(spark, rows), 256)
    assert vectors.extent(vectors_)[2] == vectors.LARGEST
    coded, _ = vector_codes.compress(table(spark, [*rows, (3, [-3e30, 1.0], 2)]), n_parts=1, n_entries=1)
    told = {r.vec_id: (r.error, r.label_error) for r in vector_codes.with_label_errors(coded).collect()}
    assert told[3] == told[2] == (vectors.MOST, vectors.MOST)


def test_buckets_of_short_vectors_are_skipped():
    chance = np.random.default_rng(1)
    v = np.sort(chance.integers(1, 200, 4000))[::-1, None] * chance.normal(size=(4000, 6))
    v = np.floor(v).astype(np.int64)
    ids, labels = np.arange(4000), chance.integers(0, 3, 4000)
    block = hard_negatives.Block(ids[:50], labels[:50], v[:50])
    cut = [(float(np.sqrt((v[a : a + 100] ** 2).sum(1)).max()), ids[a : a + 100], labels[a : a + 100], v[a : a + 100]) for a in range(0, 4000, 100)]
    best, looked = hard_negatives.scan(block, np.full((50, 1), vectors.LEAST), np.full((50, 1), vectors.MOST), 5, True, iter(cut), True)
    for a in range(50):
        own = sorted((-int(v[a] @ v[k]), k) for k in range(4000) if labels[k] == labels[a] and k != a)[:5]
        assert [(-s, i) for s, i in zip(best[0].scores[a].tolist(), best[0].ids[a].tolist(), strict=True)] == own
    assert looked < 50 * 40 * 0.6


def lloyd(rows, n_parts, n_entries, rounds, scale, dim=8):
    rows = list(kept(rows, scale, dim))
    size = dim // n_parts
    parts = [[v[p * size : (p + 1) * size] for p in range(n_parts)] for _, v, _ in rows]
    seeds = sorted((r[0], r[1], k) for k, r in enumerate(rows) if r[0] is not None)[:n_entries]
    books = [[parts[k][p] for _, _, k in seeds] for p in range(n_parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(n_parts):
            groups = defaultdict(list)
            for x in parts:
                groups[nearest(x[p], books[p])].append(x[p])
            for e, group in groups.items():
                books[p][e] = [sum(c) // len(group) for c in zip(*group, strict=True)]
    codes = [[nearest(x[p], books[p]) for p in range(n_parts)] for x in parts]
    errors = [sum(far(x[p], books[p][c]) for p, c in enumerate(own)) for x, own in zip(parts, codes, strict=True)]
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    told = [(-99 if i is None else i, bytes(own).hex(), e, by_label[label]) for (i, _, label), own, e in zip(rows, codes, errors, strict=True)]
    return sorted(told), hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


@pytest.mark.parametrize(("n_parts", "n_entries", "rounds"), [(4, 16, 4), (2, 256, 3), (1, 1, 2), (4, 7, 0)])
def test_vector_codes(spark, monkeypatch, n_parts, n_entries, rounds):
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    rows = vector_rows()
    coded, entries = vector_codes.compress(table(spark, rows).repartition(3), n_parts, n_entries, rounds)
    got = sorted((-99 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.with_label_errors(coded).collect())
    assert (got, vector_codes.digest(entries)) == lloyd(rows, n_parts, n_entries, rounds, 1024)


def test_vector_codes_of_nothing_and_of_odd_lengths(spark):
    coded, entries = vector_codes.compress(table(spark, []))
    assert vector_codes.with_label_errors(coded).count() == 0 and vector_codes.digest(entries) == hashlib.sha256(b"").hexdigest()
    rows = [(k, [float(k), 1.0, 2.0], k) for k in range(5)]
    coded, entries = vector_codes.compress(table(spark, rows), n_parts=2, n_entries=2, scale=1)
    got = sorted((r.vec_id, r.code, r.error) for r in coded.collect())
    assert got == [(i, c, e) for i, c, e, _ in lloyd(rows, 2, 2, 4, 1, dim=4)[0]]


def test_heaps_scan_only_what_drift_has_violated():
    chance = np.random.default_rng(2)
    parts = np.floor(1000 * (chance.integers(0, 8, (2000, 1, 1)) * 3 + chance.normal(size=(2000, 1, 2)) * 0.3)).astype(np.int64)
    entries = parts[:16].transpose(1, 0, 2).copy()
    books, codes, slack, scanned = vector_codes.Books(entries, np.zeros((1, 16))), np.zeros((2000, 1), np.uint8), vector_codes.Slack.empty(1, 16), []
    for k in range(12):
        scanned.append(vector_codes.reassign(parts, codes, slack, books, k == 0, True))
        plain = vector_codes.distances(parts[:, 0], books.entries[0], True)
        assert (codes[:, 0] == plain.argmin(1)).all()
        means = books.entries.copy()
        for e in np.unique(codes):
            means[0, e] = parts[codes[:, 0] == e, 0].sum(0) // (codes == e).sum()
        books = books.moved(means)
    assert scanned[0] == 2000 and scanned[-1] < 500
    again = vector_codes.Slack.load(slack.dump(), 1, 16)
    assert again.heaps == slack.heaps


URLS = [None, "", "no scheme", "http://", "://org/x", "http://ORG", "http://org/", "http://a.ORG/fr?x=/de/#y", "http://example.org/es/1", "http://www.Example.org/en/1?q", "http://notorg/", "http://xexample.org/es/", "http://b.com/fr/2", "http://b.com/de/2",
        "a://b://c.com/fr/", "http://x.com#/fr/", "http://u@h.org:80/p", "http://net/é漢", "http://org/line\nbreak", "http://d.net/" + "long/" * 60_000]


def page_rows():
    chance = random.Random(4)
    word = lambda: "".join(chance.choice("aeinst") for _ in range(5))
    rows = [(k, u) for k, u in enumerate(URLS)]
    rows += [(100 + k, f"https://{word()}.example.{chance.choice(['org', 'com', 'net'])}/{chance.choice(['en', 'es', 'fr', 'de'])}/{chance.randint(1, 999)}") for k in range(600)]
    return rows + [(5, URLS[8])] * 50 + [(None, URLS[7])]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    return "".join(c.lower() if c.isascii() else c for c in host), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    best = None
    for verdict, text in URL_RULES:
        own, _, start = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return best or (None, None)


class PlainModel:
    """Witten and Bell's mixture with dictionaries."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for text in texts:
            line = [257] * url_filter.ORDER + list(text) + [256]
            for k in range(url_filter.ORDER, len(line)):
                for n in range(url_filter.ORDER + 1):
                    self.after[tuple(line[k - n : k])][line[k]] += 1

    def log2(self, text):
        line, total = [257] * url_filter.ORDER + list(text) + [256], 0.0
        for k in range(url_filter.ORDER, len(line)):
            p = 1 / 257
            for n in range(url_filter.ORDER + 1):
                after = self.after.get(tuple(line[k - n : k]))
                if after:
                    p = (after[line[k]] + len(after) * p) / (after.total() + len(after))
            total += math.log2(p)
        return total


def test_models_equal_dictionaries(monkeypatch):
    texts = [u.encode() for _, u in page_rows() if u and len(u) < 100]
    model, plain = url_filter.Markov(texts[:300]), PlainModel(texts[:300])
    ratio = url_filter.Ratio(model, url_filter.Markov([]), 1.0, 0.0)
    for text in [*texts[290:320], b"", b"\xff\x00"]:
        want = (plain.log2(text) + (len(text) + 1) * math.log2(257)) / (len(text) + 1)
        assert ratio.differences([b"x", text, b""])[1] == pytest.approx(want)
    whole = ratio.differences(texts)
    monkeypatch.setattr(url_filter, "PIECE", 7)
    assert np.allclose(ratio.differences(texts), whole)
    line, _ = url_filter.symbols([b"http"])
    line = np.concatenate([np.tile(line[:-1], 257).reshape(257, -1), np.arange(257)[:, None]], 1)
    assert sum(2 ** model.log2(row)[-1] for row in line) == pytest.approx(1)


def test_url_filter(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ["host", "path", "rule", "verdict", "text", "row", "score"]})
    rules = [url_filter.Rule.parse(*r) for r in URL_RULES]
    got = url_filter.judge(pages, rules).collect()
    ordered = lambda x: (-1 if x[0] is None else x[0], x[1])
    want = sorted(((i, *plain_parts(u), plain_rule(*plain_parts(u))[0]) for i, u in rows), key=ordered)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=ordered) == want
    ruled = {(r.page_id, r.verdict) for r in got if r.rule is not None}
    assert ruled == {(i, plain_rule(*plain_parts(u))[1]) for i, u in rows if plain_rule(*plain_parts(u))[0]}
    # The models' verdicts, by plain loops over the same sample.
    lowered = lambda u: u if plain_parts(u)[0] == "" else u.replace(u.split("://", 1)[1][: len(plain_parts(u)[0])], plain_parts(u)[0], 1)
    samples = {}
    for verdict in ("allow", "block"):
        own = {lowered(u) for _, u in rows if plain_rule(*plain_parts(u))[1] == verdict and len(u.encode()) <= url_filter.LONGEST}
        hashed = spark.createDataFrame([(u,) for u in own], "text string").select("text", F.xxhash64("text", F.lit(11)).alias("h")).collect()
        samples[verdict] = [r.text.encode() for r in sorted(hashed, key=lambda r: (r.h, r.text))]
    cut = {v: s[: len(s) * 4 // 5] for v, s in samples.items()}
    models = {v: PlainModel(s) for v, s in cut.items()}
    difference = lambda t: (models["allow"].log2(t) - models["block"].log2(t)) / (len(t) + 1)
    slope, offset = url_filter.calibrated(*(np.array([difference(t) for t in samples[v][len(cut[v]) :]]) for v in ("allow", "block")))
    text_of = dict(rows)
    for r in got:
        text = lowered(text_of[r.page_id] or "").encode() if r.page_id is not None else lowered(URLS[7]).encode()
        if r.page_id != 5 and len(text) < 1000:
            assert r.score == pytest.approx(difference(text))
            if r.rule is None:
                assert r.verdict == ("allow" if slope * difference(text) + offset >= 0 else "block")
    free = {r.page_id: r.verdict for r in got if r.rule is None and r.page_id and r.page_id >= 100}
    told = [("es" not in plain_parts(text_of[i])[1], v) for i, v in free.items() if plain_parts(text_of[i])[1][:3] in ("/es", "/fr")]
    assert sum((v == "allow") == want for want, v in told) >= 0.9 * len(told)
    assert len({(r.verdict, r.score) for r in got if r.page_id == 5 and r.rule == "example.org/es/"}) == 1


def test_url_filter_without_urls_or_rules(spark):
    rules = [url_filter.Rule.parse(*r) for r in URL_RULES]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    pages = spark.createDataFrame(page_rows(), "page_id long, url string")
    assert {(r.rule, r.verdict) for r in url_filter.judge(pages, []).collect()} == {(None, "allow")}
    only = url_filter.judge(pages, [url_filter.Rule.parse("allow", "org/")]).groupBy("rule", "verdict").count().collect()
    assert {(r.rule, r.verdict) for r in only} == {("org/", "allow"), (None, "allow")}
    with pytest.raises(ValueError, match="unknown verdict"):
        url_filter.Rule.parse("maybe", "org/")
