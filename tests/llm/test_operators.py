"""Every operator against brute force on texts of all kinds, and on an empty table."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from chronolith.llm import byte_bpe, chat, decontaminate, edit_embedding, exchange, language, ppm, quality, simhash, token_counts
from chronolith.llm.sampling import remainder, sampled_of_each
from chronolith.llm.text import ALNUM, hash_spans
from chronolith.llm.text import words as cut_words
from tests.llm.conftest import edge_rows, low

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ROWS = edge_rows()


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", (20_000, 1 << 20))


def by_text(rows, *columns):
    return sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in columns)) for r in rows)


def test_byte_bpe(edge, empty):
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.vocabulary(RANKS), special_tokens={})
    got = byte_bpe.encode(edge, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    want = []
    for doc, text, *_ in ROWS:
        ids = encoder.encode_ordinary(text or "")
        want.append((-1 if doc is None else doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids, (text or "").encode()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, bytes(r.decoded)) for r in got) == sorted(want)
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def segmentations(word, numbers, scores):
    """Of a word: the best segmentation's count and score, and each piece's expected count."""
    ends = [[(e - n, numbers[word[e - n : e]]) for n in range(min(e, 128), 0, -1) if word[e - n : e] in numbers] for e in range(len(word) + 1)]
    best, forward = [(0.0, 0)], [0.0]
    for own in ends[1:]:
        top = (-math.inf, 0)
        for before, piece in own:
            if best[before][0] + scores[piece] > top[0]:
                top = (best[before][0] + scores[piece], best[before][1] + 1)
        best.append(top)
        forward.append(np.logaddexp.reduce([forward[before] + scores[piece] for before, piece in own]))
    backward, share = [-math.inf] * len(word) + [0.0], Counter()
    for end in range(len(word), 0, -1):
        for before, piece in ends[end]:
            backward[before] = np.logaddexp(backward[before], backward[end] + scores[piece])
            share[piece] += math.exp(forward[before] + scores[piece] + backward[end] - forward[-1])
    return best[-1][1], best[-1][0], share


def test_token_counts(edge, empty):
    numbers = {piece: k for k, piece in enumerate(sorted(byte_bpe.vocabulary(RANKS), key=byte_bpe.vocabulary(RANKS).get))}
    pattern = regex.compile(public_tokenizers.PATTERN)
    words = Counter(w.encode() for _, text, *_ in ROWS for w in pattern.findall(text or ""))
    scores = token_counts.by_rank(len(numbers))
    for _ in range(2):
        counts = np.full(len(numbers), token_counts.PRIOR)
        for word, n in words.items():
            for piece, share in segmentations(word, numbers, scores)[2].items():
                counts[piece] += n * share
        scores = np.log(counts / counts.sum())
    known = {word: segmentations(word, numbers, scores) for word in words}
    got = {(-1 if r.doc_id is None else r.doc_id): r for r in token_counts.count_tokens(edge, RANKS, 2).collect()}
    for doc, text, *_ in ROWS:
        own = [known[w.encode()] for w in pattern.findall(text or "")]
        r = got[-1 if doc is None else doc]
        assert (r.n_pretokens, r.n_tokens) == (len(own), sum(x[0] for x in own))
        assert r.score == pytest.approx(sum(x[1] for x in own))
    assert token_counts.count_tokens(edge, RANKS).count() == len(ROWS) and token_counts.count_tokens(empty, RANKS).count() == 0


def test_token_counts_do_not_depend_on_the_partitioning(spark, edge, monkeypatch):
    monkeypatch.setattr(token_counts, "TRIE_WORDS", 500)
    told = []
    for parts, shuffled in ((1, 2), (7, 5)):
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffled))
        rows = token_counts.count_tokens(edge.repartition(parts), RANKS).collect()
        told.append(sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score.hex()) for r in rows))
        words = token_counts.word_counts(edge.repartition(parts))
        told[-1].append([x.hex() for x in token_counts.estimate(words, RANKS)])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert told[0] == told[1]


def test_long_words_are_solved_in_linear_time():
    chance, pieces = random.Random(8), token_counts.pieces_of(RANKS)
    scores = token_counts.by_rank(len(pieces.hashes))
    numbers = {piece: k for k, piece in enumerate(sorted(byte_bpe.vocabulary(RANKS), key=byte_bpe.vocabulary(RANKS).get))}
    spell = lambda n: "".join(chance.choice("abcdefghé") for _ in range(n)).encode()
    words = sorted({spell(n) for n in (1, 3, 63, 64, 65, 66, 300)} | {b"a" * 500, b" " * 90})
    weights = np.arange(1, len(words) + 1)
    count, score = token_counts.solved(pa.array(words, pa.large_binary()), pieces, scores)
    want = [segmentations(w, numbers, scores) for w in words]
    assert count.tolist() == [x[0] for x in want] and score.tolist() == pytest.approx([x[1] for x in want])
    share = np.zeros(len(scores))
    for n, (_, _, own) in zip(weights, want, strict=True):
        for piece, x in own.items():
            share[piece] += n * x
    assert token_counts.expected(pa.array(words, pa.large_binary()), weights, pieces, scores) == pytest.approx(share)
    began = time.perf_counter()
    token_counts.best_of_long(spell(1_000_000), pieces, scores)
    assert time.perf_counter() - began < 10


def test_equal_rows_of_a_file_are_dealt_apart(spark, tmp_path):
    rows = [(None, "")] * 500 + [(7, "same text")] * 500
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    sizes = [sum(exchange.unpack(bytes(p.part)).num_rows for p in parts) for parts in _by_chunk(exchange.into_chunks(docs, 30 * 20_000)).values()]
    assert sum(sizes) == 1000 and max(sizes) < 500
    assert {(r.doc_id, r.n_tokens) for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()} == {(None, 0), (7, 2)}


def _by_chunk(chunks):
    found = defaultdict(list)
    for row in chunks.collect():
        found[row.chunk].append(row)
    return found


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


@pytest.mark.parametrize("all_held", [False, True])
def test_ppm(edge, empty, all_held, monkeypatch):
    monkeypatch.setattr(ppm, "SOLVED", 5000)
    out = (lambda doc: True) if all_held else held
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [" "]
    most = ppm.ORDER
    framed = lambda t: b"\xfe" * most + low(t).encode() + b"\xff"
    counts, trie = Counter(), defaultdict(Counter)
    for doc, text, *_ in ROWS:
        if not out(doc):
            counts.update(tokens(text))
            data = framed(text)
            for i in range(most, len(data)):
                for order in range(most + 1):
                    trie[data[i - order : i]][data[i]] += 1
    total, distinct = sum(counts.values()), len(counts)

    def score(data):
        value = 0.0
        for i in range(most, len(data)):
            excluded = set()
            for order in range(most, -1, -1):
                seen = {s: n for s, n in trie.get(data[i - order : i], {}).items() if s not in excluded}
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if data[i] in seen:
                    value += math.log10((seen[data[i]] - 0.5) / n)
                    break
                value += math.log10(0.5 * d / n)
                excluded |= seen.keys()
            else:
                value -= math.log10(256 - len(trie.get(b"", {})))
        return value

    got = ppm.score(edge, F.lit(True) if all_held else remainder(5) == 1).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    for doc, text, *_ in ROWS:
        r, words = by_id[doc], tokens(text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(doc), len(words), sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words), abs=1e-6)
        assert r.score == pytest.approx(score(framed(text)))
    assert ppm.score(empty, remainder(5) == 1).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least id reachable by links of three differing bits or fewer, for (id, fingerprint) pairs."""
    label = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(prints, label, strict=True):
        if doc is not None:
            least[x] = min(least.get(x, doc), doc)
    return [least.get(x) for x in label]


def test_simhash(edge, empty):
    prints = [(doc, fingerprint(text)) for doc, text, *_ in ROWS]
    want = sorted((str(doc), f"{p:016x}", str(c)) for (doc, p), c in zip(prints, brute_components(prints), strict=True))
    got = simhash.near_duplicates(edge).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_representatives(edge)
    assert kept.columns == edge.columns
    components = {r.doc_id: r.component_id for r in got}
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").select("doc_id").collect()) == sorted({d for d, c in components.items() if d is not None and d == c})


def test_simhash_repeated_ids_keep_a_row_of_each_component(spark):
    chance = random.Random(4)
    prose = lambda: " ".join(f"w{chance.randrange(10**6)}" for _ in range(80))
    a, b, c = prose(), prose(), prose()
    rows = [(3, a), (5, a), (5, b), (6, b), (7, c), (7, c + " "), (8, prose()), (9, a), (9, rest := prose())]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(3, a), (5, b), (7, c), rows[6], (9, rest)])
    rows = [(5, a), (5, b)]  # two components of one id
    assert sorted(map(tuple, simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == sorted(rows)


def test_simhash_ids_reach_through_all_their_rows(spark):
    chance = random.Random(6)
    a, b, c, d, e = (" ".join(f"w{chance.randrange(10**6)}" for _ in range(80)) for _ in range(5))
    rows = [(6, b), (5, b), (5, a), (3, a), (5, c), (9, c + " "), (8, d), (None, b), (None, d), (None, e)]
    rows += [(20, f"{k} {d[:k]}") for k in range(300)] + [(21, f"7 {d[:7]}")]  # an id of many texts
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [3, 3, 3, 3, 3, 3, 8, 3, 8, None] + [20] * 301
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((doc, f"{fingerprint(t):016x}", x) for (doc, t), x in zip(rows, want, strict=True))


def test_simhash_large_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    chance = np.random.default_rng(5)
    prints = {0}
    for centre in chance.integers(0, 1 << 63, 6).tolist():
        prints |= {centre ^ sum(1 << int(b) for b in chance.choice(64, chance.integers(0, 4), replace=False)) for _ in range(60)}
    rows = [(k, p - (1 << 64) if p >= 1 << 63 else p) for k, p in enumerate(sorted(prints))]
    nodes = spark.createDataFrame(rows, "n long, fp long")
    links = simhash.variants(nodes.select("fp")).repartition("key").sortWithinPartitions("key").mapInArrow(simhash._links, "a long, b long")
    labels = {r.node: r.label for r in simhash.components(links).collect()}
    brute = brute_components([(k, p & (1 << 64) - 1) for k, p in rows])
    mine = defaultdict(set)
    for (k, p) in rows:
        mine[labels.get(p, p)].add(k)
    theirs = defaultdict(set)
    for (k, _), c in zip(rows, brute, strict=True):
        theirs[c].add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_winnowing(spark, edge, empty, block_bytes):
    long = ROWS[11][1].split()
    items = [(1, " ".join(long[500:530])), (2, " ".join(ROWS[-2][1].split()[:9])), (3, "tie tie"), (4, None), (5, ""), (6, "not in any document at all, I should say so myself"), (7, "x " + " ".join(long[900:909]) + " y"), (8, " ".join(["tie"] * 10)), (3, "tie tie"), (9, " ".join(long[2000:2010]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    want = []
    for doc, text, *_ in ROWS:
        words, hit, found = cut(text), set(), set()
        for item, phrase in items:
            own = cut(phrase)
            size = min(10, len(own))
            windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found.add(str(item))
        want.append((-1 if doc is None else doc, len(words), len(hit), sorted(found)))
    got = decontaminate.mark(edge, bench, block_bytes).select("row.doc_id", "n_words", "n_hit", "items").collect()
    assert by_text(got, "n_words", "n_hit", "items") == sorted(want)
    kept = decontaminate.decontaminate(edge, bench)
    assert kept.columns == edge.columns and kept.count() == sum(not w[2] for w in want)
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(edge, bench.limit(0)).where("contaminated").count() == 0


def brute_hits(texts, items):
    hit, pairs = [], set()
    for doc, text in enumerate(texts):
        own, found = text.split(), set()
        for item, phrase in enumerate(items):
            theirs = phrase.split()
            size = min(10, len(theirs))
            windows = {tuple(theirs[k : k + size]) for k in range(len(theirs) - size + 1)} if theirs else set()
            for k in range(len(own) - size + 1):
                if tuple(own[k : k + size]) in windows:
                    found |= set(range(k, k + size))
                    pairs.add((doc, item))
        hit += [k in found for k in range(len(own))]
    return hit, pairs


def winnowed(texts, items):
    found = cut_words([t.encode() for t in texts], ALNUM)
    hashed = hash_spans(found.data, found.start, found.end)
    hit, pairs = decontaminate.hits(found, hashed, np.repeat(np.arange(len(texts)), found.per_document), decontaminate.Benchmark([(str(k), t.encode()) for k, t in enumerate(items)]))
    return hit.tolist(), pairs


def test_winnowing_finds_texts_that_repeat_themselves():
    hit, pairs = winnowed(["ha " * 1000], ["ha " * 12])
    assert all(hit) and pairs == {(0, 0)}
    chance = random.Random(5)
    for _ in range(40):  # a period that ends in an item's beginning: whichever gram is the least
        period = " ".join(f"p{chance.randrange(10**6)}" for _ in range(chance.randint(1, 6)))
        rest = " ".join(f"z{chance.randrange(10**6)}" for _ in range(9))
        texts = [f"{period} {period} {period} {period} {rest}", "other words", f"{rest} {period} {period} {period} {rest}"]
        items = [f"{period} {rest}", f"{rest} {period} {period}", "other words other", rest]
        assert winnowed(texts, items) == brute_hits(texts, items)
    for _ in range(40):  # few words, so that windows recur, over the documents' bounds as well
        text = lambda n: " ".join(chance.choice("ab") for _ in range(chance.randint(0, n)))
        texts, items = [text(80) for _ in range(6)], [text(30) for _ in range(4)]
        assert winnowed(texts, items) == brute_hits(texts, items)


def test_blocks_of_another_benchmark_are_not_mistaken():
    found = []
    for text in (b"first item", b"second item"):  # the first value is gone, and its memory free, when the second comes
        block = type("Block", (), {"value": (text.decode(), [("1", text)])})
        found.append(decontaminate._benchmark(block).words)
    assert found == [[[b"first", b"item"]], [[b"second", b"item"]]]


def test_language(edge, empty):
    model = language.learn(edge, remainder(4) != 2)
    got = language.identify(edge, model).select("row.doc_id", "row.text", "lang_pred", "score").collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "fr")) == letters and (r.lang_pred == "und") != letters and 0 <= r.score <= 1
    assert language.learn(empty, F.lit(True)) is None
    assert {r.lang_pred for r in language.identify(edge, None).select("lang_pred").collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
    assert language.keep_identified(edge, model).columns == edge.columns


def test_rare_languages_are_sampled_and_segments_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    rows = [(k, f"the house of the king number{k}", "en") for k in range(600)] + [(1000, "das haus von dem könig", "de")]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.labels == ["de", "en"]
    sample = sampled_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", 20).groupBy("target").count().collect()
    assert {r.target: r["count"] for r in sample} == {"en": 20, "de": 1}
    found = language.segments_of("漢字" * 50_000)
    assert len(found) == 4 and all(len(x) <= language.SEGMENT_WORDS * language.PIECE_LETTERS for x in found)
    assert language.segments_of("one two  three") == ["one two three"] and language.segments_of("") == [""]


def test_junk_is_rejected_whatever_the_number_of_languages(spark):
    chance = random.Random(6)
    words = {k: ["".join(chance.choice(parts) for _ in range(chance.randint(1, 3))) for _ in range(60)] for k, parts in {"aa": ["the", "ing", "ed", "an"], "bb": ["ung", "sch", "ein", "der"], "cc": ["que", "eau", "les", "ment"]}.items()}
    prose = lambda k, n: " ".join(chance.choice(words[k]) for _ in range(n))
    junk = lambda n: " ".join("".join(chance.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(chance.randint(2, 11))) for _ in range(n))
    for languages in (["aa"], ["aa", "bb"], ["aa", "bb", "cc"]):
        rows = [(k, prose(x := languages[k % len(languages)], 50), x if k % 5 else None, True) for k in range(120)]
        rows += [(1000 + k, prose(languages[0], 30) + " " + prose(languages[-1], 30), None, True) for k in range(20)]  # mixed
        rows += [(2000 + k, junk(40), None, False) for k in range(20)] + [(3000, "12 34 !!", None, False), (3001, None, None, False)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean").repartition(2)
        kept = language.keep_identified(docs, language.learn(docs, F.lit(True))).collect()
        assert {r.doc_id for r in kept} == {r[0] for r in rows if r[3]}
        assert all(r.lang == languages[r.doc_id % len(languages)] for r in kept if r.doc_id < 1000)


def test_code_switching_is_labelled_word_by_word():
    english, german = "the house of the king and the thing with that", "das haus von dem könig und nicht mit einer ung"
    model = language.train([("en", english), ("de", german)] * 20)
    labels = [k for _, k in language.label_words(f"{english} {german}", model)]
    assert labels[:10] == ["en"] * 10 and labels[-10:] == ["de"] * 10


def test_marginals_equal_enumeration():
    chance = np.random.default_rng(2)
    scores, move = chance.normal(size=(7, 2)).astype(np.float32), chance.normal(size=(2, 2))
    belief, expected = language.marginals(scores, np.array([0, 4, 4, 7]), move, count=True)
    total = np.zeros((2, 2))
    for low_, high in ((0, 4), (4, 7)):
        weight, mass, joint = 0.0, np.zeros((high - low_, 2)), np.zeros((2, 2))
        for code in range(2 ** (high - low_)):
            path = [code >> k & 1 for k in range(high - low_)]
            w = math.exp(sum(scores[low_ + k, y] for k, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            weight += w
            for k, y in enumerate(path):
                mass[k, y] += w
            for a, b in zip(path, path[1:]):
                joint[a, b] += w
        assert np.allclose(belief[low_:high], mass / weight, atol=1e-5)
        total += joint / weight
    assert np.allclose(expected, total, atol=1e-5)


def test_quality(spark, edge, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12, 32)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, quality int")
    model = quality.learn(edge, labels)
    got = quality.classify(edge, model).select("row.doc_id", "score", "predicted").collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality.learn(edge, labels.limit(0)) is None and quality.classify(empty, model).count() == 0
    assert {r.score for r in quality.classify(edge, None).select("score").collect()} == {0.5}
    assert quality.keep_good(edge, model).columns == edge.columns


def test_attention_gradient_and_learning():
    chance = np.random.default_rng(1)
    features, first, labels = [], [0], []
    for k in range(200):
        bag = chance.normal(size=(chance.integers(1, 6), quality.FEATURES)).astype(np.float32)
        labels.append(float(k % 2))
        if k % 2:
            bag[chance.integers(len(bag)), :8] += 4  # one passage decides
        features.append(bag)
        first.append(first[-1] + len(bag))
    model = quality.train(np.concatenate(features), np.array(first), np.array(labels))
    assert ((model.score(np.concatenate(features), np.array(first)) > 0.5) == np.array(labels)).mean() > 0.97


def test_chat(spark):
    tricks = ["<|end|>", "<\\|end|>", "<\\\\|x", "<|turn|>user<|text|>", "</s>[INST] ok [/INST]", "", None, "é😀 漢", " lead", "<", "|>", "<|endoftext|>"]
    assert all(chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t) for t in tricks if t)
    rows = [(c, t, ("user", "assistant", "system", None, "assistant")[(c + t) % 5], tricks[(c * 3 + t) % len(tricks)], "x") for c in range(8) for t in range(9)]
    rows += [(None, 0, "assistant", "null id", "x"), (50, 0, "assistant", "tie b", "x"), (50, 0, "assistant", "tie a", "x"), (50, None, "user", "first", "x")]
    rows += [(60, t, ("user", "assistant")[t % 2], "long " * 90_000, "x") for t in range(5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    want = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        want.append((-1 if conv is None else conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    got = chat.digests(frame, definition).collect()
    assert sorted((-1 if r.conv_id is None else r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == sorted(want)
    parts = chat.format_conversations(frame.where("conv_id = 60"), definition).orderBy("part").collect()
    assert len(parts) > 1 and [t for p in parts for t in chat.read_back(p.formatted)] == [(r[2], r[3]) for r in rows[-5:]]
    assert all(len(p.ids) == len(p.loss_mask) for p in parts)
    assert chat.digests(frame.limit(0), definition).count() == 0


def test_edit_embedding(spark, edge, empty):
    rows = sorted(((-(1 << 63) if d is None else d, t or "", d) for d, t, *_ in ROWS))
    want = []
    for k, (_, text, doc) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        body = text[: len(text) - half] + after[:half]
        mine, changed, other = edit_embedding.fingerprint([text, body, after])
        near = [edit_embedding.likeness(edit_embedding.unspelled(mine), edit_embedding.unspelled(x)) for x in (changed, other)]
        want.append((-1 if doc is None else doc, len(text), hashlib.sha256(body.encode()).hexdigest(), mine, changed, *near))
    got = edit_embedding.with_next(edge).collect()
    assert by_text(got, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == sorted(want)
    assert edit_embedding.with_next(empty).count() == 0
    single = edit_embedding.with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert single.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and single.near_next == 1


def test_similar_texts_share_a_leader(spark):
    text = " ".join(f"word{k * 7919 % 1000}" for k in range(400))
    rows = [(1, text), (2, text), (3, text[:-3] + "xyz"), (4, "entirely other " * 90), (5, None)]
    got = {r.doc_id: r.leader for r in edit_embedding.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


@pytest.mark.parametrize("block", [3, 1024])
def test_similar_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(edit_embedding, "BLOCK", block, raising=False)
    chance = random.Random(9)
    prose = lambda n: " ".join("".join(chance.choice("abcdefgh") for _ in range(chance.randint(1, 7))) for _ in range(n))
    opening, rows = prose(300), [(0, "short"), (1, "shore"), (2, "shirt"), (3, None), (None, "short text"), (4, "short text")]
    for group in range(8):  # one opening, and near copies of several other ends
        text = opening + prose(130)
        rows += [(10 + 3 * group + k, text[: len(text) - k] + "z" * k) for k in range(3)]
    got = edit_embedding.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    marks = edit_embedding.marks([t or "" for _, t in rows])
    prints = [x.split(":")[0] for x in marks]
    keys = [set(edit_embedding.mark_keys(x)) for x in marks]
    shared = lambda a: [b for b, (doc, _) in enumerate(rows) if doc is not None and keys[a] & keys[b]]
    want = [(doc, prints[a], min(rows[b][0] for b in shared(a) if edit_embedding.nearness(marks[a], [marks[b]])[0] >= edit_embedding.SIMILAR)) for a, (doc, _) in enumerate(rows)]
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.fingerprint, r.leader) for r in got), key=order) == sorted(want, key=order)
    assert len({leader for doc, _, leader in want if (doc or 0) >= 10 and leader != doc}) > 4  # groups that the first text does not lead


def test_recall_of_similar_texts(spark):
    chance = random.Random(12)
    prose = lambda: " ".join("".join(chance.choice("abcdefghijklmnop") for _ in range(chance.randint(1, 9))) for _ in range(chance.randint(80, 600)))

    def edited(text, kind, bound):
        at, letter = chance.randrange(int(len(text) * bound)), chance.choice("qrstuvw")
        return {"substituted": text[:at] + letter + text[at + 1 :], "deleted": text[:at] + text[at + 1 :], "inserted": text[:at] + letter + text[at:]}[kind]

    rows, cases, least = [], {}, 0
    for n in (1, 2, 3):
        for kind in ("substituted", "deleted", "inserted"):
            for bound in (0.5, 1.0):
                for _ in range(60):
                    text = other = prose()
                    for _ in range(n):
                        other = edited(other, kind, bound)
                    rows += [(least, text), (least + 1, other)]
                    cases.setdefault((n, kind, bound), []).append(least)
                    least += 2
    leader = {r.doc_id: r.leader for r in edit_embedding.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    recall = {case: sum(leader[k + 1] == k for k in own) / len(own) for case, own in cases.items()}
    assert min(recall.values()) >= 0.9 and all(leader[k] == k for own in cases.values() for k in own), recall


@pytest.mark.parametrize("kind", ["string", "int", "decimal(9,1)", "date"])
def test_ids_of_any_type(spark, kind):
    texts = ["one text here", None, "two of them, then", "the third one", "x"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id")]
    frame = spark.createDataFrame(rows, "n int, text string")
    value = F.expr({"date": "date_add(DATE'2024-01-01', n)", "string": "concat('a', n)"}.get(kind, f"CAST(n AS {kind})"))
    docs = frame.select(value.alias("doc_id"), "text")
    order = [5, 0, 1, 2, 3, 4]  # null first
    got = {r.doc_id: r.edited_sha256 for r in edit_embedding.with_next(docs).collect()}
    ids = {(-1 if r.n is None else r.n): r.doc_id for r in frame.select("n", value.alias("doc_id")).collect()}
    for place, k in enumerate(order):
        text, after = rows[k][1] or "", rows[order[(place + 1) % 6]][1] or ""
        half = len(text) // 2
        assert got[ids[-1 if k == 5 else k]] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        chats = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
        assert {(r.conv_id, r.loss_chars) for r in chat.digests(chats, file.read()).collect()} == {(ids[-1 if n is None else n], len(t or "")) for n, t in rows}
    assert {r.doc_id for r in simhash.near_duplicates(docs).collect()} == set(ids.values())
    assert {r.doc_id for r in edit_embedding.similar(docs).collect()} == set(ids.values())


def test_items_without_id_and_benchmarks_of_many_blocks(spark, edge):
    long = ROWS[11][1].split()
    items = [(None, " ".join(long[500:530])), ("b", " ".join(long[520:560])), (None, "tie tie tie"), ("a", "two words")] + [(f"c{k}", " ".join(long[600 + 15 * k : 612 + 15 * k])) for k in range(30)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = decontaminate.report(edge, bench).orderBy("doc_id").collect()
    assert whole == decontaminate.report(edge, bench).orderBy("doc_id").collect()
    many = decontaminate.mark(edge, bench, 200)  # some twenty blocks, ten passes
    parts = {r.doc_id: r for r in many.selectExpr("row.doc_id", "n_hit", "items", "spans").collect()}
    for r in whole:
        assert (parts[r.doc_id].n_hit, len(parts[r.doc_id]["items"])) == (r.n_hit, r.n_items)
    assert parts[11]["items"] == ["b", *sorted(f"c{k}" for k in range(30)), None] and parts[10]["items"] == [None] and parts[10].n_hit == 4
    digest = hashlib.sha256(b"a").hexdigest()
    assert [(r.n_items, r.items_sha256) for r in whole if r.doc_id == 4] == [(1, digest)]
