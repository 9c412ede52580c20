"""Pairs made and judged in tiles against plain loops, and queries on documents whose merges join a pair left for review."""

import glob
import random
import re
import time
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pytest

from chronolith import session
from chronolith.operators import linkage, lookup, tiles
from chronolith.plans import catalogue, projections  # noqa: F401  projections registers its queries
from chronolith.plans import cycle
from chronolith.session import materialize
from tests.test_catalogue import plain
from tests.test_linkage import SCHEMA, expected, postings, similarity

NAMES = [c.split()[0] for c in re.sub(r"<[^>]*>", "", SCHEMA).split(",")]


def test_many_tiles_give_what_the_loop_gives(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 9)
    for seed in (3, 8):
        rows = list(postings(80, seed))
        frame = spark.createDataFrame(rows, SCHEMA)
        got = linkage.candidate_outcomes(frame)
        assert sorted((r.a, r.b, r.score, r.barriers, r.outcome) for r in got.collect()) == sorted(expected(rows))
        # Pairs are judged where they are made: only those under hard keys meet postings in joins.
        plan = got._jdf.queryExecution().analyzed().toString()
        assert len(re.findall("FlatMapGroupsInArrow", plan)) == 1


def test_only_pairs_of_those_asked_for(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 5)
    rows = [(*r[:8], [f"t{n}" for n in range(k % 9, k % 9 + 8)], *r[9:]) for k, r in enumerate(postings(90, 4))]
    chosen = {r[0] for r in rows if random.Random(r[0]).random() < 0.2}
    asked = spark.createDataFrame([(x,) for x in sorted(chosen)], "posting_id string")
    got = tiles.like_pairs(spark.createDataFrame(rows, SCHEMA), ["employer"], "0.2", "0.3", asked)
    want = {}
    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            title, text = similarity(a[7], b[7]), similarity(a[8], b[8])
            if a[1] and a[1] == b[1] and {a[0], b[0]} & chosen and 10 * title >= 2 and 10 * text >= 3:
                want[a[0], b[0]] = (int(title * 10000), int(text * 10000))
    assert {(r.a, r.b): (r.title, r.text) for r in got.collect()} == want and got.count() == len(want) > 10


def test_bands_of_text_sizes_lose_no_pair(spark, monkeypatch):
    """A large group is dealt by sizes of texts: only neighbouring bands meet, and no pair alike enough is lost."""
    monkeypatch.setattr(tiles, "ROWS", 6)
    monkeypatch.setattr(tiles, "SIDE", 4)
    chance, rows = random.Random(9), []
    for k, r in enumerate(postings(150, 6)):
        size = chance.choice([0, 1, 2, 3, 4, 5, 7, 9, 12, 16, 21, 28, 37, 50])
        rows.append((*r[:7], [f"t{n}" for n in range(k % 3, k % 3 + 8)], [f"x{n}" for n in range(size)], *r[9:]))
    for asked in (None, {r[0] for r in rows if chance.random() < 0.3}):
        frame = spark.createDataFrame(rows, SCHEMA)
        chosen = None if asked is None else spark.createDataFrame([(x,) for x in sorted(asked)], "posting_id string")
        got = tiles.like_pairs(frame, ["employer"], "0.7", "0.75", chosen).select("a", "b", "title", "text").collect()
        want = set()
        for k, a in enumerate(rows):
            for b in rows[k + 1 :]:
                title, text = similarity(a[7], b[7]), similarity(a[8], b[8])
                if a[1] and a[1] == b[1] and (asked is None or {a[0], b[0]} & asked) and 10 * title >= 7 and 4 * text >= 3:
                    want.add((a[0], b[0], int(title * 10000), int(text * 10000)))
        assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50


def test_large_groups_go_to_the_tiles_of_like_text_sizes(spark, monkeypatch):
    """Rows of a large group are shuffled to the tiles of three bands, not to all tiles of the group."""
    monkeypatch.setattr(tiles, "ROWS", 8)
    monkeypatch.setattr(tiles, "_judge", lambda *_: _counted)
    row = next(iter(postings(1)))
    rows = [(f"p{k:03d}", "one", *row[2:7], ["t"], [f"x{n}" for n in range(2 ** (k % 8))], *row[9:]) for k in range(128)]
    tiled = tiles.like_pairs(spark.createDataFrame(rows, SCHEMA), ["employer"], "0.5", "0.75")
    assert tiled.selectExpr("sum(title)").first()[0] <= 128 * 2  # 16 blocks of 8 rows; sizes of all 8 bands are apart


def test_a_large_group_goes_to_few_sides(spark, monkeypatch):
    """A group of 64 blocks is shuffled as often as it has sides, packed, and not as often as it has blocks."""
    monkeypatch.setattr(tiles, "ROWS", 8)
    monkeypatch.setattr(tiles, "_meet", lambda *_: _held)
    row = next(iter(postings(1)))
    rows = [(f"p{k:03d}", "one", *row[2:7], ["t"], ["x"], *row[9:]) for k in range(512)]
    tiled = tiles.like_pairs(spark.createDataFrame(rows, SCHEMA), ["employer"], "0.5")
    assert 512 <= tiled.selectExpr("sum(title)").first()[0] <= 512 * tiles.SIDES


def test_packs_hold_all_of_their_rows(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 7)
    chance = random.Random(5)
    sets = [None if k % 9 == 4 else sorted({chance.randrange(-(1 << 63), 1 << 63) if chance.random() < 0.5 else chance.randrange(40) for _ in range(k % 7)}) for k in range(60)]
    table = pa.table({"_key0": [f"k{k % 3}" for k in range(60)], "_band": [0] * 60, "_own": [True] * 60, "posting_id": [str(k) for k in range(60)], "title_tokens": pa.array(sets, pa.list_(pa.int64())), "text_tokens": pa.array(sets[::-1], pa.list_(pa.int64()))})
    packs = pa.Table.from_batches(list(tiles._packer(1)(iter(table.to_batches(max_chunksize=4)))))
    assert packs.num_rows > 3 and sum(packs.column("_rows").to_pylist()) == 60
    got = {}
    for key, *one in zip(*(packs.column(c).to_pylist() for c in ("_key0", *tiles.PACKED))):
        got |= {r["posting_id"]: (key, sorted(r["title_tokens"]), sorted(r["text_tokens"])) for r in tiles.unpack(*one).to_pylist()}
    assert got == {str(k): (f"k{k % 3}", sets[k] or [], sets[59 - k] or []) for k in range(60)}


@pytest.mark.parametrize("many", [5, 1000])
def test_decisive_pairs_are_all_that_merge_or_are_left_for_review(spark, monkeypatch, many):
    """Whatever the pairs have in common, and with places that differ but overlap or are missing."""
    monkeypatch.setattr(tiles, "ROWS", many)
    chance, rows = random.Random(11), []
    for k, r in enumerate(postings(110, 7)):
        places = chance.choice([["bern"], ["bern"], ["bern", "land"], []])
        some = lambda p, n, c: sorted(f"{p}{x}" for x in range(n) if chance.random() < c)
        title, text = chance.choice([some("t", 6, 0.8), [f"t{x}" for x in range(6)]]), chance.choice([some("x", 12, 0.75), [f"x{x}" for x in range(12)], some("x", 40, 0.5)])
        shown = {"employer": chance.choice(["one", "two"]), "location": " ".join(places), "terms": chance.choice(["", "80", "80", "100"]), "title_tokens": title, "text_tokens": text, "location_tokens": places, "requisition": chance.choice([None, "", f"q{k % 40}"]), "url": f"u{k % 50}" if k % 4 == 0 else f"v{k}"}
        rows.append({**dict(zip(NAMES, r)), **shown})
    frame = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], SCHEMA)
    told = lambda df: sorted((r.a, r.b, r.score, r.hard_key, r.barriers, r.outcome) for r in df.collect())
    got, want = told(linkage.decisive_outcomes(frame)), told(linkage.candidate_outcomes(frame).where("outcome <> 'KEEP_SEPARATE'"))
    assert got == want
    by_id = {r["posting_id"]: r for r in rows}
    alike = lambda a, b, f: bool(by_id[a][f]) and by_id[a][f] == by_id[b][f]
    cases = {(outcome, alike(a, b, "location"), alike(a, b, "terms")) for a, b, _, hard, _, outcome in got if not hard}
    assert cases >= {("AUTO_MERGE", True, True), ("REVIEW", True, True), ("REVIEW", True, False), ("REVIEW", False, True)}


def test_a_cycle_makes_decisive_pairs_only(spark, chained, monkeypatch):
    """Pairs that stay separate grow with the square of an employer's postings, and nothing that is published needs them."""
    monkeypatch.setattr(linkage, "candidate_outcomes", lambda _: pytest.fail("all candidate pairs were made"))
    monkeypatch.setattr(linkage.class_pairs, "__defaults__", (linkage.candidate_outcomes,))
    assert catalogue.queries()["cycle_snapshot"](spark, chained[0]).count() == 1
    assert catalogue.queries()["cycle_readiness"](spark, chained[0]).first().critical_dedup + 1


@pytest.mark.parametrize("few", [0, 99])
def test_wide_rows_stay_where_they_are_if_copies_are_few(spark, monkeypatch, few):
    monkeypatch.setattr(lookup, "FEW", few)
    rows = [*postings(30, 2), *((f"z{r[0]}", *r[1:]) for r in list(postings(30, 2))[::4])]
    frame = materialize(spark.createDataFrame(rows, SCHEMA), "rows")
    got = linkage.representatives(frame, linkage.classes(frame))
    assert sorted(r.posting_id for r in got.collect()) == sorted(r[0] for r in rows if not r[0].startswith("z"))
    assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == (few > 0)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of the number of rows that a group holds, in place of its pairs."""
    yield from _counted(b for k in batches for n in k.column("_rows").to_pylist() for b in [pa.record_batch({"x": [0] * n})])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of a tile's size, in place of its pairs."""
    size, moment = sum(b.num_rows for b in batches), pa.timestamp("us", "UTC")
    types = {"a": pa.string(), "b": pa.string(), "title": pa.int32(), "text": pa.int32()} | dict.fromkeys(tiles.SIGNS, pa.int8()) | {"redirected": pa.bool_(), "apart": pa.bool_()} | dict.fromkeys(["a_seen", "b_seen", "a_closed", "b_closed"], moment)
    yield pa.RecordBatch.from_pydict({f: pa.array([size], t) if f == "title" else pa.nulls(1, t) for f, t in types.items()})


@pytest.fixture(scope="module")
def chained(spark, tmp_path_factory):
    """Texts of which each merges with the next, while the first and the third are left for review."""
    folder = str(tmp_path_factory.mktemp("chained"))
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    texts = ["of the green park\n" + " ".join(word(n) for n in range(10 * k, 10 * k + 100)) for k in range(3)]
    rows = [(k, t, "en", "src1", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["pair_scores", "pair_outcomes", "human_outcomes", "run_counters", "cluster_summary", "incremental_clusters", "cycle_readiness", "cycle_snapshot"])
def test_chains_equal_sql(spark, chained, name):
    folder, con = chained
    mine, told = catalogue.queries()[name](spark, folder), con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in told.description]
    assert sorted(tuple(plain(v) for v in r) for r in mine.select(*names).collect()) == sorted(tuple(plain(v) for v in r) for r in told.fetchall())


def test_a_conflict_stops_a_cycle_by_default(spark, chained):
    assert cycle.Policy().conflicts_stop
    conflicts = linkage.conflicting_reviews(*_linked(spark, chained[0]))
    assert [(r.a, r.b) for r in conflicts.collect()] == [(0, 2)]


def _linked(spark, folder):
    rows = catalogue._postings(spark, folder)
    members = linkage.classes(rows)
    pairs = linkage.class_pairs(rows, members).persist()
    return pairs, linkage.class_clusters(members, pairs)


def test_shuffle_files_go_when_their_step_is_written(spark, monkeypatch):
    """They don't wait until the driver happens to collect its garbage."""
    monkeypatch.setattr(session, "TIDY_S", 0)
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}
    before = held()
    for _ in range(3):
        materialize(spark.range(1000).repartition(7, "id"), "step")
    until = time.monotonic() + 30
    while (left := held() - before) and time.monotonic() < until:
        materialize(spark.range(1), "next")
    assert not left
