"""The dimension sink: rows by key, files that stay, writes that break off, upserts that cross."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronolith.operators.expectations import ExpectationError
from chronolith.sources.dimension import ConflictError, Dimension

DDL = "id long, name string, n int"


def files(root):
    return {p: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(root).rglob("*.parquet") if "/data/" in str(p)}


def test_upserts_equal_a_dictionary(spark, tmp_path):
    table, chance, known = Dimension(spark, str(tmp_path), ["id"], 8), random.Random(1), {}
    for k in range(4):
        rows = [(chance.randint(0, 60), chance.choice([None, "", f"v{k}"]), chance.randint(0, 5)) for _ in range((200, 30, 1, 15)[k])]
        rows += rows[:3]
        best = {}
        for i, name, n in rows:
            if i not in best or (-n, name is not None, name or "") < best[i][0]:
                best[i] = ((-n, name is not None, name or ""), (i, name, n))
        before = files(tmp_path)
        known |= {i: row for i, (_, row) in best.items()}
        assert table.upsert(spark.createDataFrame(rows, DDL), [F.desc("n"), F.asc_nulls_first("name")], len(known)) == k + 1
        assert sorted(map(tuple, table.read().collect())) == sorted(known.values())
        assert before.items() <= files(tmp_path).items()
    fresh = spark.createDataFrame([(1, "x", 9)], DDL)
    before = {p for p in files(tmp_path)}
    table.upsert(fresh, [F.desc("n")])
    assert len({p for p in files(tmp_path)} - before) == 1
    assert table.read(4).where("id = 1").first() != table.read(5).where("id = 1").first()


def test_what_is_not_committed_does_not_exist(spark, tmp_path):
    table = Dimension(spark, str(tmp_path), ["id"], 4)
    with pytest.raises(ExpectationError):
        table.read()
    table.upsert(spark.createDataFrame([(k, "a", k) for k in range(20)], DDL), [F.desc("n")], 20)
    table.stage(spark.createDataFrame([(1, "lost", 1)], DDL), [F.desc("n")])
    with pytest.raises(ExpectationError, match="21 rows, 20 expected"):
        table.upsert(spark.createDataFrame([(99, "b", 1)], DDL), [F.desc("n")], 20)
    assert table.version() == 1 and table.read().where("name <> 'a'").isEmpty() and table.read().count() == 20


def test_upserts_that_cross(spark, tmp_path):
    table = Dimension(spark, str(tmp_path), ["id"], 4)
    table.upsert(spark.createDataFrame([(k, "a", k) for k in range(20)], DDL), [F.desc("n")])
    one, two = (table.stage(spark.createDataFrame([(k, "b", 1)], DDL), [F.desc("n")]) for k in (3, 4))
    assert table.commit(two) == 2
    with pytest.raises(ConflictError):
        table.commit(one)
    assert [r.id for r in table.read().where("name = 'b'").collect()] == [4]


def test_odd_rows(spark, tmp_path):
    table = Dimension(spark, str(tmp_path), ["id"], 4)
    assert table.upsert(spark.createDataFrame([], DDL), [F.desc("n")], 0) == 1 and table.read().count() == 0
    with pytest.raises(ExpectationError):
        table.upsert(spark.createDataFrame([(None, "a", 1)], DDL), [F.desc("n")])
    with pytest.raises(ExpectationError):
        table.upsert(spark.createDataFrame([(1, 1)], "id long, n int"), [F.desc("n")])
