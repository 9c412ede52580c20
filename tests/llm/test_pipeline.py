"""The pipeline's stages on the smallest tables, and the contract queries' columns."""

import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.conftest import low
from tests.llm.test_operators import brute_components, fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

COLUMNS = {
    "op1_ppm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_winnowing": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_token_counts": "doc_id n_tokens",
    "op5_mil_quality": "doc_id held_out score predicted",
    "op6_chat_masks": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op7_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_language_crf": "doc_id held_out lang_pred score",
    "op9_main_text": "page_id url text n_chars",
    "op10_edit_embedding": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_url_filter": "page_id host path rule verdict",
    "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op13_vector_codes": "vec_id code error label_error codebooks_sha256",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract_columns(spark, name):
    assert set(COLUMNS[name].split()) <= set(__spark_entry__.queries()[name](spark, SF).columns)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = cut(r.text)
        windows |= {tuple(words[k : k + 10]) for k in range(len(words) - 9)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id for r in docs.collect()}
        if name == "language ID":
            assert after == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
        if name == "quality classifier":
            known = [r.doc_id for r in before if r.doc_id in labels]
            assert sum((d in after) == (labels[d] == 1) for d in known) >= 0.95 * len(known)
        if name == "SimHash near-dedup":
            pairs = [(r.doc_id, fingerprint(r.text)) for r in before]
            assert after == {d for (d, _), c in zip(pairs, brute_components(pairs), strict=True) if d == c}
        if name == "benchmark decontamination":
            clean = {r.doc_id for r in before if not any(tuple(w[k : k + 10]) in windows for w in [cut(r.text)] for k in range(len(w) - 9))}
            assert after == clean
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == after and all(len(r.ids) == r.n_tokens for r in out)


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows_and_none(spark, edge, empty, number):
    """Null, empty, very long, tied and repeated texts, rows without an id, and columns whose names clash; and no rows."""
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, edge, SF)
    kept = Counter((r.doc_id, r.text if "text" in out.columns else None) for r in out.collect())
    given = Counter((r.doc_id, r.text if "text" in out.columns else None) for r in edge.collect())
    assert kept <= given and len(kept) >= 20
    if number < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == edge.columns
        assert {r.host for r in out.select(F.col("fingerprint").alias("host")).collect()} == {"clash"}
    else:
        assert kept == given
    none = stage(spark, empty, SF)
    assert none.count() == 0 and (number == len(corpus_pipeline.STAGES) - 1 or none.columns == empty.columns)


def test_the_contract_queries_with_sql_equal_it(spark):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op12_hard_negatives", "op13_vector_codes"):
        told = con.execute(__spark_entry__.oracle_sql()[name])
        names = [c[0] for c in told.description]
        assert sorted(map(tuple, __spark_entry__.queries()[name](spark, SF).select(*names).collect())) == sorted(told.fetchall())
