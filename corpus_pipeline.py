"""The corpus pipeline: language ID, quality, near-duplicates, decontamination, encoding.

Each stage takes all that its predecessor kept. Documents in no language go, and ``lang`` of the others becomes the one
predicted; then those go that are predicted to be of poor quality, then all but one of each group of near-duplicates,
then those that hold a benchmark window; what is left is encoded. All stages but the last return the columns of
``documents``, further ones and clashing names included.

A document without a text, or with an empty one, is in no language and goes in the first stage; for the others it is an
empty text. Very long texts are taken whole. Repeated rows are judged alike; of rows with equal or nearly equal texts,
repeated ones included, the third stage keeps one, of the least id. A row without an id stays unless a stage rejects its
text. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm import byte_bpe, decontaminate, language, quality, simhash
from chronolith.llm.sampling import remainder
from chronolith.session import materialize

#: Stages use models and statistics that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: keep documents that are in a language, named by the prediction."""
    return language.keep_identified(docs, language.learn(docs, remainder(4) != 2))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: keep documents that are predicted to be of good quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(4) != 2)
    return quality.keep_good(docs, quality.learn(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: keep one document of each component of SimHash links."""
    return simhash.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: keep documents that hold no benchmark window."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token ids of every document left, with digests of ids and of the decoded text."""
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_ids=True).drop("decoded")


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE encoding and decoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
