"""The contract queries of this subpackage: thin wrappers that read whole tables and derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.sampling import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and word-unigram scores of every whole text of ``documents``."""
    from chronolith.llm.ppm import score

    return score(table(spark, sf_dir, "documents"), remainder(5) == 1)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole text of ``documents``."""
    from chronolith.llm.decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of every whole text of ``documents``."""
    from chronolith.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole text of ``documents``."""
    import public_tokenizers

    from chronolith.llm.byte_bpe import load_ranks
    from chronolith.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op5_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``, learned from the labels outside fold 2 of 4."""
    from chronolith.llm.quality import classify, learn

    docs, held_out = table(spark, sf_dir, "documents"), remainder(4) == 2
    found = classify(docs, learn(docs, table(spark, sf_dir, "labels").where(~held_out)))
    return found.select(F.col("row.doc_id").alias("doc_id"), "score", "predicted").select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from documents outside fold 2 of 4."""
    from chronolith.llm.language import identify, learn

    docs, held_out = table(spark, sf_dir, "documents"), remainder(4) == 2
    found = identify(docs, learn(docs, ~held_out))
    return found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: A conversation whose texts hold another template's control strings, added to the table.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and of the probe."""
    import public_tokenizers

    from chronolith.llm.chat import digests

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = digests(rows.unionByName(spark.createDataFrame(PROBE, rows.schema)), definition)
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole text of ``documents``."""
    import public_tokenizers

    from chronolith.llm.byte_bpe import encode, load_ranks

    return encode(table(spark, sf_dir, "documents"), load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page of ``pages``."""
    from chronolith.llm.main_text import extract, model

    return extract(table(spark, sf_dir, "pages"), *model())


def op10_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit-embedding fingerprints of every whole text of ``documents`` and of its edited version."""
    from chronolith.llm.edit_embedding import with_next

    return with_next(table(spark, sf_dir, "documents"))


#: What is allowed and blocked, by host and start of path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` under rules and, where none fits, by two character models."""
    from chronolith.llm.url_filter import Rule, judge

    return judge(table(spark, sf_dir, "pages"), [Rule.parse(*r) for r in URL_RULES])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector of ``embeddings``; every seventh has another label."""
    from chronolith.llm.hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return mine(rows, F.col("vec_id") % 50 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector of ``embeddings``, with errors by label and a digest of the codebooks."""
    from chronolith.llm.vector_codes import compress, digest, with_label_errors

    coded, entries = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ppm": op1_ppm, "op2_winnowing": op2_winnowing, "op3_simhash": op3_simhash, "op4_token_counts": op4_token_counts, "op5_mil_quality": op5_mil_quality, "op6_chat_masks": op6_chat_masks, "op7_byte_bpe": op7_byte_bpe, "op8_language_crf": op8_language_crf, "op9_main_text": op9_main_text, "op10_edit_embedding": op10_edit_embedding, "op11_url_filter": op11_url_filter, "op12_hard_negatives": op12_hard_negatives, "op13_vector_codes": op13_vector_codes}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM items),
spans AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes)),
hits AS (SELECT DISTINCT doc_id, i, m, item_id FROM spans JOIN items USING (m, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(f.s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places p USING (doc_id) LEFT JOIN found f USING (doc_id)"""

_PROBE_SQL = " UNION ALL ".join(f"SELECT {c}, {t}, '{r}', '{x}'" for c, t, r, x in PROBE)
_ESCAPED = r"length(regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g'))"

OP6_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {_PROBE_SQL}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SCALED = "list_transform(embedding, lambda x: floor({} * x::DOUBLE))"

OP12_SQL = f"""
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_SCALED.format(256)} AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""


def _op13_sql(rounds: int = 4) -> str:
    """Lloyd's rounds one after another: ``x`` has a row for each part of each vector, ``b`` one for each codebook entry."""
    steps = []
    for k in range(rounds + 1):
        d = "list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v)"
        steps.append(f"a{k} AS MATERIALIZED (SELECT x.id, x.p, arg_min(b.e, ({d}, b.e)) AS e, min({d}) AS d FROM x JOIN b{k} b ON x.p = b.p GROUP BY x.id, x.p)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT a.p, a.e, i, floor(sum(x.v[i]) / count(*)) AS c FROM a{k} a JOIN x ON x.id = a.id AND x.p = a.p, (SELECT unnest(range(1, len(v) + 1)) AS i FROM (SELECT v FROM x LIMIT 1)) GROUP BY a.p, a.e, i)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS v FROM m{k} GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)")
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id AS id, label, {_SCALED.format(1024)} AS v FROM embeddings WHERE {_FINITE}),
x AS MATERIALIZED (SELECT id, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) AS v FROM e, (SELECT unnest(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS e, v FROM x QUALIFY e < 256),
{", ".join(steps)},
c AS (SELECT id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM e JOIN c USING (id), h"""


OP13_SQL = _op13_sql()


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force."""
    return {"op2_winnowing": OP2_SQL, "op6_chat_masks": OP6_SQL, "op12_hard_negatives": OP12_SQL, "op13_vector_codes": OP13_SQL}
