"""The query catalogue: every query over the reference tables, with the SQL that says the same.

``events`` plays the life-cycle log, ``documents`` the observations, ``pages`` the raw pages, ``labels`` the human
decisions, ``conversations`` an ordered log, and the order tables dimensions and snapshots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import text as X
from chronolith.functions import values as V
from chronolith.operators import evidence, expectations, governance, increments, lifecycle, linkage, pit, places, readiness, rules, snapshot
from chronolith.operators.components import components
from chronolith.operators.lookup import look_up
from chronolith.session import materialize, prepare

AS_OF = "2024-01-20 12:00:00"
CUTOFFS = ["2024-01-05 00:00:00", "2024-01-15 06:30:00", "2024-01-28 23:59:59"]
MARKET_AS_OF = "2001-07-31 12:00:00"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can say it."""

    def add(function: Query) -> Query:
        _queries[function.__name__] = function
        if sql is not None:
            _sql[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})  # the session's zone is UTC


def moment(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# --- point in time ---------------------------------------------------------------------------------------------

_TOLD = "CASE WHEN event_type = 'error' THEN 'DISAPPEARED_PENDING' ELSE 'STILL_ACTIVE' END"


@query(f"""
WITH content AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
    FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND event_type <> 'error') WHERE r = 1),
state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
    FROM events WHERE ts <= TIMESTAMP '{AS_OF}') WHERE r = 1)
SELECT c.user_id, c.event_id, c.event_type, c.value, s.event_id AS state_event_id,
  CASE WHEN s.event_type = 'error' THEN 'DISAPPEARED_PENDING' ELSE 'STILL_ACTIVE' END AS lifecycle_state
FROM content c LEFT JOIN state s USING (user_id)""")
def pit_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest content and latest state of each user at a cutoff."""
    log = table(spark, sf_dir, "events")
    seen = log.select("user_id", F.col("event_id").alias("observation_id"), F.col("ts").alias("observed_at"), F.when(F.col("event_type") != "error", "ACTIVE").alias("observation_status"), F.col("event_type").alias("kind"), "value")
    told = log.select("user_id", "event_id", F.expr(_TOLD).alias("event_type"), F.col("ts").alias("observed_at"), F.col("ts").alias("created_at"))
    found = pit.posting_states(seen, told, at(AS_OF), "user_id")
    return found.select("user_id", F.col("observation_id").alias("event_id"), F.col("kind").alias("event_type"), "value", F.col("lifecycle_event_id").alias("state_event_id"), "lifecycle_state")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS as_of, user_id, event_id, event_type FROM (SELECT *, row_number() OVER
        (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '{c}') WHERE r = 1"""
        for c in CUTOFFS
    )
)
def pit_multi_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of each user at several cutoffs, in one pass."""
    found = pit.latest_at(table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id"], {c: at(c) for c in CUTOFFS}, ["event_id", "event_type"])
    return found.select("as_of", "user_id", "event_id", "event_type")


_LIFE = """
base AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS present FROM events),
isl AS (SELECT *, sum(present::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM base),
num AS (SELECT *, row_number() OVER w AS n, min(ts) OVER (PARTITION BY user_id, i, present ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since
    FROM isl WHERE i > 0 WINDOW w AS (PARTITION BY user_id, i, present ORDER BY ts, event_id)),
due AS (SELECT *, (NOT present AND n >= 2 AND epoch_us(ts) - epoch_us(since) >= 172800000000)::INT AS d FROM num),
cum AS (SELECT *, sum(d) OVER (PARTITION BY user_id, i, present ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cd FROM due),
life AS (SELECT user_id, ts, event_id, CASE WHEN present AND i = 1 THEN 'NEW' WHEN present THEN 'STILL_ACTIVE'
    WHEN d = 1 THEN 'CLOSED_OBSERVED' ELSE 'DISAPPEARED_PENDING' END AS lifecycle_event
    FROM cum WHERE present OR cd = 0 OR (cd = 1 AND d = 1)),
told AS (SELECT *, lag(lifecycle_event) OVER w AS before, lag(ts) OVER w AS closed_at FROM life
    WHERE lifecycle_event <> 'DISAPPEARED_PENDING' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
epi AS (SELECT *, coalesce(before = 'CLOSED_OBSERVED' AND lifecycle_event IN ('NEW', 'STILL_ACTIVE'), false) AS reopened FROM told)
"""


def _life(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("present"))
    return lifecycle.lifecycle_events(log, ["user_id"], "ts", "present", "event_id")


def _by_time() -> list[Column]:
    return [F.col("ts"), F.col("event_id")]


@query(f"WITH {_LIFE} SELECT user_id, event_id, lifecycle_event FROM life")
def lifecycle_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life-cycle events: a purchase is presence, anything else absence; 48 hours close."""
    return _life(spark, sf_dir).select("user_id", "event_id", "lifecycle_event")


@query(f"""WITH {_LIFE} SELECT user_id, 1 + sum(reopened::INT)::BIGINT AS episodes, count(*) AS n_events,
  count(*) FILTER (lifecycle_event = 'CLOSED_OBSERVED') AS closures FROM epi GROUP BY user_id""")
def episode_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of each user."""
    told = lifecycle.episodes(_life(spark, sf_dir), ["user_id"], _by_time())
    return told.groupBy("user_id").agg(F.max("episode").cast("long").alias("episodes"), F.count("*").alias("n_events"), F.count_if(F.col("lifecycle_event") == "CLOSED_OBSERVED").alias("closures"))


@query(f"""WITH {_LIFE} SELECT user_id, event_id, strftime(closed_at, '%Y-%m-%d %H:%M:%S.%f') AS closed_at,
  ((epoch_us(ts) - epoch_us(closed_at)) // 86400000000)::BIGINT AS gap_days FROM epi WHERE reopened""")
def reappearance_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reopening with the closure before it and the whole days between."""
    found = lifecycle.reappearances(_life(spark, sf_dir), ["user_id"], _by_time(), "ts")
    return found.select("user_id", "event_id", moment("closed_at").alias("closed_at"), "gap_days")


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER w AS carried_type,
  last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER w AS carried_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last active event before each event said."""
    log = table(spark, sf_dir, "events")
    found = lifecycle.carry_forward(log, ["user_id"], _by_time(), F.col("event_type") != "error", {"carried_type": "event_type", "carried_value": "value"})
    return found.select("user_id", "event_id", "carried_type", "carried_value")


@query("""SELECT user_id, event_id, event_type, previous FROM (SELECT *, lag(event_type) OVER w AS previous, row_number() OVER w AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n > 1 AND event_type IS DISTINCT FROM previous""")
def state_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type differs from the user's previous one."""
    found = lifecycle.changes(table(spark, sf_dir, "events"), ["user_id"], _by_time(), "event_type")
    return found.select("user_id", "event_id", "event_type", "previous")


@query("""SELECT conv_id, turn, role, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
  FROM conversations WHERE role = 'assistant') WHERE r = 1""")
def latest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last assistant turn of each conversation."""
    found = pit.latest_by_key(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], F.col("role") == "assistant")
    return found.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query(f"""WITH {_LIFE}, closed AS (SELECT user_id, max(ts) AS closed_at FROM life WHERE lifecycle_event = 'CLOSED_OBSERVED' GROUP BY user_id)
SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events JOIN closed USING (user_id) WHERE ts > closed_at AND event_type = 'purchase' GROUP BY user_id""")
def first_active_after_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first presence after each user's last closure."""
    closed = _life(spark, sf_dir).where("lifecycle_event = 'CLOSED_OBSERVED'").groupBy("user_id").agg(F.max("ts").alias("closed_at"))
    active = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return pit.first_after(active, closed, "user_id", "ts", "closed_at", ["event_id"])


# --- text and rules --------------------------------------------------------------------------------------------


@query("""SELECT user_id, sum(k)::BIGINT AS k_sum, count(k) AS n FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id""")
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value from semi-structured properties, by user."""
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("user_id", value.alias("k")).groupBy("user_id").agg(F.sum("k").alias("k_sum"), F.count("k").alias("n"))


TERMS = [
    rules.Term("T1", "and then", "TITLE"),
    rules.Term("T2", "tion of the", "TITLE_OR_TEXT"),
    rules.Term("T3", "the", "HIDDEN_PUBLIC_TITLE"),
    rules.Term("T4", " de la ", "TEXT_SIGNAL"),
    rules.Term("T5", "src1", "ORGANIZATION_SIGNAL"),
    rules.Term("T6", "!!", "EXCLUSION"),
]


@query(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\s+', ' ', 'g')) AS title, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS body, source FROM documents),
m AS (SELECT doc_id, contains(title, 'and then') AS a, contains(title, 'tion of the') OR contains(body, 'tion of the') AS b, contains(title, 'the') AS h,
  contains(title, 'de la') OR contains(body, 'de la') AS s, contains(source, 'src1') AS o, contains(title, '!!') OR contains(body, '!!') AS x FROM d)
SELECT doc_id, CASE WHEN (a OR b) AND x THEN 'REVIEW' WHEN a OR b THEN 'GREEN_CONFIRMED' WHEN x THEN 'NOT_GREEN' WHEN h OR o OR s THEN 'REVIEW' ELSE 'NOT_GREEN' END AS result,
  CASE WHEN (a OR b) AND x THEN 'POSITIVE_AND_EXCLUSION_CONFLICT' WHEN a OR b THEN 'STRONG_GREEN_TAXONOMY_SIGNAL' WHEN x THEN 'EXCLUSION_WITHOUT_GREEN_SIGNAL'
    WHEN h THEN 'HIDDEN_PUBLIC_TITLE_NEEDS_GREEN_TASK' WHEN o THEN 'ORGANIZATION_SIGNAL_ONLY' WHEN s THEN 'CONDITIONAL_SIGNAL_ONLY' ELSE 'NO_GREEN_TAXONOMY_SIGNAL' END AS reason
FROM m""")
def taxonomy_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged by a taxonomy of literal terms; the first line is the title."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.norm_ws(F.substring_index("text", "\n", 1)).alias("title"), X.norm_ws("text").alias("text"), X.norm_ws("source").alias("organization"))
    return rules.relevance(docs, TERMS).select("doc_id", "result", "reason")


PHRASES = {"P001": "of the", "P006": "de la", "P012": "in der", "P004": "que la", "P008": "the and", "P015": "on the"}


@query(
    "WITH n AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents) SELECT doc_id, "
    + ", ".join(f"contains(t, ' {p} ') AS {s.lower()}" for s, p in PHRASES.items())
    + " FROM n"
)
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of whole tokens in documents."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", plain.alias("t"))
    return docs.select("doc_id", *(X.contains_phrase(F.col("t"), p).alias(s.lower()) for s, p in PHRASES.items()))


_PART_TERM = "concat(substr('thanoresin', 1 + p_partkey % 9, 2), substr('aeiounrst ', 1 + (p_partkey DIV 9) % 10, 1), substr('thedlnsrc', 1 + (p_partkey DIV 90) % 9, 1))"


@query(f"""WITH t AS (SELECT p_partkey AS term, CASE p_partkey % 4 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'TITLE_OR_TEXT' WHEN 2 THEN 'TEXT_SIGNAL' ELSE 'EXCLUSION' END AS kind, trim({_PART_TERM.replace(" DIV ", " // ")}) AS needle FROM part),
d AS (SELECT doc_id, trim(regexp_replace(replace(lower(split_part(text, chr(10), 1)), 'ß', 'ss'), '[[:space:]]+', ' ', 'g')) AS title, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[[:space:]]+', ' ', 'g')) AS body FROM documents),
h AS (SELECT doc_id, kind, count(DISTINCT needle) AS n FROM d JOIN (SELECT DISTINCT kind, needle FROM t) t ON contains(title, needle) OR (kind <> 'TITLE' AND contains(body, needle)) GROUP BY doc_id, kind)
SELECT d.doc_id, {", ".join(f"coalesce(sum(n) FILTER (kind IN ({k})), 0)::BIGINT AS {c}" for c, k in (("n_positive", "'TITLE', 'TITLE_OR_TEXT'"), ("n_signal", "'TEXT_SIGNAL'"), ("n_exclusion", "'EXCLUSION'")))} FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""")
def taxonomy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different terms of a taxonomy of as many as there are parts each document holds, by bucket."""
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'TITLE_OR_TEXT' WHEN 2 THEN 'TEXT_SIGNAL' ELSE 'EXCLUSION' END")
    needles = table(spark, sf_dir, "part").groupBy(kind.alias("term_type"), F.trim(F.expr(_PART_TERM)).alias("search_term")).agg(F.min("p_partkey").cast("string").alias("term_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", X.norm_ws(F.substring_index("text", "\n", 1)).alias("title"), X.norm_ws("text").alias("text"), F.lit("").alias("organization"))
    found = rules.relevance(docs, rules.terms_of(needles))
    return found.select("doc_id", *(F.size(f"matched_{k}").cast("long").alias(f"n_{k}") for k in ("positive", "signal", "exclusion")))


@query("""
WITH n AS (SELECT doc_id, n_chars, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents),
m AS (SELECT doc_id, n_chars > 800 AS ok, contains(t, ' of the ') AS p, contains(t, ' de la ') AS e, contains(t, ' in der ') AS r, contains(t, ' que la ') AS q, contains(t, ' the and ') AS w, contains(t, ' on the ') AS x FROM n)
SELECT doc_id, CASE WHEN NOT ok THEN 'UNKNOWN' WHEN p AND (e OR r) THEN 'UNKNOWN' WHEN e OR r THEN 'PRIVATE_ESTATE_DIRECT' WHEN p THEN 'PRIVATE_RESIDENTIAL_PREMIUM'
    WHEN q THEN 'UNKNOWN' WHEN w THEN 'PRIVATE_RESIDENTIAL_STANDARD' ELSE 'UNKNOWN' END AS segment,
  CASE WHEN NOT ok THEN 'SKIPPED_NOT_GREEN' WHEN p AND (e OR r) THEN 'REVIEW' WHEN e OR r OR p THEN 'CLASSIFIED' WHEN q THEN 'REVIEW' WHEN w THEN 'CLASSIFIED' ELSE 'NO_SUFFICIENT_EVIDENCE' END AS status,
  CASE WHEN NOT ok THEN 'NONE' WHEN p AND (e OR r) THEN 'STRONG' WHEN e THEN 'STRONG' WHEN r THEN 'MODERATE' WHEN p THEN 'STRONG' WHEN q THEN 'MODERATE' WHEN w THEN 'WEAK' ELSE 'NONE' END AS strength,
  CASE WHEN NOT ok THEN 'PUBLIC_OR_NON_RESIDENTIAL' WHEN p OR e OR r THEN 'PRIVATE_RESIDENCE' WHEN q THEN 'PUBLIC_OR_NON_RESIDENTIAL' WHEN w THEN 'PRIVATE_RESIDENCE' ELSE 'PUBLIC_OR_NON_RESIDENTIAL' END AS privacy_context
FROM m""")
def segment_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by phrases on confirmed documents."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    empty = F.lit("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 800, "GREEN_CONFIRMED").otherwise("NOT_GREEN").alias("effective_result"), plain.alias("description"), *(empty.alias(c) for c in ("title", "benefits", "qualifications", "responsibilities")), F.array().cast("array<string>").alias("profiles"))
    found = rules.segments(docs, [rules.Signal(s, p, "JOB") for s, p in PHRASES.items()])
    return found.select("doc_id", "segment", "status", "strength", "privacy_context")


@query("""
WITH a AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'GREEN_CONFIRMED' WHEN n_chars > 300 THEN 'REVIEW' WHEN n_chars > 100 THEN 'NOT_GREEN' END AS result FROM documents),
h AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'INSUFFICIENT' WHEN quality = 1 THEN 'GREEN_CONFIRMED' ELSE 'NOT_GREEN' END AS outcome FROM labels)
SELECT a.doc_id, a.result, CASE WHEN result IS NULL THEN 'MISSING' WHEN result <> 'REVIEW' THEN result
  WHEN coalesce(d.outcome, i.outcome) = 'INSUFFICIENT' THEN 'REVIEW' ELSE coalesce(d.outcome, i.outcome, 'REVIEW') END AS effective_result
FROM a LEFT JOIN h d ON d.doc_id = a.doc_id LEFT JOIN h i ON i.doc_id = a.doc_id - 1""")
def effective_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with direct human decisions laid over, then those inherited from the document before."""
    size = F.col("n_chars")
    judged = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("assessment_id"), F.when(size > 3000, "GREEN_CONFIRMED").when(size > 300, "REVIEW").when(size > 100, "NOT_GREEN").alias("result"))
    outcome = F.when(F.col("toxic") == 1, "INSUFFICIENT").when(F.col("quality") == 1, "GREEN_CONFIRMED").otherwise("NOT_GREEN")
    then = at("2024-01-01 00:00:00")
    human = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("decision_id"), F.col("doc_id").alias("assessment_id"), outcome.alias("outcome"), then.alias("reviewed_at"), then.alias("created_at"))
    applied = human.select(F.col("decision_id").alias("application_id"), (F.col("assessment_id") + 1).alias("assessment_id"), F.col("decision_id").alias("source_decision_id"), "created_at")
    found = rules.effective_result(judged, human, applied, at(AS_OF))
    return found.select(F.col("assessment_id").alias("doc_id"), "result", "effective_result")


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_size::BIGINT END AS positions_count, p_type IN ('ECONOMY', 'SMALL') AS multi_hire FROM part""")
def position_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions stated in a text."""
    told = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Wir suchen "), F.col("p_size"), F.lit(" Mitarbeitende ab 80-100 %"))).when(F.col("p_type") == "SMALL", "Mehrere Stellen offen").otherwise(F.concat(F.lit("ab "), F.col("p_size"), F.lit(". August")))
    found = table(spark, sf_dir, "part").select("p_partkey", X.position_count(told).alias("p"))
    return found.select("p_partkey", F.col("p.positions_count").cast("long").alias("positions_count"), F.col("p.multi_hire").alias("multi_hire"))


@query("""SELECT p_partkey, CASE WHEN contains(t, 'general') OR contains(t, 'aggregator') OR contains(t, 'regional') THEN 6 WHEN contains(t, 'discovery') OR contains(t, 'public_portal') THEN 5
  WHEN contains(t, 'sector') OR contains(t, 'specialist') THEN 4 WHEN contains(t, 'ett') OR contains(t, 'staff') OR contains(t, 'agency') THEN 3
  WHEN contains(t, 'private') AND contains(t, 'direct') THEN 2 ELSE 1 END::BIGINT AS rank
FROM (SELECT p_partkey, lower(CASE p_size % 7 WHEN 0 THEN 'general board' WHEN 1 THEN 'public_portal' WHEN 2 THEN 'Sector list' WHEN 3 THEN 'staffing' WHEN 4 THEN 'private direct' ELSE 'canton' END || ' ' || p_name || ' ' || p_brand) AS t FROM part)""")
def precedence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source precedence from words in its description."""
    kind = F.expr("CASE p_size % 7 WHEN 0 THEN 'general board' WHEN 1 THEN 'public_portal' WHEN 2 THEN 'Sector list' WHEN 3 THEN 'staffing' WHEN 4 THEN 'private direct' ELSE 'canton' END")
    return table(spark, sf_dir, "part").select("p_partkey", X.precedence_rank(kind, F.col("p_name"), F.col("p_brand")).cast("long").alias("rank"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?utm_[^&]*$', ''), '/$', '') AS url FROM pages""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs of pages."""
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url("url").alias("url"))


@query("""SELECT page_id, CASE page_id % 8 WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN url WHEN 4 THEN url WHEN 5 THEN base WHEN 6 THEN base || '#x' WHEN 7 THEN base || '?a' ELSE url END AS url FROM (SELECT *, regexp_replace(url, '[?#].*$', '') AS base FROM pages)""")
def url_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only absolute web URLs without credentials are safe, and they come in one form."""
    key, base = F.col("page_id") % 8, F.regexp_replace("url", "[?#].*$", "")
    shapes = [F.col("url"), F.regexp_replace("url", "://", "://user:secret@"), F.regexp_replace("url", "^https?:", "ftp:"), F.concat(F.upper(F.substring_index("url", ":", 1)), F.expr("substr(url, locate(':', url))")), F.concat(F.lit("\t "), "url", F.lit("\n")), F.concat(base, F.lit("?#")), F.concat(base, F.lit("?#x")), F.concat(base, F.lit(";?a#"))]
    odd = F.coalesce(*(F.when(key == k, shape) for k, shape in enumerate(shapes)))
    return table(spark, sf_dir, "pages").select("page_id", X.safe_url(odd).alias("url"))


@query()
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages as shown and as matched."""
    return table(spark, sf_dir, "pages").select("page_id", X.visible_for_display("html").alias("shown"), F.length(X.visible_for_matching("html")).alias("n_matched"))


# --- linkage ---------------------------------------------------------------------------------------------------


@query("""SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1""")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return table(spark, sf_dir, "documents").groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as linkage evidence: the source is the employer, the first line the title, the whole text the text; the
    URL is a digest of the whole text's letters, and every other document names a digest of its whole text as its
    requisition; some redirect to what their first line would be alone."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))
    tokens = lambda c: F.sort_array(X.tokens(F.col(c)))
    size = F.col("n_chars")
    digest = lambda c: F.when(F.length(c) >= 20, F.sha2(F.col(c).cast("binary"), 256)).otherwise("")
    seen = F.date_add(F.lit("2024-01-01").cast("date"), (size % 400).cast("int"))
    # Normalized once, in a projection of its own, and used several times.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text", plain(F.col("text")).alias("_plain"), plain(F.substring_index("text", "\n", 1)).alias("_head"))
    rows = docs.select(
        F.col("doc_id").alias("posting_id"),
        F.col("source").alias("employer"),
        F.col("lang").alias("location"),
        F.when(size % 3 == 0, "").when(size % 3 == 1, "80").otherwise("100").alias("terms"),
        F.when(size % 2 == 0, F.sha2(F.col("text").cast("binary"), 256)).otherwise("").alias("requisition"),
        digest("_plain").alias("url"),
        F.when(size % 5 == 0, digest("_head")).otherwise("").alias("redirect"),
        tokens("_head").alias("title_tokens"),
        tokens("_plain").alias("text_tokens"),
        F.array(F.col("lang")).alias("location_tokens"),
        seen.cast("timestamp").alias("first_seen_at"),
        F.when(size % 7 == 0, F.date_add(seen, 10).cast("timestamp")).alias("closed_at"),
    )
    return materialize(rows, "evidence")


_POSTINGS = """
l AS (SELECT *, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z]+', ' ', 'g')) AS head, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS plain FROM documents),
p AS (SELECT doc_id AS id, source AS employer, lang AS location, CASE n_chars % 3 WHEN 0 THEN '' WHEN 1 THEN '80' ELSE '100' END AS terms, CASE WHEN n_chars % 2 = 0 THEN sha256(text) ELSE '' END AS req,
  CASE WHEN length(plain) >= 20 THEN sha256(plain) ELSE '' END AS url, CASE WHEN n_chars % 5 = 0 AND length(head) >= 20 THEN sha256(head) ELSE '' END AS redirect,
  list_sort(list_filter(list_distinct(string_split(head, ' ')), lambda t: length(t) > 1)) AS title, list_sort(list_filter(list_distinct(string_split(plain, ' ')), lambda t: length(t) > 1)) AS body,
  DATE '2024-01-01' + (n_chars % 400)::INT AS seen, CASE WHEN n_chars % 7 = 0 THEN DATE '2024-01-11' + (n_chars % 400)::INT END AS closed FROM l),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY employer, location, terms, req, url, redirect, title, body, seen, closed ORDER BY id) = 1)"""
_BLOCKS = "SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.req = b.req AND a.req <> '' AND a.id < b.id UNION SELECT a.id, b.id FROM p a JOIN p b ON a.url = b.url AND a.url <> '' AND a.id < b.id"


@query(f"WITH {_POSTINGS}, e AS ({_BLOCKS}), f AS (SELECT a AS id FROM e UNION ALL SELECT b FROM e), n AS (SELECT id, count(*) AS n FROM f GROUP BY id) SELECT p.id AS posting_id, coalesce(n, 0) AS n_links FROM p LEFT JOIN n USING (id)")
def candidate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With how many others each document shares a hard key."""
    return linkage.link_counts(_postings(spark, sf_dir))


def _jaccard_sql(c: str) -> str:
    shared = f"len(list_intersect(a.{c}, b.{c}))"
    return f"CASE WHEN len(a.{c}) = 0 OR len(b.{c}) = 0 THEN 0.0 ELSE round_even({shared} / (len(a.{c}) + len(b.{c}) - {shared})::DOUBLE, 4) END"


_HARD_SQL = "(a.req <> '' AND a.req = b.req) OR (a.url <> '' AND a.url = b.url) OR (a.redirect <> '' AND a.redirect = b.url) OR (b.redirect <> '' AND b.redirect = a.url)"


def _scored_sql(rows: str) -> str:
    return f"""
s AS (SELECT a.id AS a, b.id AS b, a.employer = b.employer AS emp, a.location = b.location AS loc, a.terms <> '' AND a.terms = b.terms AS same_terms, a.terms <> '' AND b.terms <> '' AND a.terms <> b.terms AS other_terms,
  a.req <> '' AND a.req = b.req AS req, {_HARD_SQL} AS hard, a.employer = b.employer AND a.req <> '' AND b.req <> '' AND a.req <> b.req AS other_req,
  CASE WHEN a.seen <= b.seen THEN a.closed ELSE b.closed END AS closed, CASE WHEN a.seen <= b.seen THEN b.seen ELSE a.seen END AS again,
  {_jaccard_sql("title")} AS t, {_jaccard_sql("body")} AS x FROM {rows} a JOIN {rows} b ON a.id < b.id AND (a.employer = b.employer OR {_HARD_SQL})),
w AS (SELECT *, round((CASE WHEN emp THEN 2500 ELSE 0 END + CASE WHEN loc THEN 1500 ELSE 0 END + CASE WHEN same_terms THEN 1000 ELSE 0 END + CASE WHEN req THEN 500 ELSE 0 END)::DECIMAL(18, 4) / 10000
    + (CAST(t AS DECIMAL(9, 4)) * 25 + CAST(x AS DECIMAL(9, 4)) * 20)::DECIMAL(18, 4) / 100, 4) AS score FROM s WHERE hard OR (emp AND t >= 0.2)),
v AS (SELECT *, other_req OR NOT loc OR other_terms OR coalesce(again > closed AND NOT (req OR (again - closed <= 90 AND score >= 0.9)), false) AS barred FROM w),
pairs AS (SELECT a, b, t, x, score, hard, barred, CASE WHEN barred THEN 'KEEP_SEPARATE' WHEN hard OR score >= 0.9 THEN 'AUTO_MERGE' WHEN score >= 0.78 THEN 'REVIEW' ELSE 'KEEP_SEPARATE' END AS outcome FROM v)"""


_PAIRS = f"{_POSTINGS}, {_scored_sql('r')}"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assessed pairs of the classes' representatives, as candidates have them: a hard key, or one employer and titles
    alike to 0.2."""
    rows = _postings(spark, sf_dir)
    return linkage.candidate_outcomes(linkage.representatives(rows, materialize(linkage.classes(rows), "members")))


@query(f"WITH {_POSTINGS} SELECT id AS posting_id, min(id) OVER (PARTITION BY employer, location, terms, req, url, redirect, title, body, seen, closed) AS representative FROM p")
def posting_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one that represents those whose features are all the same."""
    return linkage.classes(_postings(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT a, b, t AS title_score, x AS text_score, score::DOUBLE AS score FROM pairs")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard scores, half to even, and weighted scores of all candidate pairs of representatives."""
    return _pairs(spark, sf_dir).select("a", "b", *(F.col(c).cast("double").alias(c) for c in ("title_score", "text_score", "score")))


@query(f"WITH {_PAIRS} SELECT a, b, outcome, barred FROM pairs")
def pair_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes and barriers of all candidate pairs of representatives, whatever their score; ``posting_classes`` tells whom
    each stands for."""
    return _pairs(spark, sf_dir).select("a", "b", "outcome", (F.size("barriers") > 0).alias("barred"))


@query(f"""WITH {_POSTINGS}, {_scored_sql("p")} SELECT count(*) AS candidate_pairs, count(*) FILTER (NOT human AND outcome = 'AUTO_MERGE' AND hard) AS hard_key_merges, count(*) FILTER (NOT human AND outcome = 'AUTO_MERGE' AND NOT hard) AS rule_auto_merges,
  count(*) FILTER (NOT human AND outcome = 'REVIEW') AS review_pairs, count(*) FILTER (NOT human AND outcome = 'KEEP_SEPARATE') AS keep_separate_pairs, count(*) FILTER (NOT human AND barred) AS hard_barrier_pairs FROM (SELECT pairs.*, (a * 7 + b) % 5 = 0 AND a = representative AS human FROM pairs JOIN (SELECT id, min(id) OVER (PARTITION BY employer, location, terms, req, url, redirect, title, body, seen, closed) AS representative FROM p) m ON m.id = b)""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all candidate pairs of all documents, copies included, without making the pairs of copies; humans have
    decided some pairs of copies."""
    rows = _postings(spark, sf_dir)
    members = materialize(linkage.classes(rows), "members")
    pairs = materialize(linkage.class_pairs(rows, members).select("a", "b", "n_pairs", "hard_key", "barriers", "outcome"), "pairs")
    human = members.where("representative < posting_id AND (representative * 7 + posting_id) % 5 = 0").select(F.col("representative").alias("a"), F.col("posting_id").alias("b"))  # plays the table of decisions
    return linkage.run_counters(pairs, linkage.decided_classes(human, members))


_REACH = """reach AS (SELECT id, id AS label FROM p UNION SELECT r.id, CASE WHEN e.a = r.label THEN e.b ELSE e.a END FROM reach r JOIN e ON r.label IN (e.a, e.b))"""


@query(f"WITH RECURSIVE {_POSTINGS}, e AS ({_BLOCKS}), {_REACH} SELECT id AS node, min(label) AS label FROM reach WHERE id IN (SELECT a FROM e UNION SELECT b FROM e) GROUP BY id")
def linked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of documents that share hard keys, each key's documents linked as a star."""
    rows = _postings(spark, sf_dir)
    stars = []
    for key in ("requisition", "url"):
        some = materialize(rows.where(F.length(key) > 0).select(key, "posting_id"), "keyed")
        centre = materialize(some.groupBy(key).agg(F.min("posting_id").alias("a")), "centres")
        stars.append(look_up(some, centre, key).where("a < posting_id").select("a", F.col("posting_id").alias("b")))
    return components(stars[0].union(stars[1]))


_CLUSTERS = f"WITH RECURSIVE {_POSTINGS}, {_scored_sql('p')}, e AS (SELECT a, b FROM pairs WHERE outcome = 'AUTO_MERGE'), {_REACH}, c AS (SELECT id, min(label) AS cluster FROM reach GROUP BY id)"
_DIGEST = "sum(('0x' || substr(sha256(id::VARCHAR), {}, 15))::BIGINT)"


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(linkage.vacancy_clusters(_postings(spark, sf_dir)), "clusters")


@query(f"{_CLUSTERS} SELECT cluster, count(*) AS n_postings, min(id) AS first_posting, sha256(count(*) || ':' || {_DIGEST.format(1)} || ':' || {_DIGEST.format(16)}) AS vacancy_key FROM c GROUP BY cluster")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of merged documents with their keys."""
    grouped = _clusters(spark, sf_dir).groupBy("cluster")
    return grouped.agg(F.count("*").alias("n_postings"), F.min("posting_id").alias("first_posting"), linkage.cluster_key("posting_id").alias("vacancy_key"))


def _cutoffs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Documents as they were known at three cutoffs: two thirds, some of them with other terms; then all but a seventh;
    then all, as they are."""
    rows, key = _postings(spark, sf_dir), F.col("posting_id")
    early = rows.where(key % 3 != 0).withColumn("terms", F.when(key % 10 == 1, "60").otherwise(F.col("terms")))
    return [early, rows.where(key % 7 != 3), rows]


def _increments(spark: SparkSession, sf_dir: str) -> tuple[increments.Index, list[DataFrame]]:
    index, reports = None, []
    for k, rows in enumerate(_cutoffs(spark, sf_dir)):
        index, report = increments.update(index, rows)
        reports.append(report.withColumn("step", F.lit(k + 1)))
    return index, reports


@query(f"{_CLUSTERS} SELECT id AS posting_id, cluster FROM c")
def incremental_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's cluster after two increments, in which documents came, went and changed: as from scratch."""
    return _increments(spark, sf_dir)[0].labels


@query("""WITH k AS (SELECT doc_id % 3 <> 0 AS one, doc_id % 7 <> 3 AS two, doc_id % 10 = 1 AS other FROM documents)
SELECT 1 AS step, count(*) FILTER (one) AS n_postings, count(*) FILTER (one) AS n_changed FROM k UNION ALL SELECT 2, count(*) FILTER (two), count(*) FILTER (one <> two OR (one AND other)) FROM k UNION ALL SELECT 3, count(*), count(*) FILTER (NOT two) FROM k""")
def increment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each increment holds, and how many it found changed."""
    reports = _increments(spark, sf_dir)[1]
    return reports[0].union(reports[1]).union(reports[2]).select("step", "n_postings", "n_changed")


@query(f"""{_CLUSTERS}, f AS (SELECT c.cluster, d.doc_id, d.n_chars % 3 AS rank, d.n_chars, CASE WHEN d.n_chars % 4 = 1 THEN (2 + d.doc_id % 7)::INT END AS n FROM c JOIN documents d ON d.doc_id = c.id)
SELECT cluster, arg_min(doc_id, (rank, n_chars, doc_id)) AS canonical_posting, CASE WHEN arg_min(n_chars, (rank, n_chars, doc_id)) % 2 = 0 THEN 'CLOSED_OBSERVED' ELSE 'ACTIVE' END AS status, count(*) AS n_postings,
  min(n_chars) AS first_seen, max(n_chars) AS last_seen, arg_min(n, (rank, doc_id)) FILTER (n IS NOT NULL) AS positions_count, bool_or(n IS NOT NULL OR n_chars % 4 = 2) AS multi_hire_possible FROM f GROUP BY cluster""")
def canonical_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's vacancy: canonical posting, which alone decides its status, bounds and positions."""
    size = F.col("n_chars")
    seen, state = F.timestamp_seconds("n_chars"), F.when(size % 2 == 0, "CLOSED_OBSERVED").otherwise("STILL_ACTIVE")
    said = F.when(size % 4 == 1, F.concat((2 + F.col("doc_id") % 7).cast("string"), F.lit(" Stellen"))).when(size % 4 == 2, "Lehrstellen").otherwise("")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("posting_id"), (size % 3).alias("rank"), seen.alias("first_seen_at"), seen.alias("last_seen_at"), state.alias("lifecycle_state"), said.alias("title"), F.lit("").alias("text"))
    found = linkage.vacancies(rows, _clusters(spark, sf_dir))
    return found.select("cluster", "canonical_posting", "status", "n_postings", F.unix_seconds("first_seen_at").alias("first_seen"), F.unix_seconds("last_seen_at").alias("last_seen"), "positions_count", "multi_hire_possible")


@query("""WITH t AS (SELECT doc_id AS target_id, text FROM documents), s AS (SELECT l.doc_id AS decision_id, d.text FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT text, least(count(DISTINCT decision_id), 2) AS n, min(decision_id) AS decision_id FROM s GROUP BY text)
SELECT target_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'UNMATCHED' WHEN n = 1 THEN 'APPLY' ELSE 'CONFLICT' END AS action, CASE WHEN n = 1 THEN decision_id END AS decision_id FROM t LEFT JOIN g USING (text)""")
def material_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on materially identical documents, of all targets and all labels: none, one to apply, or a conflict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("one").alias("posting_id"), V.row_fingerprint("text").alias("fingerprint"))
    targets = docs.withColumnRenamed("doc_id", "target_id").withColumn("target_at", at(AS_OF))
    decided = table(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id").withColumnRenamed("doc_id", "decision_id").withColumn("decided_at", at("2024-01-01 00:00:00"))
    return linkage.material_matches(targets, decided).select("target_id", "n", "action", "decision_id")


# --- snapshots -------------------------------------------------------------------------------------------------

_SHOWN = """SELECT o.o_orderkey AS vacancy_key, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED_OBSERVED' ELSE 'ACTIVE' END AS status, o_orderpriority AS source, c_name AS title, c_mktsegment AS employer,
  n_name AS municipality, o_orderdate AS first_seen_at, o_totalprice FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey"""


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    status = F.when(F.col("o_orderstatus") == "F", "CLOSED_OBSERVED").otherwise("ACTIVE")
    return joined.select(F.col("o_orderkey").alias("vacancy_key"), status.alias("status"), F.col("o_orderpriority").alias("source"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("employer"), F.col("n_name").alias("municipality"), F.to_date("o_orderdate").alias("published_at"), F.col("o_orderdate").alias("first_seen_at"), "o_totalprice")


_GIVEN = {"status": "ACTIVE", "source": "2-HIGH", "municipality": "nation_7", "published_from": "1996-03-01", "first_seen_to": "2000-12-31", "q": "BUILD"}
_WHERE = "status = 'ACTIVE' AND source = '2-HIGH' AND upper(municipality) = 'NATION_7' AND first_seen_at >= DATE '1996-03-01' AND first_seen_at < DATE '2001-01-01' AND (contains(upper(title), 'BUILD') OR contains(upper(employer), 'BUILD'))"


@query(f"SELECT vacancy_key, status, title, employer FROM ({_SHOWN}) WHERE {_WHERE} ORDER BY first_seen_at DESC, vacancy_key LIMIT 5")
def filter_api_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered, sorted page of the snapshot."""
    rows = _shown(spark, sf_dir).where(snapshot.FilterSpec.parse(_GIVEN).condition(snapshot.PLAIN_FILTERS))
    return snapshot.page(rows, [F.desc("first_seen_at"), F.asc("vacancy_key")], 1, 5).select("vacancy_key", "status", "title", "employer")


@query(f"SELECT vacancy_key, status, title FROM ({_SHOWN}) WHERE first_seen_at < TIMESTAMP '1999-06-01' OR (first_seen_at = TIMESTAMP '1999-06-01' AND vacancy_key > 100) ORDER BY first_seen_at DESC, vacancy_key LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a known row."""
    rows = _shown(spark, sf_dir)
    return snapshot.page_after(rows, "first_seen_at", "vacancy_key", ("1999-06-01 00:00:00", 100), 50).select("vacancy_key", "status", "title")


@query("""SELECT event_id, user_id FROM events WHERE CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Zurich' AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""")
def local_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose local date lies in a range, as instants."""
    return table(spark, sf_dir, "events").where(V.local_date_range("ts", snapshot.ZONE, "2024-01-10", "2024-01-12")).select("event_id", "user_id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer."""
    return pit.latest_by_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT count(*) AS effective_vacancies, count(*) FILTER (o_orderstatus <> 'F') AS active_vacancies, count(*) FILTER (o_orderstatus = 'F') AS closed_vacancies,
  count(*) FILTER (o_orderkey % 4 = 0) AS positions_numeric, count(*) FILTER (o_orderkey % 4 = 1) AS positions_multi, count(*) FILTER (o_orderkey % 4 > 1) AS positions_unknown FROM orders""")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a snapshot in one pass."""
    kind = F.col("o_orderkey") % 4
    states = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "CLOSED_OBSERVED").otherwise("ACTIVE").alias("status"), F.when(kind == 0, 2).alias("positions_count"), (kind <= 1).alias("multi_hire_possible"))
    return linkage.summary(states)


@query("""SELECT l_suppkey AS vacancy_key, string_agg(x, ',' ORDER BY r) FILTER (r <= 20) AS sources, count(*) AS n_postings FROM (SELECT l_suppkey, l_returnflag || ':' || l_orderkey || ':' || l_linenumber || ':' || l_partkey AS x,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) GROUP BY l_suppkey""")
def provenance_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty postings of each vacancy."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("vacancy_key"), F.col("l_returnflag").alias("membership_role"), F.col("l_orderkey").alias("posting_id"), F.struct("l_linenumber", "l_partkey").alias("source_posting_id"))
    told = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["membership_role"], s["posting_id"], s["source_posting_id"]["l_linenumber"], s["source_posting_id"]["l_partkey"])), ",")
    return snapshot.provenance(rows).select("vacancy_key", told.alias("sources"), "n_postings")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'MISSING_GREEN_ASSESSMENT' WHEN 1 THEN 'PUBLIC_GREEN_CONFIRMED' WHEN 2 THEN 'EXCLUDED_NOT_GREEN' ELSE 'REVIEW_NOT_PUBLIC' END AS visibility,
  CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'PRIVACY_RESOLUTION_MISSING' WHEN c_custkey % 5 = 0 THEN 'LOCATION_UNRESOLVED' WHEN c_custkey % 5 = 1 THEN 'LOCATION_REVIEW' WHEN c_custkey % 5 = 2 THEN 'LOCATION_UNRESOLVED'
    WHEN c_custkey % 2 = 0 THEN 'LOCATION_HIDDEN' WHEN c_acctbal / 100 NOT BETWEEN -90 AND 90 THEN 'PUBLIC_COORDINATES_MISSING' ELSE 'MAPPABLE' END AS mapping_status FROM customer""")
def visibility_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibility and mapping decision tables."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumns(
        {
            "resolution_status": F.when(key % 5 == 0, None).when(key % 5 == 1, "REVIEW").when(key % 5 == 2, "UNRESOLVED").otherwise("RESOLVED"),
            "privacy_context": F.when(key % 2 == 0, "PRIVATE_RESIDENCE").otherwise(places.PUBLIC),
            "latitude": F.col("c_acctbal") / 100,
            "longitude": F.col("c_nationkey").cast("double"),
        }
    )
    effective = F.when(key % 4 == 0, "MISSING").when(key % 4 == 1, "GREEN_CONFIRMED").when(key % 4 == 2, "NOT_GREEN").otherwise("REVIEW")
    return places.masked(rows).select("c_custkey", snapshot.visibility(effective).alias("visibility"), snapshot.mapping_status().alias("mapping_status"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'REVIEW' WHEN page_id % 5 = 1 THEN 'EXPIRED_SOURCE' WHEN page_id % 5 = 2 THEN 'CANONICAL' WHEN page_id % 5 = 3 THEN 'DISCOVERY_OR_HISTORICAL' ELSE 'NO_LINK_AVAILABLE' END AS status,
  CASE WHEN page_id % 5 IN (1, 2, 3) THEN url ELSE '' END AS url FROM pages""")
def source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link to show for each page."""
    key = F.col("page_id") % 5
    explicit = F.when(key == 0, "NOT_A_STATUS").when(key == 1, "expired_source")
    link = snapshot.source_link(explicit, F.when(key.isin(1, 2), F.col("url")).otherwise(""), F.when(key == 3, F.col("url")).otherwise(""), F.lit("CANONICAL"))
    return table(spark, sf_dir, "pages").select("page_id", link.alias("l")).select("page_id", "l.status", "l.url")


@query("SELECT round(c_acctbal / 100 / 10)::BIGINT AS latitude_cell, round(c_nationkey / 5.0)::BIGINT AS longitude_cell, count(*) AS n FROM customer GROUP BY ALL")
def grid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: points counted by grid cell."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 100 / 2).alias("latitude"), F.col("c_nationkey").cast("double").alias("longitude"))
    return places.grid(rows, 5.0).select("latitude_cell", "longitude_cell", "n")


# --- evidence and governance -----------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN lang || ' ' || source || ' x' || n_chars WHEN n_chars % 3 = 1 THEN 'x' || n_chars ELSE 'raw ' || lang END AS text, CASE WHEN n_chars % 3 = 0 THEN '80%' ELSE '' END AS workload FROM documents""")
def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of semi-structured payloads, parts or fallback."""
    kind, size = F.col("n_chars") % 3, F.concat(F.lit("x"), F.col("n_chars"))
    whole = F.to_json(F.struct(F.array("lang", "source").alias("description"), size.alias("benefits"), F.lit(" 80% ").alias("workload"), F.lit("no").alias("raw_text")))
    part = F.to_json(F.struct(size.alias("qualifications"), F.lit("").alias("description")))
    raw = F.to_json(F.struct(F.concat(F.lit("raw "), F.col("lang")).alias("raw_text")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(kind == 0, whole).when(kind == 1, part).otherwise(raw).alias("p"))
    return docs.select("doc_id", evidence.payload_text(F.col("p")).alias("text"), evidence.workload(F.col("p")).alias("workload"))


@query("""SELECT event_id, coalesce(t, '') AS title FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type <> 'error' THEN event_type || event_id END IGNORE NULLS) OVER w AS t FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE event_type = 'error'""")
def absence_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absences with the title that was last seen."""
    status = F.when(F.col("event_type") == "error", "NOT_FOUND").otherwise("ACTIVE")
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", status.alias("observation_status"), F.concat("event_type", "event_id").alias("title"), F.lit("u").alias("canonical_url"))
    return evidence.absence_rows(log, ["user_id"], _by_time()).select("event_id", "title")


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || CASE WHEN n_regionkey > 2 THEN 'null' ELSE n_regionkey::VARCHAR END || '}' AS row FROM nation""")
def serialized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON, nulls included."""
    nation = table(spark, sf_dir, "nation").withColumn("n_regionkey", F.when(F.col("n_regionkey") <= 2, F.col("n_regionkey")))
    return evidence.serialized(nation, ["n_nationkey", "n_name", "n_regionkey"])


@query("""SELECT page_id, nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([0-9]+)(\\.html?)?/?$', 1), '') AS posting_id FROM pages""")
def posting_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids read from URLs."""
    return table(spark, sf_dir, "pages").select("page_id", evidence.posting_id_of(F.col("url")).alias("posting_id"))


@query("""SELECT doc_id FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents) WHERE contains(t, ' and of the ') OR ((contains(t, ' de la ') OR contains(t, ' of the ')) AND (contains(t, ' que ') OR contains(t, ' with the ')))""")
def ext_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a decisive phrase, or a core phrase in context."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", plain.alias("t"))
    return docs.where(evidence.retrieved(F.col("t"), ["and of the"], ["de la", "of the"], ["que", "with the"])).select("doc_id")


@query("""SELECT s_suppkey, CASE WHEN k = 0 THEN 'NONE' WHEN k = 1 THEN 'REQUIRED' WHEN k = 2 AND s_acctbal > 0 THEN 'REQUIRED' WHEN k = 3 AND s_acctbal > 0 AND s_suppkey % 2 = 0 THEN 'SUPPORTING' WHEN k = 3 AND s_acctbal > 0 THEN 'REQUIRED' ELSE 'SUPPORTING' END AS role,
  CASE WHEN k = 0 THEN 'NOT_APPLICABLE' WHEN s_nationkey > 12 THEN 'READY_FOR_IMPLEMENTATION' ELSE 'BLOCKED_PENDING_ACCESS_REVIEW' END AS access FROM (SELECT *, s_suppkey % 5 AS k FROM supplier)""")
def source_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source is needed for and whether it may be collected."""
    key = F.col("s_suppkey")
    family = F.when(key % 5 == 0, "SALARY_REFERENCE").when(key % 5 == 1, "OFFICIAL_CANTON").when(key % 5 == 2, "OFFICIAL_FEDERAL").when(key % 5 == 3, "OFFICIAL_MUNICIPAL").otherwise("PRIVATE")
    rows = table(spark, sf_dir, "supplier").withColumns(
        {
            "source_family": family,
            "source_type": F.lit("PORTAL"),
            "priority": F.when(F.col("s_acctbal") > 0, "P0").otherwise("P1"),
            "canonicality": F.lit("CANONICAL"),
            "coverage_scope": F.when(key % 2 == 0, "Green Unit jobs").otherwise("all"),
            "automation_status": F.when(F.col("s_nationkey") > 12, "READY_FOR_IMPLEMENTATION").otherwise("METHOD_RESEARCH_REQUIRED"),
            "legal_review_status": F.lit("PUBLIC_DATA_DOCUMENTED"),
        }
    )
    return rows.select("s_suppkey", governance.source_policy().alias("p")).select("s_suppkey", "p.role", "p.access")


@query("""SELECT 'orders' AS "table", o_orderkey::VARCHAR AS key, 'o_custkey' AS field, o_custkey::VARCHAR AS target_key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def package_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a package to rows that it does not hold."""
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    edges = governance.relationships(orders, "orders", "o_orderkey", {"o_custkey": "customer"})
    return governance.dangling(edges, governance.inventory({"customer": (customer, "c_custkey")})).select("table", "key", "field", "target_key")


@query("""SELECT o_orderkey, o_orderpriority, previous_o_orderpriority, n > 1 AND o_orderpriority IS DISTINCT FROM previous_o_orderpriority AS changed FROM (SELECT *, lag(o_orderpriority) OVER w AS previous_o_orderpriority, row_number() OVER w AS n
  FROM orders WHERE o_orderstatus = 'F' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def cycle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful cycles against the successful one before."""
    found = governance.against_previous(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderpriority"])
    return found.select("o_orderkey", "o_orderpriority", "previous_o_orderpriority", "changed")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def distinct_cycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each cycle and fingerprint."""
    return governance.distinct_events(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT p_partkey, round((p_size - avg(p_size) OVER w) / stddev_samp(p_size) OVER w, 6) AS z_size FROM part WINDOW w AS (PARTITION BY p_type)""")
def ext_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: standardized values within groups."""
    found = governance.zscores(table(spark, sf_dir, "part"), ["p_type"], ["p_size"])
    return found.select("p_partkey", F.round("z_p_size", 6).alias("z_size"))


# --- metrics and expectations ----------------------------------------------------------------------------------


@query("""SELECT metric, n::BIGINT AS numerator, d::BIGINT AS denominator, round_even(n / d::DOUBLE, 6) AS ratio FROM (
  SELECT 'open' AS metric, count(*) FILTER (o_orderstatus = 'O') AS n, count(*) AS d FROM orders
  UNION ALL SELECT 'urgent_of_open', count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'O') FROM orders
  UNION ALL SELECT 'large', count(*) FILTER (o_totalprice > 250000), count(*) FROM orders)""")
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio metrics with numerators and denominators in one pass."""
    is_open = F.col("o_orderstatus") == "O"
    metrics = {"open": (is_open, F.lit(True)), "urgent_of_open": (F.col("o_orderpriority") == "1-URGENT", is_open), "large": (F.col("o_totalprice") > 250000, F.lit(True))}
    found = readiness.ratio_metrics(table(spark, sf_dir, "orders"), metrics)
    return found.withColumn("ratio", F.col("ratio").cast("double"))


_MINIMA = {"AFRICA": 1, "ASIA": 1000, "ATLANTIS": 1, "EUROPE": 2}


@query(
    "WITH m(stratum, minimum) AS (VALUES "
    + ", ".join(f"('{k}', {v})" for k, v in _MINIMA.items())
    + """), c AS (SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal > 0 GROUP BY r_name)
SELECT stratum, minimum::BIGINT AS minimum, coalesce(n, 0) AS n, coalesce(n, 0) >= minimum AS passes FROM m LEFT JOIN c ON c.r_name = stratum"""
)
def stratum_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by stratum against minima."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    evidence = joined.select(F.col("r_name").alias("stratum"), (F.col("s_acctbal") > 0).alias("counts_toward_coverage"))
    return readiness.stratum_minima(evidence, _MINIMA).withColumn("minimum", F.col("minimum").cast("long"))


@query(f"SELECT o_custkey, max(o_orderdate) >= TIMESTAMP '{MARKET_AS_OF}' - INTERVAL 72 HOUR AS fresh FROM orders WHERE o_orderdate <= TIMESTAMP '{MARKET_AS_OF}' GROUP BY o_custkey")
def freshness_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is each customer's latest order 72 hours old at most, the bound included."""
    last = table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= at(MARKET_AS_OF)).groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return last.select("o_custkey", readiness.fresh(F.col("last"), at(MARKET_AS_OF)).alias("fresh"))


@query("""SELECT l_orderkey, n, lines, parts, n = lines AND n = parts AS consistent FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS lines, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_orderkey)""")
def counter_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do an order's counters agree."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("lines"), F.count_distinct("l_partkey").alias("parts"))
    return counted.withColumn("consistent", readiness.all_equal("n", "lines", "parts"))


@query("""SELECT k, 'left' AS only_in FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)
UNION ALL SELECT k, 'right' FROM (SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 10 EXCEPT SELECT o_orderkey FROM orders)""")
def universe_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one of two universes holds."""
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    right = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("k")).distinct()
    return snapshot.misaligned(left, right, "k")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a pending order."""
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(pending, "c_custkey", "left_anti")


@query("""SELECT s_suppkey, n_nationkey FROM supplier LEFT JOIN (SELECT n_nationkey % 20 AS name, min(n_nationkey) AS n_nationkey FROM nation GROUP BY name HAVING count(*) = 1) n ON name = s_suppkey % 23""")
def unique_dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension looked up by a name that must lead to exactly one row."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("  Place "), (F.col("n_nationkey") % 20).cast("string")).alias("name"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("PLACE  "), (F.col("s_suppkey") % 23).cast("string")).alias("wanted"))
    return places.unique_match(supplier, "wanted", nation, "name", "n_nationkey").select("s_suppkey", "n_nationkey")


_RULES = ["o_totalprice > 1000", "o_orderstatus IN ('O', 'F')", "o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'", "o_custkey % 10 <> 3"]


@query(" UNION ALL ".join(f"SELECT 'rule{k}' AS rule, count(*) FILTER (NOT coalesce({r}, false)) AS n_violations FROM orders" for k, r in enumerate(_RULES)))
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each rule, in one pass."""
    return expectations.violations(table(spark, sf_dir, "orders"), {f"rule{k}": F.expr(r) for k, r in enumerate(_RULES)})


@query("SELECT n_nationkey, sha256('n_name=' || length(n_name) || ':' || n_name || '|n_nationkey=' || length(n_nationkey::VARCHAR) || ':' || n_nationkey || '|n_regionkey=' || length(n_regionkey::VARCHAR) || ':' || n_regionkey) AS fingerprint FROM nation")
def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of rows in a canonical order of names."""
    return table(spark, sf_dir, "nation").select("n_nationkey", V.row_fingerprint("n_nationkey", "n_name", "n_regionkey").alias("fingerprint"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'MISSING' WHEN c_custkey % 11 = 0 THEN 'EXTRA' WHEN c_custkey % 5 = 0 THEN 'CONFLICTING' ELSE 'IDENTICAL' END AS state FROM customer WHERE NOT (c_custkey % 7 = 0 AND c_custkey % 11 = 0)""")
def identity_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package against the current rows, by key and digest."""
    rows = table(spark, sf_dir, "customer").withColumn("d", V.row_fingerprint("c_name"))
    package = rows.where("c_custkey % 11 <> 0").select("c_custkey", "d")
    current = rows.where("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "other").otherwise(F.col("d")).alias("d"))
    return expectations.compare_by_hash(package, current, "c_custkey", "d")


@query("""SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, upper(p_name), p_size + 2 FROM part WHERE p_partkey % 3 = 0""")
def upsert_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows, of which every key has two, put into a dimension by key: the greater size counts."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    fresh = part.where("p_partkey % 3 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.explode(F.array(F.col("p_size") + 1, F.col("p_size") + 2)).alias("p_size"))
    return expectations.upsert(part, fresh, ["p_partkey"], [F.desc("p_size")])


@query("""SELECT o_custkey FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey) WHERE n > 1""")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with more than one value."""
    return expectations.conflicts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority").select("o_custkey")


@query("""SELECT sum(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END)::BIGINT AS known_positions, count(*) FILTER (o_orderkey % 4 <> 0) AS "unknown", count(*) FILTER (o_orderkey % 4 = 1) AS multi_hire FROM orders WHERE o_orderstatus <> 'F'""")
def market_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the active market."""
    kind = F.col("o_orderkey") % 4
    states = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "CLOSED_OBSERVED").otherwise("ACTIVE").alias("status"), F.when(kind == 0, 2).alias("positions_count"), (kind == 1).alias("multi_hire_possible"))
    return readiness.market_state(states).withColumn("known_positions", F.col("known_positions").cast("long"))


@query(f"""SELECT region, segment, count(*) AS n, round(median(price), 2) AS median, round(sum(price), 0) AS total FROM (SELECT r_name AS region, c_mktsegment AS segment, o_totalprice AS price FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY GROUPING SETS ((region, segment), (region), ())""")
def ext_market_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the market at several levels of grouping."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    rows = rows.select(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), F.col("o_totalprice").alias("price"))
    cube = readiness.market_cube(rows, [["region", "segment"], ["region"], []], ["region", "segment"], "price")
    return cube.select("region", "segment", "n", F.round("median", 2).alias("median"), F.round("total", 0).alias("total"))


#: Quartiles of prices in cents are whole quarters of a cent: as integers, no rounding is in doubt.
_QUARTER_CENTS = 400


@query(
    "SELECT o_custkey, count(*) AS n, "
    + ", ".join(f"CASE WHEN count(*) >= 5 THEN round(quantile_cont(o_totalprice, {q}) * {_QUARTER_CENTS})::BIGINT END AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75))
    + " FROM orders GROUP BY o_custkey"
)
def ext_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: quartiles in quarter cents, withheld for small groups."""
    found = readiness.guarded_percentiles(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice")
    return found.select("o_custkey", "n", *(F.round(F.col(p) * _QUARTER_CENTS).cast("long").alias(p) for p in ("p25", "p50", "p75")))
