"""Text classification against rule taxonomies, and the human decisions laid over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.matching import Pattern, matcher, names_of
from chronolith.functions.text import fold

#: Terms of a taxonomy at most: the automaton that finds them is held by every Python worker.
MAX_TERMS = 1_000_000


@dataclass(frozen=True)
class Term:
    """A search term and its kind."""

    term_id: str
    search_term: str
    term_type: str


# Where each kind of term is looked for, and what a match counts as.
KINDS = {
    "TITLE": (("title",), "positive"),
    "TITLE_OR_TEXT": (("title", "text"), "positive"),
    "HIDDEN_PUBLIC_TITLE": (("title",), "hidden"),
    "TEXT_SIGNAL": (("title", "text"), "signal"),
    "ORGANIZATION_SIGNAL": (("organization",), "organization"),
    "EXCLUSION": (("title", "text"), "exclusion"),
}


def terms_of(taxonomy: DataFrame) -> list[Term]:
    """A taxonomy's terms; it must hold at most ``MAX_TERMS`` with ids of their own and known kinds."""
    rows = taxonomy.select("term_id", "search_term", "term_type").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS or len({r.term_id for r in rows}) != len(rows) or {r.term_type for r in rows} - KINDS.keys():
        raise ValueError("a taxonomy has too many terms, repeated ids or unknown kinds")
    return sorted((Term(*r) for r in rows), key=lambda t: t.term_id)


def relevance(rows: DataFrame, terms: list[Term]) -> DataFrame:
    """``result, reason`` and matched term ids of rows with normalized ``title, text, organization``.

    Terms are literal substrings, all found in one pass over each surface. A positive term beside an exclusion needs review; either alone decides; weaker
    signals need review in the order hidden title, organization, text.
    """
    patterns = [Pattern(t.term_id, " ".join(fold(t.search_term).split()), KINDS[t.term_type][1], KINDS[t.term_type][0]) for t in terms]
    find = matcher(rows.sparkSession, patterns)
    rows = rows.withColumn("_hits", find(title=F.col("title"), text=F.col("text"), organization=F.col("organization")))
    matched = {f"matched_{kind}": names_of("_hits", kind) for kind in dict.fromkeys(kind for _, kind in KINDS.values())}
    some = lambda kind: F.size(f"matched_{kind}") > 0
    decided = [
        (some("positive") & some("exclusion"), "REVIEW", "POSITIVE_AND_EXCLUSION_CONFLICT"),
        (some("positive"), "GREEN_CONFIRMED", "STRONG_GREEN_TAXONOMY_SIGNAL"),
        (some("exclusion"), "NOT_GREEN", "EXCLUSION_WITHOUT_GREEN_SIGNAL"),
        (some("hidden"), "REVIEW", "HIDDEN_PUBLIC_TITLE_NEEDS_GREEN_TASK"),
        (some("organization"), "REVIEW", "ORGANIZATION_SIGNAL_ONLY"),
        (some("signal"), "REVIEW", "CONDITIONAL_SIGNAL_ONLY"),
    ]
    return rows.withColumns(matched).drop("_hits").withColumns({"result": first_match([(c, r) for c, r, _ in decided], "NOT_GREEN"), "reason": first_match([(c, r) for c, _, r in decided], "NO_GREEN_TAXONOMY_SIGNAL")})


def first_match(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    """A decision table: the value of the first rule that holds."""
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, F.lit(value))
    return chain.otherwise(F.lit(otherwise))


def effective_result(assessments: DataFrame, decisions: DataFrame, applications: DataFrame, as_of: Column) -> DataFrame:
    """The result in force at a cutoff: what the classifier left for review takes the latest human decision.

    A direct decision beats an inherited application; INSUFFICIENT leaves a review; a null result is MISSING. A
    decision needs both its review and its record by the cutoff, an application itself and its source decision.
    """
    known = (F.col("reviewed_at") <= as_of) & (F.col("created_at") <= as_of)
    latest = lambda rows, key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc(rows)))
    direct = decisions.where(known).withColumn("_r", latest("decision_id", "assessment_id")).where("_r = 1").select("assessment_id", F.col("outcome").alias("_direct"))
    source = decisions.where(known).select(F.col("decision_id").alias("source_decision_id"), F.col("outcome").alias("_inherited"))
    applied = applications.where(F.col("created_at") <= as_of).join(source, "source_decision_id").withColumn("_r", latest("application_id", "assessment_id")).where("_r = 1").select("assessment_id", "_inherited")
    human = F.coalesce("_direct", "_inherited")
    value = (
        F.when(F.col("result").isNull(), "MISSING")
        .when(F.col("result") != "REVIEW", F.col("result"))
        .when(human == "INSUFFICIENT", "REVIEW")
        .otherwise(F.coalesce(human, F.lit("REVIEW")))
    )
    return assessments.join(direct, "assessment_id", "left").join(applied, "assessment_id", "left").withColumn("effective_result", value).drop("_direct", "_inherited")


# The signal ids of each group, and the surfaces of each scope in the order in which they are tried.
STRONG = ("P001", "P002", "P003", "P005")
QUALIFIED = ("P004",)
ESTATE = ("P006", "P007", "P009", "P010", "P011")
ESTATE_ROLE = ("P012", "P013", "P014")
WEAK = ("P008", "P024")
AUXILIARY = ("P015", "P016", "P017", "P018", "P019", "P020", "P021", "P022", "P023")
JOB_SURFACES = ("benefits", "description", "qualifications", "responsibilities", "title")
SCOPES = ("JOB", "JOB_OR_EMPLOYER", "JOB_OR_SOURCE", "TITLE_OR_TEXT", "INFERENCE")


@dataclass(frozen=True)
class Signal:
    """A phrase, normalized, and where it counts."""

    signal_id: str
    phrase: str
    scope: str


def segments(rows: DataFrame, signals: list[Signal]) -> DataFrame:
    """``segment, status, rule, strength, reason, privacy_context`` and matches of rows with ``effective_result``,
    normalized job surfaces and ``profiles`` (normalized texts of the employer's profiles).

    Only confirmed rows are classified. A signal counts on the first job surface that holds its phrase of whole
    tokens, and on an employer profile if its scope allows. Weights play no part in the decision.
    """
    if unknown := {s.scope for s in signals} - set(SCOPES):
        raise ValueError(f"unknown scopes {sorted(unknown)}")
    counting = [s for s in signals if s.scope != "INFERENCE"]
    job = [Pattern(s.signal_id, s.phrase, str(k), JOB_SURFACES) for k, s in enumerate(counting)]
    profile = [Pattern(s.signal_id, s.phrase, f"{k}p", ("profiles",)) for k, s in enumerate(counting) if s.scope == "JOB_OR_EMPLOYER"]
    find = matcher(rows.sparkSession, job + profile, whole_tokens=True)
    # Profiles are read as one text; no phrase holds the character between them.
    texts = {c: F.col(c) for c in JOB_SURFACES} | {"profiles": F.array_join(F.coalesce("profiles", F.array().cast("array<string>")), " \x00 ")}
    first = F.filter("_hits", lambda h, k: (k == 0) | (F.get("_hits", k - 1)["bucket"] != h["bucket"]))
    surface = lambda h: F.when(h["surface"] == "profiles", "EMPLOYER_PROFILE").otherwise(F.upper(h["surface"]))
    named = F.transform(first, lambda h: F.struct(h["name"].alias("signal_id"), surface(h).alias("surface")))
    rows = rows.withColumn("_hits", find(**texts)).withColumn("matches", named).drop("_hits")
    any_of = lambda ids: F.exists("matches", lambda m: m["signal_id"].isin(*ids))
    profile_premium = F.exists("matches", lambda m: m["signal_id"].isin(*STRONG) & (m["surface"] == "EMPLOYER_PROFILE"))
    premium, estate, role = any_of(STRONG), any_of(ESTATE), any_of(ESTATE_ROLE)
    table = [
        (F.coalesce("effective_result", F.lit("MISSING")) != "GREEN_CONFIRMED", ("UNKNOWN", "SKIPPED_NOT_GREEN", "GREEN_RELEVANCE_GATE", "NONE", "GREEN_CONFIRMED_REQUIRED", False)),
        (premium & (estate | role), ("UNKNOWN", "REVIEW", "CONFLICTING_EXPLICIT_SEGMENTS", "STRONG", "PREMIUM_AND_ESTATE_CONFLICT", True)),
        (estate, ("PRIVATE_ESTATE_DIRECT", "CLASSIFIED", "EXPLICIT_ESTATE_SIGNAL", "STRONG", "PRIVATE_ESTATE_EVIDENCE", True)),
        (role, ("PRIVATE_ESTATE_DIRECT", "CLASSIFIED", "GREEN_CORROBORATED_ESTATE_ROLE", "MODERATE", "PRIVATE_ESTATE_EVIDENCE", True)),
        (premium & profile_premium, ("PRIVATE_RESIDENTIAL_PREMIUM", "CLASSIFIED", "EMPLOYER_PROFILE_SIGNAL", "MODERATE", "EXPLICIT_PREMIUM_EVIDENCE", True)),
        (premium, ("PRIVATE_RESIDENTIAL_PREMIUM", "CLASSIFIED", "EXPLICIT_JOB_SIGNAL", "STRONG", "EXPLICIT_PREMIUM_EVIDENCE", True)),
        (any_of(QUALIFIED), ("UNKNOWN", "REVIEW", "QUALIFIED_PREMIUM_SIGNAL", "MODERATE", "P004_REQUIRES_CORROBORATION", False)),
        (any_of(WEAK), ("PRIVATE_RESIDENTIAL_STANDARD", "CLASSIFIED", "WEAK_PRIVATE_SIGNAL", "WEAK", "PRIVATE_NON_PREMIUM_EVIDENCE", True)),
        (any_of(AUXILIARY), ("UNKNOWN", "NO_SUFFICIENT_EVIDENCE", "NO_AUTOMATIC_CLASSIFICATION", "NONE", "AUXILIARY_SIGNAL_INSUFFICIENT", False)),
    ]
    last = ("UNKNOWN", "NO_SUFFICIENT_EVIDENCE", "NO_AUTOMATIC_CLASSIFICATION", "NONE", "NO_PREMIUM_TAXONOMY_SIGNAL", False)
    names = ["segment", "status", "rule", "strength", "reason"]
    columns = {n: first_match([(c, v[k]) for c, v in table], last[k]) for k, n in enumerate(names)}
    private = first_match([(c, v[5]) for c, v in table], last[5])
    return rows.withColumns(columns | {"privacy_context": F.when(private, "PRIVATE_RESIDENCE").otherwise("PUBLIC_OR_NON_RESIDENTIAL")})


# The statuses and segments that a run counts, met or not.
STATUSES = ("CLASSIFIED", "REVIEW", "NO_SUFFICIENT_EVIDENCE", "SKIPPED_NOT_GREEN")
SEGMENTS = ("PRIVATE_RESIDENTIAL_STANDARD", "PRIVATE_RESIDENTIAL_PREMIUM", "PRIVATE_ESTATE_DIRECT", "UNKNOWN")


def segment_counts(judged: DataFrame) -> DataFrame:
    """One row: how many rows were considered and eligible, and how many have each status and segment."""
    by = lambda column, names: [F.count_if(F.col(column) == n).alias(f"{column}_{n.lower()}") for n in names]
    eligible = F.count_if(F.col("effective_result") == "GREEN_CONFIRMED").alias("eligible")
    return judged.agg(F.count("*").alias("considered"), eligible, *by("status", STATUSES), *by("segment", SEGMENTS))
