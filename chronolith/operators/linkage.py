"""Linking postings that advertise the same vacancy: blocking, scoring, barriers, components, projections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.text import jaccard, position_count
from chronolith.functions.values import seconds_between
from chronolith.operators.components import components
from chronolith.operators.lookup import beside, look_up, meet
from chronolith.operators.rules import first_match
from chronolith.operators.tiles import SIGNS, Case, like_pairs
from chronolith.session import materialize

# Feature weights, thresholds, the repost window.
WEIGHTS = {"employer": "0.25", "title": "0.25", "location": "0.15", "text": "0.20", "terms": "0.10", "requisition": "0.05"}
MERGE_FROM, REVIEW_FROM, CANDIDATE_FROM = "0.90", "0.78", "0.20"
REPOST_DAYS = 90

#: What pairs are scored on; names with ``_tokens`` are arrays made once, before any join.
FEATURES = ["employer", "location", "terms", "requisition", "url", "redirect", "title_tokens", "text_tokens", "location_tokens", "first_seen_at", "closed_at"]

#: What pairs are judged by, beside their ids.
SIGNED = ["title", "text", *SIGNS, "redirected", "apart", "a_seen", "b_seen", "a_closed", "b_closed"]


def equal_pairs(rows: DataFrame, key: str, other: str | None = None, partners: DataFrame | None = None) -> DataFrame:
    """Ordered pairs ``(a, b)``, a < b, of postings whose non-empty keys are equal: within ``rows``, or of ``rows`` with
    ``partners``."""
    left = rows.where(F.length(key) > 0).select(F.col("posting_id").alias("l"), F.col(key).alias("k"))
    right = (rows if partners is None else partners).where(F.length(other or key) > 0).select(F.col("posting_id").alias("r"), F.col(other or key).alias("k"))
    pairs = meet(left, right, ["k"], "l", "r").where(F.col("l") < F.col("r") if other is None and partners is None else F.col("l") != F.col("r"))
    return pairs.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))


def titled_pairs(rows: DataFrame, least: str = CANDIDATE_FROM, keys: tuple[str, ...] = ("employer",)) -> DataFrame:
    """Pairs with equal non-empty ``keys`` whose titles' Jaccard is ``least`` or more, each pair once."""
    return like_pairs(rows, list(keys), least).select("a", "b")


def hard_pairs(rows: DataFrame) -> DataFrame:
    """Pairs with a hard key in common: a union of equality joins."""
    return reduce(DataFrame.union, [equal_pairs(rows, "requisition"), equal_pairs(rows, "url"), equal_pairs(rows, "redirect", "url")]).distinct()


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """Pairs with a hard key in common, or of one employer with titles alike enough.

    Meant for the representatives of ``classes``: copies have the outcomes of their representatives.
    """
    return hard_pairs(rows).union(titled_pairs(rows)).distinct()


def candidate_outcomes(rows: DataFrame) -> DataFrame:
    """``scored_pairs`` of all ``candidate_pairs``, without carrying postings to pairs: those of one employer with titles
    alike enough are judged in the tiles that make them, and only the others under a hard key are joined."""
    alike = assessed(like_pairs(rows, ["employer"], CANDIDATE_FROM))
    both = scored_pairs(rows, materialize(hard_pairs(rows), "candidates"), alike=True).where("NOT alike").drop("alike")
    return alike.unionByName(both, allowMissingColumns=True)


#: Without a hard key, 0.78 takes equal employers, and: equal locations and terms; or equal locations and titles alike to
#: 0.72; or equal terms and titles alike to 0.92; for texts alike to 1. With titles alike to 1, texts as like as told here.
DECISIVE = [Case(("location", "terms"), (), 0.3198, 0.1498), Case(("location",), ("terms",), 0.7198, 0.6498), Case(("terms",), ("location",), 0.9198, 0.8998)]


def decisive_outcomes(rows: DataFrame) -> DataFrame:
    """Those of ``candidate_outcomes`` that merge or are left for review, without making the others of one employer."""
    decided = lambda df: df.where("outcome <> 'KEEP_SEPARATE'")
    least = lambda f: str(min(getattr(c, f) for c in DECISIVE))
    alike = decided(assessed(like_pairs(rows, ["employer"], least("title"), least("text"), cases=DECISIVE))).where("NOT hard_key")
    return alike.unionByName(decided(scored_pairs(rows, materialize(hard_pairs(rows), "candidates"))).where("hard_key"), allowMissingColumns=True)


def with_pairs(outcomes: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``outcomes`` with those of ``asked`` (a, b: written) that are candidates and not among them."""
    outcomes, more = materialize(outcomes, "outcomes"), scored_pairs(rows, asked)
    return outcomes.unionByName(more.join(outcomes.select("a", "b"), ["a", "b"], "left_anti"), allowMissingColumns=True)


def class_pairs(rows: DataFrame, members: DataFrame, outcomes: Callable[[DataFrame], DataFrame] = candidate_outcomes) -> DataFrame:
    """All candidate pairs (or those of other ``outcomes``), as pairs of classes: ``scored_pairs`` of representatives, each with
    the number of pairs of postings that it stands for (``n_pairs``): those between two classes, and those among the copies
    of one (a = b).

    A posting's closure is never before its first sight, so of two first seen at once neither comes after the other's
    closure, and all pairs of two classes have one outcome.
    """
    sizes = materialize(members.groupBy("representative").agg(F.count("*").alias("n")), "sizes")
    several = materialize(sizes.where("n > 1").select(F.col("representative").alias("posting_id"), "n"), "several")
    one = beside(representatives(rows, members), several, "posting_id", "left", "representatives").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    copies = scored_pairs(one, sizes.where("n > 1").select(F.col("representative").alias("a"), F.col("representative").alias("b")))
    pairs = F.when(F.col("a") == F.col("b"), F.expr("n_a * (n_a - 1) DIV 2")).otherwise(F.col("n_a") * F.col("n_b"))
    return outcomes(one).unionByName(copies).withColumn("n_pairs", pairs).drop("n_a", "n_b")


def classes(rows: DataFrame, apart: DataFrame | None = None) -> DataFrame:
    """``(posting_id, representative)``: postings with all features equal form a class, which its least id represents.
    Postings of ``apart`` (posting_id: those on which humans have decided) are classes of their own."""
    digest = F.sha2(F.to_json(F.struct(*FEATURES), {"ignoreNullFields": "false"}), 256)
    named = rows.select("posting_id", digest.alias("class"))
    if apart is not None:
        own = apart.select("posting_id", F.lit(True).alias("_own")).distinct()
        alone = F.concat("class", F.lit(":"), F.col("posting_id").cast("string"))
        named = named.join(own, "posting_id", "left").select("posting_id", F.when(F.col("_own"), alone).otherwise(F.col("class")).alias("class"))
    marked = materialize(named, "classes")
    least = materialize(marked.groupBy("class").agg(F.min("posting_id").alias("representative")), "representatives")
    return look_up(marked, least, "class").select("posting_id", "representative")


def representatives(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows that represent their class. Wide rows stay where they are if copies are few, and else are written."""
    own = members.where("posting_id = representative").select("posting_id")
    copies = materialize(members.select("posting_id").distinct().join(own, "posting_id", "left_anti"), "copies")
    return beside(rows.where(F.col("posting_id").isNotNull()), copies, "posting_id", "left_anti", "representatives")


def link_counts(rows: DataFrame) -> DataFrame:
    """``(posting_id, n_links)``: with how many other postings each shares a requisition or a URL, without pairing them:
    the group of either key less the group of both."""
    keyed = materialize(rows.select("posting_id", "requisition", "url"), "keyed")
    sizes = {}
    for name, key in {"r": ["requisition"], "u": ["url"], "both": ["requisition", "url"]}.items():
        some = reduce(lambda x, y: x & y, (F.length(k) > 0 for k in key))
        counted = materialize(keyed.where(some).groupBy(*key).agg((F.count("*") - 1).alias("n")), "counts")
        sizes[name] = look_up(keyed.where(some), counted, key).select("posting_id", (F.lit(-1 if name == "both" else 1) * F.col("n")).alias("n"))
    every = reduce(DataFrame.union, sizes.values(), keyed.select("posting_id", F.lit(0).cast("long").alias("n")))
    return every.groupBy("posting_id").agg(F.sum("n").alias("n_links"))


#: Without a hard key a merge takes equal employers, locations and terms, titles alike to 0.8 ...
MERGE_KEYS, MERGE_TITLES = ("employer", "location", "terms"), "0.79"
#: ... and texts alike to 0.75, since equal titles leave 0.15 to a weight of 0.20; scores are rounded.
MERGE_TEXTS = "0.7497"


def hard_merge_candidates(rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Pairs under hard keys that connect all postings which merge by them, few of them; only those with a posting of
    ``among`` (posting_id), if given.

    Of postings that were never closed and agree in all but title, text and first sight, any two with a requisition or URL
    merge, so they are linked as a star. Whatever merges with one of them by a hard key merges with the one that was seen
    first, since only a closure before its first sight can part them; so that one alone, the star's centre, meets others.
    Postings that were closed, or have no key but a redirect, meet all that share a key with them.
    """
    some = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    keyed = rows.where(some("requisition") | some("url") | some("redirect"))
    same = F.sha2(F.to_json(F.struct("employer", "location", "terms", "requisition", "url", "redirect", "location_tokens"), {"ignoreNullFields": "false"}), 256)
    starred = F.col("closed_at").isNull() & (some("requisition") | some("url"))
    marked = materialize(keyed.select("posting_id", "requisition", "url", "redirect", "first_seen_at", starred.alias("starred"), same.alias("same")), "marked")
    centres = materialize(marked.where("starred").groupBy("same").agg(F.min_by("posting_id", F.struct("first_seen_at", "posting_id")).alias("centre")), "centres")
    own = (lambda df: df) if among is None else (lambda df: df.join(among, "posting_id", "left_semi"))
    stars = look_up(own(marked.where("starred")), centres, "same").where("centre <> posting_id").select(F.least("centre", "posting_id").alias("a"), F.greatest("centre", "posting_id").alias("b"))
    few = materialize(marked.where("NOT starred").unionByName(marked.join(centres.select(F.col("centre").alias("posting_id")), "posting_id", "left_semi").where("starred")), "few")
    ours = few if among is None else materialize(own(few), "few")
    met = [equal_pairs(ours, k, o, few) for k, o in (("requisition", "requisition"), ("url", "url"), ("redirect", "url"), ("url", "redirect"))]
    return reduce(DataFrame.union, [stars, *met]).distinct()


def like_merges(rows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Pairs ``(a, b)`` that merge by equal employers, locations and terms and like titles and texts; only those with a
    posting of ``asked``, if given."""
    return assessed(like_pairs(rows, list(MERGE_KEYS), MERGE_TITLES, MERGE_TEXTS, asked)).where("outcome = 'AUTO_MERGE'").select("a", "b")


def vacancy_clusters(rows: DataFrame) -> DataFrame:
    """``(posting_id, cluster)`` by the rules alone, without pairing copies: the least id of each posting's cluster."""
    members = materialize(classes(rows), "members")
    one = representatives(rows, members)
    # A class whose copies merge is linked to itself.
    copies = members.where("posting_id <> representative").select(F.col("representative").alias("a"), F.col("representative").alias("b")).distinct()
    merged = scored_pairs(one, materialize(hard_merge_candidates(one).union(copies), "candidates")).where("outcome = 'AUTO_MERGE'").select("a", "b").union(like_merges(one))
    return class_clusters(members, merged.withColumn("outcome", F.lit("AUTO_MERGE")))


def class_clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(posting_id, cluster)`` from assessed pairs of classes (``class_pairs``, which humans may have decided)."""
    labels = components(pairs.where(F.col("outcome").isin("AUTO_MERGE", "MERGE")).select("a", "b"))
    table = members.select("representative").distinct().join(labels, F.col("representative") == F.col("node"), "left").select("representative", "label")
    return look_up(members, materialize(table, "labelled"), "representative").select("posting_id", F.coalesce("label", "posting_id").alias("cluster"))


def scored_pairs(rows: DataFrame, pairs: DataFrame, alike: bool = False) -> DataFrame:
    """``score, hard_key, barriers, outcome`` of each pair; pairs that are no candidates are dropped. With ``alike``, a
    column tells those of one employer with titles alike enough; of rows that have one, ``n`` is told of both."""
    more = ["n"] if "n" in rows.columns else []
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("posting_id")).distinct(), "asked")
    rows = beside(rows, asked, "posting_id", "left_semi", "scored")
    side = lambda s: rows.select(F.col("posting_id").alias(s), F.struct(*FEATURES, *more).alias(f"{s}_"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    a, b = (lambda f: F.col(f"a_.{f}")), (lambda f: F.col(f"b_.{f}"))
    some = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    sign = lambda f: F.when(some(a(f)) & some(b(f)), F.when(a(f) == b(f), 1).otherwise(2)).otherwise(0).cast("tinyint").alias(f)
    redirected = (some(a("redirect")) & (a("redirect") == b("url"))) | (some(b("redirect")) & (b("redirect") == a("url")))
    apart = F.size(F.array_intersect(a("location_tokens"), b("location_tokens"))) == 0
    score = lambda c: (jaccard(a(f"{c}_tokens"), b(f"{c}_tokens")) * 10000).cast("int").alias(c)
    times = [f(c).alias(n) for f, c, n in ((a, "first_seen_at", "a_seen"), (b, "first_seen_at", "b_seen"), (a, "closed_at", "a_closed"), (b, "closed_at", "b_closed"))]
    signs = both.select(*pairs.columns, score("title"), score("text"), *(sign(f) for f in SIGNS), F.coalesce(redirected, F.lit(False)).alias("redirected"), F.coalesce(apart, F.lit(False)).alias("apart"), *times, *(f("n").alias(n) for f, n in ((a, "n_a"), (b, "n_b")) if more))
    return assessed(signs, alike)


def assessed(signs: DataFrame, alike: bool = False) -> DataFrame:
    """Pairs judged by how their postings stand to each other (``tiles.like_pairs``)."""
    same, differ = (lambda f: F.col(f) == 1), (lambda f: F.col(f) == 2)
    places = lambda c: (c * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(5,4)")
    given = [c for c in signs.columns if c not in SIGNED]
    features = {"employer": F.when(same("employer"), 10000).otherwise(0), "title": F.col("title"), "location": F.when(same("location"), 10000).otherwise(0), "text": F.col("text"), "terms": F.when(same("terms"), 10000).otherwise(0), "requisition": F.when(same("requisition"), 10000).otherwise(0)}
    # Weights have two places, so the sum is in millionths; it is rounded to four places.
    total = sum((v * round(float(WEIGHTS[k]) * 100) for k, v in features.items()), F.lit(0))
    rows = signs.withColumn("score", places(F.floor((total + 50) / 100).cast("int")))
    rows = rows.withColumns({"hard_key": same("requisition") | same("url") | F.col("redirected"), "title_score": places(F.col("title")), "text_score": places(F.col("text"))})
    titled = same("employer") & (F.col("title") >= round(float(CANDIDATE_FROM) * 10000))
    rows = rows.where(F.col("hard_key") | titled)
    earlier = F.col("a_seen") <= F.col("b_seen")
    closed, again = F.when(earlier, F.col("a_closed")).otherwise(F.col("b_closed")), F.when(earlier, F.col("b_seen")).otherwise(F.col("a_seen"))
    days = seconds_between(closed, again) / 86400
    repost = same("requisition") | (days.between(0, REPOST_DAYS) & (F.col("score") >= F.lit(MERGE_FROM).cast("decimal(3,2)")))
    barriers = {
        "DISTINCT_REQUISITION_IDS": same("employer") & differ("requisition"),
        "MATERIALLY_DIFFERENT_LOCATION": differ("location") & F.col("apart"),
        "INCOMPATIBLE_EXPLICIT_EMPLOYMENT_TERMS": differ("terms"),
        "REPOST_WINDOW_EXCEEDED": closed.isNotNull() & (again > closed) & ~F.coalesce(repost, F.lit(False)),
    }
    rows = rows.withColumn("barriers", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in barriers.items()))))
    kept = [*given, "title_score", "text_score", "score", "hard_key", "barriers", outcome(F.col("score"), F.col("hard_key"), F.size("barriers") > 0).alias("outcome")]
    return rows.select(*kept, *([titled.alias("alike")] if alike else []))


def pair_fingerprints(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs with ``fingerprint``: a digest of what both postings say and of how the pair was judged. A human decision on
    a pair holds as long as this stays the same."""
    digest = rows.select("posting_id", F.sha2(F.to_json(F.struct(*FEATURES), {"ignoreNullFields": "false"}), 256).alias("_d"))
    side = lambda s: digest.select(F.col("posting_id").alias(s), F.col("_d").alias(f"_{s}"))
    judged = F.sha2(F.to_json(F.struct("_a", "_b", "score", "hard_key", "barriers", "outcome"), {"ignoreNullFields": "false"}), 256)
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("fingerprint", judged).drop("_a", "_b")


def outcome(score: Column, hard_key: Column, barred: Column) -> Column:
    """A barrier separates, a hard key merges, else the score decides."""
    at_least = lambda bound: score >= F.lit(bound).cast("decimal(5,4)")
    return first_match([(barred, "KEEP_SEPARATE"), (hard_key, "AUTO_MERGE"), (at_least(MERGE_FROM), "AUTO_MERGE"), (at_least(REVIEW_FROM), "REVIEW")], "KEEP_SEPARATE")


def with_human_decisions(pairs: DataFrame, decisions: DataFrame, as_of: Column, applications: DataFrame | None = None) -> DataFrame:
    """Pairs whose unordered ids and material fingerprint have an earlier human outcome take it; two conflict.

    Where no decision was made on the pair itself, the latest of ``applications`` counts (posting_a, posting_b as judged, fingerprint,
    human_outcome, created_at and the source decision's source_created_at, both by the cutoff): a decision that was
    carried over to the pair before. ``decided_by`` tells which (DIRECT, INHERITED, or null).
    """
    known = decisions.where(F.col("created_at") <= as_of).select(F.least("posting_a", "posting_b").alias("a"), F.greatest("posting_a", "posting_b").alias("b"), "fingerprint", "human_outcome")
    one = known.groupBy("a", "b", "fingerprint").agg(F.count("*").alias("n"), F.min("human_outcome").alias("human"))
    clash = F.when(F.col("n") > 1, F.raise_error(F.lit("conflicting prior human decisions")).cast("string")).otherwise(F.col("human"))
    joined = pairs.join(one.select("a", "b", "fingerprint", clash.alias("_direct")), ["a", "b", "fingerprint"], "left")
    if applications is None:
        joined = joined.withColumn("_inherited", F.lit(None).cast("string"))
    else:
        valid = applications.where((F.col("created_at") <= as_of) & (F.col("source_created_at") <= as_of))
        latest = valid.groupBy(F.col("posting_a").alias("a"), F.col("posting_b").alias("b"), "fingerprint").agg(F.max_by("human_outcome", F.struct("created_at", "source_created_at", "human_outcome")).alias("_inherited"))
        joined = joined.join(latest, ["a", "b", "fingerprint"], "left")
    human = F.coalesce("_direct", "_inherited")
    told = joined.withColumns({
        "human": human,
        "decided_by": F.when(F.col("_direct").isNotNull(), "DIRECT").when(F.col("_inherited").isNotNull(), "INHERITED"),
        "method": F.when(human.isNotNull(), "HUMAN").when(F.col("hard_key"), "HARD_KEY").otherwise("RULE_SCORE"),
        "outcome": F.coalesce(human, "outcome"),
    })
    return told.drop("_direct", "_inherited")


def clusters(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(posting_id, cluster)``: the transitive closure of merges; barriers elsewhere in a cluster split nothing."""
    merged = pairs.where(F.col("outcome").isin("AUTO_MERGE", "MERGE")).select("a", "b")
    label = components(merged)
    return rows.select("posting_id").join(label, rows.posting_id == label.node, "left").select("posting_id", F.coalesce("label", "posting_id").alias("cluster"))


def conflicting_reviews(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs left for review whose postings ended up in one cluster: there must be none. Of pairs of copies (a = b), which
    ended up so if the class was merged with any other."""
    side = lambda s: members.select(F.col("posting_id").alias(s), F.col("cluster").alias(f"cluster_{s}"))
    merged = pairs.where(F.col("outcome").isin("AUTO_MERGE", "MERGE")).select(F.explode(F.array("a", "b")).alias("a")).distinct()
    review = pairs.where("outcome = 'REVIEW'")
    among = review.where("a = b").join(merged, "a", "left_semi")
    apart = review.where("a <> b").join(side("a"), "a").join(side("b"), "b").where("cluster_a = cluster_b")
    return apart.unionByName(among, allowMissingColumns=True)


def cluster_key(posting_id: str) -> Column:
    """A cluster's key, an aggregate: a digest of the number of its ids and of sums of their digests' parts, so that no
    order matters and no cluster is gathered in one value."""
    digest = F.sha2(F.col(posting_id).cast("string"), 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(0), part(1)), 256)


def vacancies(rows: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each cluster: canonical posting, bounds, status and positions.

    ``rows``: posting_id, rank, first_seen_at, last_seen_at, lifecycle_state, title, text. The canonical posting has
    the least (rank, first seen, id) and alone decides the status; positions come from the least (rank, id)
    that states a number.
    """
    full = rows.withColumn("positions", position_count(F.concat_ws(" ", "title", "text"))).join(members, "posting_id")
    by = F.struct("rank", "first_seen_at", "posting_id")
    stated = F.col("positions.positions_count").isNotNull()
    number = F.min_by(F.col("positions.positions_count"), F.when(stated, F.struct("rank", "posting_id")))
    grouped = full.groupBy("cluster").agg(
        F.min_by("posting_id", by).alias("canonical_posting"),
        F.min_by("lifecycle_state", by).alias("_state"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.count("*").alias("n_postings"),
        number.alias("positions_count"),
        F.bool_or("positions.multi_hire").alias("multi_hire_possible"),
        cluster_key("posting_id").alias("vacancy_key"),
    )
    return grouped.withColumn("status", F.when(F.col("_state") == "CLOSED_OBSERVED", "CLOSED_OBSERVED").otherwise("ACTIVE")).drop("_state")


def summary(states: DataFrame) -> DataFrame:
    """One pass of counts over the vacancies."""
    kind = F.when(F.col("positions_count") > 0, "numeric").when(F.col("multi_hire_possible"), "multi").otherwise("unknown")
    return states.withColumn("_kind", kind).agg(
        F.count("*").alias("effective_vacancies"),
        F.count_if(F.col("status") == "ACTIVE").alias("active_vacancies"),
        F.count_if(F.col("status") == "CLOSED_OBSERVED").alias("closed_vacancies"),
        F.count_if(F.col("_kind") == "numeric").alias("positions_numeric"),
        F.count_if(F.col("_kind") == "multi").alias("positions_multi"),
        F.count_if(F.col("_kind") == "unknown").alias("positions_unknown"),
    )


def material_matches(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Each target with the earlier decisions of the same posting and fingerprint: none, one to apply, or a conflict.

    Of each posting and fingerprint only the first two decisions are kept (ranked in a group limit), so groups of copies
    don't multiply; ``n`` is 2 for two or more.
    """
    key = ["posting_id", "fingerprint"]
    once = sources.groupBy(*key, "decision_id").agg(F.min("decided_at").alias("decided_at"))
    ranked = once.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("decided_at", "decision_id"))).where("_r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    known = materialize(ranked.groupBy(*key).agg(pick(1, "decision_id").alias("_first"), pick(1, "decided_at").alias("_first_at"), pick(2, "decided_at").alias("_second_at")), "decisions")
    asked = materialize(targets.select("target_id", "target_at", *key), "targets")
    matched = look_up(asked, known, key)
    unmatched = asked.join(known.select(*key), key, "left_anti").withColumns({"_first": F.lit(None).cast(known.schema["_first"].dataType), "_first_at": F.lit(None).cast("timestamp"), "_second_at": F.lit(None).cast("timestamp")})
    seen = lambda c: F.coalesce(F.col(c) <= F.col("target_at"), F.lit(False)).cast("long")
    found = matched.unionByName(unmatched).withColumn("n", seen("_first_at") + seen("_second_at"))
    action = F.when(F.col("n") == 0, "UNMATCHED").when(F.col("n") == 1, "APPLY").otherwise("CONFLICT")
    return found.select("target_id", "posting_id", "n", action.alias("action"), F.when(F.col("n") == 1, F.col("_first")).alias("decision_id"))


def run_counters(pairs: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """One row of counts over assessed pairs: a pair with an earlier human decision counts as a candidate only.

    With ``n_pairs`` (``class_pairs``), a row counts for so many pairs of postings, of which ``decided`` (a, b, with the
    pairs of classes; a row for each pair of postings that a human has decided) are human.
    """
    weight = F.col("n_pairs") if "n_pairs" in pairs.columns else F.lit(1)
    barred = F.size("barriers") > 0
    told = lambda rows, own, every: rows.select("outcome", "hard_key", barred.alias("_barred"), own.cast("long").alias("_own"), every.cast("long").alias("_every"))
    if decided is not None:
        # What humans have decided is taken off again: all pairs are added up where they stand, and not joined.
        humans = decided.groupBy("a", "b").agg(F.count("*").alias("_humans"))
        counted = told(pairs, weight, weight).unionByName(told(pairs.join(humans, ["a", "b"]), -F.col("_humans"), F.lit(0)))
    else:
        own = F.when(F.col("method") == "HUMAN", 0).otherwise(weight) if "method" in pairs.columns else weight
        counted = told(pairs, own, weight)
    barred = F.col("_barred")
    merged = ~barred & (F.col("outcome") == "AUTO_MERGE")
    count = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("_own"))), F.lit(0)).cast("long").alias(name)
    return counted.agg(
        F.coalesce(F.sum("_every"), F.lit(0)).cast("long").alias("candidate_pairs"),
        count(merged & F.col("hard_key"), "hard_key_merges"),
        count(merged & ~F.col("hard_key"), "rule_auto_merges"),
        count(~barred & (F.col("outcome") == "REVIEW"), "review_pairs"),
        count(barred | (F.col("outcome") == "KEEP_SEPARATE"), "keep_separate_pairs"),
        count(barred, "hard_barrier_pairs"),
    )


def decided_classes(decided: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of postings (a, b) as pairs of their classes' representatives, a <= b, a row for each."""
    side = lambda s: members.select(F.col("posting_id").alias(s), F.col("representative").alias(f"_{s}"))
    both = decided.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def merged_identities(members: DataFrame, identities: DataFrame) -> DataFrame:
    """``(vacancy_id, winner, merged)``: of the identities that a cluster's postings had, the earliest seen wins (by
    first sight, then id) and the others are merged into it.

    ``members``: posting_id, cluster; ``identities``: posting_id, vacancy_id, first_seen_at.
    """
    owned = materialize(identities.join(members, "posting_id").groupBy("cluster", "vacancy_id").agg(F.min("first_seen_at").alias("first_seen_at")), "owned")
    winner = materialize(owned.groupBy("cluster").agg(F.min_by("vacancy_id", F.struct("first_seen_at", "vacancy_id")).alias("winner")), "winners")
    return look_up(owned, winner, "cluster").select("vacancy_id", "winner", (F.col("vacancy_id") != F.col("winner")).alias("merged"))


def resolved_reviews(reviews: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Human decisions on pending pairs, as rows to append.

    ``reviews``: review_id, a, b, fingerprint, status; ``resolutions``: review_id, merge, reason, resolved_at. A review
    that is unknown or not pending, or a resolution without a reason, is refused.
    """
    asked = resolutions.join(reviews, "review_id", "left")
    wrong = F.when(F.length(F.trim(F.coalesce("reason", F.lit("")))) == 0, "a resolution needs a reason").when(F.coalesce("status", F.lit("")) != "PENDING", "the review is not pending")
    outcome = F.when(F.col("merge"), "MERGE").otherwise("KEEP_SEPARATE")
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(outcome)
    return asked.select("review_id", F.col("a").alias("posting_a"), F.col("b").alias("posting_b"), "fingerprint", checked.alias("human_outcome"), "reason", F.col("resolved_at").alias("created_at"), F.when(F.col("merge"), "MERGED").otherwise("KEPT_SEPARATE").alias("status"))
