"""Filtering URLs: rules first, then the ratio of two character language models.

A rule names a host and the start of a path and allows or blocks; it fits its host and all of that host's subdomains. The
longest rule that fits decides. URLs that no rule fits are judged by two variable-order Markov models over bytes, one of
accepted and one of rejected URLs: the difference of their log-likelihoods, divided by the number of symbols, against a
threshold calibrated on URLs that neither model has seen.

The models learn from the URLs on which a rule decides, each distinct one once, however often it stands in the table: a
bounded sample of each verdict (``SAMPLE`` URLs of at most ``LONGEST`` bytes, chosen by a hash), four fifths for counts and
the rest for the calibration. Counts of symbols after contexts of up to ``ORDER`` bytes are smoothed by Witten and Bell's
method: a context mixes its own shares with those of the context one byte shorter, the more the fewer symbols followed
it. The calibration is a logistic curve, with both verdicts weighing the same.

Every URL is read whole, however long, in pieces of bounded size. A null URL, or one without ``://``, has an empty host
and path, fits no rule and is judged as it stands (null: as an empty text). Bytes are those of the URL as it stands, but for its host in lower
case. Where the rules decide on no URL of a verdict there is nothing to compare, and the method allows. Repeated rows are
judged alike; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.rows import annotate
from chronolith.session import materialize, prepare

#: Bytes of context, URLs of each verdict that are learned from, and their longest; rules at most.
ORDER, SAMPLE, LONGEST, MAX_RULES = 5, 20_000, 2048, 1000
#: Symbols that are not bytes: the end of a URL, and what stands before its first byte. A symbol takes 9 bits of a key.
END, BEFORE, BITS = 256, 257, 9
SYMBOLS = 257
#: Positions of a piece, and bytes of URLs that are worked on together.
PIECE, SLICE_BYTES = 1 << 17, 1 << 20
ROUNDS = 200


@dataclass(frozen=True)
class Rule:
    """What to do with URLs of a host, or of its subdomains, whose path starts so."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict}")
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A to Z in lower case, and the path; both empty where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def decide(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Of equally long ones the longer host decides, then the path
    that sorts last; of the same rule twice, block."""
    order = sorted(set(rules), key=lambda r: (len(r.text), len(r.host), r.path, r.verdict), reverse=True)
    if len(order) > MAX_RULES:
        raise ValueError(f"there are more than {MAX_RULES} rules")
    name = verdict = F
    for r in order:
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = name.when(fits, F.lit(r.text)), verdict.when(fits, F.lit(r.verdict))
    return (name.otherwise(None), verdict.otherwise(None)) if order else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, each text after ``ORDER`` times ``BEFORE`` and closed by ``END``; and where each
    text's own symbols begin."""
    sizes = np.array([len(t) for t in texts], np.int64) + ORDER + 1
    begin = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), BEFORE, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    own = sizes - ORDER - 1
    place = np.arange(len(data)) + np.repeat(begin + ORDER - (np.cumsum(own) - own), own)
    out[place] = data
    out[begin + sizes - 1] = END
    return out, begin + ORDER


def keys(line: np.ndarray, order: int) -> np.ndarray:
    """For each symbol from place ``ORDER`` on, itself and the ``order`` before it in one number."""
    n = max(len(line) - ORDER, 0)
    out = np.zeros(n, np.int64)
    for k in range(order, -1, -1):
        out = out << BITS | line[ORDER - k : ORDER - k + n]
    return out


class Markov:
    """Smoothed counts of the symbols that follow contexts of each length."""

    def __init__(self, texts: list[bytes]) -> None:
        line, begin = symbols(texts)
        own = line[ORDER:] != BEFORE
        self.tables = []
        for order in range(ORDER + 1):
            grams, counts = np.unique(keys(line, order)[own], return_counts=True)
            contexts, first = np.unique(grams >> BITS, return_index=True)
            self.tables.append((grams, counts, contexts, np.add.reduceat(counts, first) if len(first) else counts, np.diff(first, append=len(grams))))

    def log2(self, line: np.ndarray) -> np.ndarray:
        """The log2 probability of each symbol from place ``ORDER`` on (of ``BEFORE``: 0)."""
        p = np.full(len(line) - ORDER, 1 / SYMBOLS)
        for order, (grams, counts, contexts, totals, kinds) in enumerate(self.tables):
            if not len(grams):
                continue
            key = keys(line, order)
            at = np.minimum(np.searchsorted(contexts, key >> BITS), len(contexts) - 1)
            known = contexts[at] == key >> BITS
            gram = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
            n = np.where(grams[gram] == key, counts[gram], 0)
            p = np.where(known, (n + kinds[at] * p) / (totals[at] + kinds[at]), p)
        return np.where(line[ORDER:] == BEFORE, 0.0, np.log2(p))


@dataclass(frozen=True)
class Ratio:
    """Models of accepted and rejected URLs, and the curve that turns their difference into a probability."""

    accepted: Markov
    rejected: Markov
    slope: float
    offset: float

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """For each text, the difference of its log2 likelihoods by both models, by symbol, its end included."""
        line, begin = symbols(texts)
        if not len(begin):
            return np.zeros(0)
        sums = np.zeros(len(texts))
        for low in range(ORDER, len(line), PIECE):
            piece = line[low - ORDER : low + PIECE]
            found = self.accepted.log2(piece) - self.rejected.log2(piece)
            sums += np.bincount(np.searchsorted(begin, np.arange(low, low + len(found)), side="right") - 1, found, len(texts))
        return sums / (np.array([len(t) for t in texts]) + 1)

    def probability(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * differences + self.offset, -30, 30)))


def calibrated(accepted: np.ndarray, rejected: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through both sets of differences, by Newton's method with a small penalty on
    the slope; each set weighs the same."""
    x = np.concatenate([accepted, rejected])
    y = np.repeat([1.0, 0.0], [len(accepted), len(rejected)])
    w = np.repeat([0.5 / max(len(accepted), 1), 0.5 / max(len(rejected), 1)], [len(accepted), len(rejected)])
    spread = x.std() or 1.0
    a = np.stack([x / spread, np.ones(len(x))], 1)
    penalty = np.diag([1e-3, 1e-6])
    b = np.zeros(2)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (w * (y - p)) - penalty @ b)
        b = b + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / spread), float(b[1])


def learn(ruled: DataFrame) -> Ratio | None:
    """Models from ``(url, text, verdict)`` rows; None if a verdict has no URL."""
    distinct = ruled.where(F.col("verdict").isNotNull() & (F.octet_length("text") <= LONGEST)).select("text", "verdict").distinct()
    texts, checks = {}, {}
    for verdict in ("allow", "block"):
        by = F.xxhash64("text", F.lit(11))
        own = distinct.where(F.col("verdict") == verdict).orderBy(by, "text").limit(SAMPLE).select("text").toArrow().column("text").to_pylist()
        held = [t.encode() for t in own]
        cut = max(1, len(held) * 4 // 5)
        texts[verdict], checks[verdict] = held[:cut], held[cut:] or held
        if not held:
            return None
    accepted, rejected = Markov(texts["allow"]), Markov(texts["block"])
    plain = Ratio(accepted, rejected, 1.0, 0.0)
    return Ratio(accepted, rejected, *calibrated(plain.differences(checks["allow"]), plain.differences(checks["block"])))


def judge(pages: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict, score, accepted`` of every row: ``score`` is the models' difference,
    ``accepted`` the probability they give (both null where there are no models); a rule's verdict comes before theirs."""
    spark = prepare(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", url.alias("text"), host.alias("host"), path.alias("path"))
    # The host's capitals don't count, wherever they stand.
    lowered = F.when(F.length("host") > 0, F.concat(F.substring_index("text", "://", 1), F.lit("://"), "host", F.expr("substr(text, char_length(substring_index(text, '://', 1)) + 4 + char_length(host))"))).otherwise(F.col("text"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), lowered.alias("text"))
    model = learn(rows)
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), none.alias("score"), none.alias("accepted"))
    shared = spark.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = shared.value.differences([t.encode() for t in batch.column("text").to_pylist()])
        return {"score": pa.array(found), "accepted": pa.array(shared.value.probability(found))}

    judged = annotate(rows, score, "score double, accepted double", SLICE_BYTES)
    told = F.coalesce("row.verdict", F.when(F.col("accepted") >= 0.5, "allow").otherwise("block"))
    return judged.select("row.page_id", "row.host", "row.path", "row.rule", told.alias("verdict"), "score", "accepted")
