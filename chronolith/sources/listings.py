"""Paged listings and detail pages: bodies to rows, and the checks that a listing is complete.

Fetching is left to a source in front; these take pages that were fetched. What differs between platforms is data: where
in a JSON listing the items, ids, titles, URLs, total and offset stand, or which elements of an HTML page hold them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.text import mappings, norm_title, repaired
from chronolith.operators.expectations import conflicts, require_empty
from chronolith.session import materialize


@dataclass(frozen=True)
class Platform:
    """Where a platform's JSON listing keeps its parts: dotted paths, items below ``items``. With ``only``, items count
    for which that path holds one of ``values`` (an open state, say)."""

    items: str
    posting_id: str
    url: str
    title: str
    total: str = ""
    offset: str = ""
    only: str = ""
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Spot:
    """An element of an HTML page, by tag and one attribute's word or value (a last ``*`` stands for any ending), and
    what is taken from it: its text or an attribute, or the first group of a pattern in that."""

    tag: str
    attribute: str = ""
    value: str = ""
    take: str = ""
    pattern: str = ""


@dataclass(frozen=True)
class HtmlPlatform:
    """Which elements of an HTML listing hold its rows and, in each, id, URL and title; and which holds the page's state,
    JSON with the numbers under ``state_keys``: current page, first and last place, total."""

    row: Spot
    posting_id: Spot
    url: Spot
    title: Spot
    state: Spot | None = None
    state_keys: dict[str, str] = field(default_factory=dict)
    total: Spot | None = None


def at(value: object, path: str) -> object:
    """The value under a dotted path, or None."""
    for part in path.split(".") if path else []:
        value = value.get(part) if isinstance(value, dict) else value[int(part)] if isinstance(value, list) and part.isdigit() and int(part) < len(value) else None
    return value


_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})


class Elements(HTMLParser):
    """The elements of a page in order: tag, attributes, text, and the place after their last descendant."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open: list[int] = []
        self.feed(html)
        self.close()
        for place in self.open:
            self.found[place][3] = len(self.found)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found.append([tag, dict(attrs), [], len(self.found) + 1])
        if tag not in _VOID:
            self.open.append(len(self.found) - 1)

    def handle_endtag(self, tag: str) -> None:
        depth = next((d for d in range(len(self.open) - 1, -1, -1) if self.found[self.open[d]][0] == tag), None)
        if depth is not None:
            for place in self.open[depth:]:
                self.found[place][3] = len(self.found)
            del self.open[depth:]

    def handle_data(self, data: str) -> None:
        for place in self.open:
            self.found[place][2].append(data)

    def places(self, spot: Spot, low: int = 0, high: int | None = None) -> Iterator[int]:
        fits = (lambda v: v.startswith(spot.value[:-1])) if spot.value.endswith("*") else (lambda v: v == spot.value)
        for place in range(low, len(self.found) if high is None else high):
            tag, attrs, *_ = self.found[place]
            said = attrs.get(spot.attribute) or ""
            if tag == spot.tag and (not spot.attribute or fits(said) or any(map(fits, said.split()))):
                yield place

    def take(self, spot: Spot, low: int = 0, high: int | None = None) -> str | None:
        """What the first fitting element gives, or None."""
        for place in self.places(spot, low, high):
            _, attrs, text, _ = self.found[place]
            said = " ".join((attrs.get(spot.take) or "" if spot.take else "".join(text)).split())
            if spot.pattern:
                found = re.search(spot.pattern, said)
                said = found[1] if found else ""
            if said:
                return said
        return None


def _whole(value: object, what: str) -> int | None:
    if value is None or value == "":
        return None
    if isinstance(value, bool) or not re.fullmatch(r"\d+", str(value)):
        raise ValueError(f"{what} is no whole number")
    return int(value)


NUMBERS = ("total", "offset", "page", "first", "last")


def _read(body: str, url: str, platform: Platform | HtmlPlatform | None) -> tuple[list[tuple[str, str, str]], dict]:
    """``(id, URL, title)`` of a page's entries, and the numbers that the page states about itself."""
    if platform is None:
        page = Elements(body)
        spots = [(page.found[k][1].get("href"), " ".join("".join(page.found[k][2]).split())) for k in page.places(Spot("a"))]
        return [(urljoin(url, href), urljoin(url, href), text) for href, text in spots if href], {}
    if isinstance(platform, HtmlPlatform):
        page, entries = Elements(body), []
        for place in page.places(platform.row):
            own = [page.take(spot, place, page.found[place][3]) for spot in (platform.posting_id, platform.url, platform.title)]
            if not all(own):
                raise ValueError("an entry lacks its id, URL or title")
            entries.append((own[0], urljoin(url, own[1]), own[2]))
        said = page.take(platform.state) if platform.state else None
        state = json.loads(said) if said else {}
        numbers = {name: _whole(at(state, path), name) for name, path in platform.state_keys.items()}
        return entries, numbers | ({"total": _whole(page.take(platform.total), "total")} if platform.total else {})
    page = json.loads(body)
    items = at(page, platform.items)
    if not isinstance(items, list):
        raise ValueError("no list of items")
    items = [i for i in items if not platform.only or str(at(i, platform.only)) in platform.values]
    entries = [(str(at(i, platform.posting_id) or ""), urljoin(url, str(at(i, platform.url) or "")), str(at(i, platform.title) or "")) for i in items]
    return entries, {name: _whole(at(page, path), name) for name, path in (("total", platform.total), ("offset", platform.offset)) if path}


def parse_listings(pages: DataFrame, platforms: dict[str, Platform | HtmlPlatform | None], blocked: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Entries and page facts of fetched pages (``source_id, surface, ordinal, url, body``), parsed once.

    ``platforms`` names each source's platform; None is an HTML page of links. A body that cannot be read gives a page
    with an error and no entry, as does a source without a platform or one that is ``blocked``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch.itertuples(index=False):
                entries, numbers, error = [], {}, None
                try:
                    if page.source_id in blocked or page.source_id not in platforms:
                        raise ValueError(f"source {page.source_id} is {'blocked' if page.source_id in blocked else 'unknown'}")
                    entries, numbers = _read(page.body or "", page.url or "", platforms[page.source_id])
                except (ValueError, KeyError) as broken:
                    error = str(broken)[:200]
                rows.append((page.source_id, page.surface, page.ordinal, *(numbers.get(n) for n in NUMBERS), error, [{"source_posting_id": i, "url": u, "title": t} for i, u, t in entries]))
            yield pd.DataFrame(rows, columns=["source_id", "surface", "ordinal", *NUMBERS, "error", "entries"]).astype({n: "Int32" for n in NUMBERS})

    schema = "source_id string, surface string, ordinal int, " + ", ".join(f"{n} int" for n in NUMBERS) + ", error string, entries array<struct<source_posting_id:string,url:string,title:string>>"
    parsed = materialize(pages.select("source_id", "surface", "ordinal", "url", "body").mapInPandas(run, schema), "listings")
    facts = parsed.select("source_id", "surface", "ordinal", *NUMBERS, F.size("entries").alias("n_entries"), "error")
    return parsed.select("source_id", "surface", "ordinal", F.inline("entries")), facts


def page_breaks(facts: DataFrame) -> DataFrame:
    """Pages whose own arithmetic is broken: the page number does not go on from the one before, the first place not from
    the last place before, the places are not as many as the entries, the total changes, or the last page ends elsewhere."""
    by = Window.partitionBy("source_id", "surface").orderBy("ordinal")
    before = lambda c: F.lag(c).over(by)
    is_last = F.row_number().over(Window.partitionBy("source_id", "surface").orderBy(F.desc("ordinal"))) == 1
    reason = (
        F.when(F.col("page") != F.coalesce(before("page") + 1, F.lit(1)), "PAGE_NUMBER")
        .when(F.col("first") != F.coalesce(before("last") + 1, F.when(F.col("total") == 0, 0).otherwise(1)), "FIRST_PLACE")
        .when((F.col("total") > 0) & (F.col("last") - F.col("first") + 1 != F.col("n_entries")), "PLACES")
        .when(F.col("total") != before("total"), "UNSTABLE_TOTAL")
        .when(is_last & (F.col("last") != F.col("total")), "LAST_PLACE")
    )
    return facts.select("source_id", "surface", "ordinal", reason.alias("reason")).where("reason IS NOT NULL")


def lost_entries(entries: DataFrame) -> DataFrame:
    """For pages that repeat all before them: entries of a page that the next page lacks. There must be none; the last
    page then is the listing."""
    keys = ["source_id", "surface", "source_posting_id"]
    pages = entries.select("source_id", "surface", "ordinal").distinct()
    following = pages.select("source_id", "surface", "ordinal", F.lead("ordinal").over(Window.partitionBy("source_id", "surface").orderBy("ordinal")).alias("next")).where("next IS NOT NULL")
    due = entries.join(following, ["source_id", "surface", "ordinal"]).select(*keys, F.col("next").alias("ordinal"))
    return due.join(entries.select(*keys, "ordinal"), [*keys, "ordinal"], "left_anti")


def last_page(entries: DataFrame) -> DataFrame:
    """The entries of each surface's last page."""
    last = entries.groupBy("source_id", "surface").agg(F.max("ordinal").alias("ordinal"))
    return entries.join(last, ["source_id", "surface", "ordinal"], "left_semi")


def completeness(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """For each source and surface: is the listing complete, and if not, why.

    Pages must be readable and without gaps in their ordinals, totals must agree, each offset must continue where
    the page before ended, and a reported total (nought counts as none) must equal the distinct entries. A source
    may be empty.
    """
    ids = entries.groupBy("source_id", "surface").agg(F.count_distinct("source_posting_id").alias("n"))
    grouped = facts.groupBy("source_id", "surface").agg(
        F.count("error").alias("errors"),
        (F.max("ordinal") - F.min("ordinal") + 1 != F.count_distinct("ordinal")).alias("gaps"),
        F.count_distinct(F.nullif("total", F.lit(0))).alias("totals"),
        F.max(F.nullif("total", F.lit(0))).alias("total"),
    )
    so_far = F.sum("n_entries").over(Window.partitionBy("source_id", "surface").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    jumps = facts.withColumn("_expected", F.coalesce(so_far, F.lit(0))).groupBy("source_id", "surface").agg(F.count_if(F.col("offset") != F.col("_expected")).alias("jumps"))
    rows = grouped.join(jumps, ["source_id", "surface"]).join(ids, ["source_id", "surface"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = (
        F.when(F.col("errors") > 0, "UNREADABLE_PAGE")
        .when(F.col("gaps"), "MISSING_PAGE")
        .when(F.col("totals") > 1, "UNSTABLE_TOTAL")
        .when(F.col("jumps") > 0, "OFFSET_MISMATCH")
        .when(F.col("total") != F.col("n"), "TOTAL_MISMATCH")
    )
    return rows.select("source_id", "surface", "n", "total", reason.alias("reason"), reason.isNull().alias("complete"))


def union_surfaces(entries: DataFrame) -> DataFrame:
    """One entry for each posting of a source over all its surfaces, the first by surface and page; one id under two URLs
    is refused."""
    require_empty(conflicts(entries.withColumn("_id", F.concat_ws("|", "source_id", "source_posting_id")), "_id", "url"), "an id has several URLs")
    first = F.min_by(F.struct(*entries.columns), F.struct("surface", "ordinal", "title")).alias("_first")
    return entries.groupBy("source_id", "source_posting_id").agg(first).select("_first.*")


def subtract_surface(every: DataFrame, external: DataFrame) -> DataFrame:
    """Entries of one surface that are not on another, which must be part of it."""
    keys = ["source_id", "source_posting_id"]
    require_empty(external.join(every, keys, "left_anti"), "a surface is no part of the whole")
    return every.join(external, keys, "left_anti")


def index_join(index: DataFrame, mirrors: DataFrame) -> DataFrame:
    """Index entries with the listing that mirrors each; a missing mirror is refused."""
    joined = index.join(mirrors, ["source_id", "source_posting_id"], "left")
    require_empty(joined.where("mirror_url IS NULL"), "an index entry has no mirror")
    return joined


def find_posting(payload: object) -> dict | None:
    """The first ``JobPosting`` anywhere in linked data."""
    named = lambda kind: "JobPosting" in (kind if isinstance(kind, list) else [kind])
    return next((m for m in mappings(payload) if named(m.get("@type"))), None)


DETAIL_FIELDS = ("title", "employer", "description", "date_posted", "valid_through", "locality", "region", "postal_code", "country")
DETAIL = "source_id string, url string, " + ", ".join(f"{c} string" for c in DETAIL_FIELDS) + ", canonical string, repaired boolean, error string"
_LINKED, _CANONICAL = Spot("script", "type", "application/ld+json"), Spot("link", "rel", "canonical", "href")


def _stated(posting: dict) -> tuple[object, ...]:
    """The detail fields of a ``JobPosting``."""
    places = posting.get("jobLocation")
    place = next(iter(places), None) if isinstance(places, list) else places
    address = at(place, "address")
    employer = posting.get("hiringOrganization")
    where = (at(address, k) for k in ("addressLocality", "addressRegion", "postalCode", "addressCountry"))
    return posting.get("title"), at(employer, "name") if isinstance(employer, dict) else employer, *(posting.get(k) for k in ("description", "datePosted", "validThrough")), *where


def parse_details(pages: DataFrame, spots: dict[str, dict[str, Spot]] | None = None) -> DataFrame:
    """The posting that each detail page (``source_id, url, body``) states, or an error.

    A source named in ``spots`` states its fields in the elements given there; all others as linked data, of which bare
    quotes in a description are repaired.
    """
    given = spots or {}

    def text(value: object) -> str:
        return str(value or "").strip() if isinstance(value, (str, int, float)) else ""

    def linked(page: Elements) -> tuple[tuple | None, bool]:
        mended = False
        for place in page.places(_LINKED):
            body = "".join(page.found[place][2])
            try:
                posting = find_posting(json.loads(repaired(body)))
            except ValueError:
                continue
            mended |= body != repaired(body)
            if posting is not None:
                return _stated(posting), mended
        return None, mended

    def read(source: str, url: str, body: str) -> tuple:
        page = Elements(body or "")
        canonical = urljoin(url or "", page.take(_CANONICAL) or "")
        if source in given:
            found, mended = tuple(page.take(given[source][c]) if c in given[source] else "" for c in DETAIL_FIELDS), False
        else:
            found, mended = linked(page)
        if found is None:
            return (source, url, *[""] * len(DETAIL_FIELDS), canonical, mended, "NO_JOB_POSTING")
        return (source, url, *map(text, found), canonical, mended, None if text(found[0]) else "NO_TITLE")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([read(*row) for row in batch[["source_id", "url", "body"]].itertuples(index=False)], columns=[c.split()[0] for c in DETAIL.split(", ")])

    return pages.select("source_id", "url", "body").mapInPandas(run, DETAIL)


def inconsistent(details: DataFrame, entries: DataFrame) -> DataFrame:
    """Details whose title is not the listing's, quotation marks and case aside, or whose canonical URL is on another
    host: ``source_id, url, reason``."""
    listed = entries.select("source_id", "url", F.col("title").alias("_listed")).distinct()
    host = lambda c: F.lower(F.try_parse_url(c, F.lit("HOST")))
    title = norm_title(F.col("title")) != norm_title(F.col("_listed"))
    reason: Column = F.when(title, "TITLE_MISMATCH").when((F.length("canonical") > 0) & ~host(F.col("canonical")).eqNullSafe(host(F.col("url"))), "HOST_MISMATCH")
    return details.where("error IS NULL").join(listed, ["source_id", "url"]).select("source_id", "url", reason.alias("reason")).where("reason IS NOT NULL")


#: Words by which a document announces a vacancy; fixed values.
VACANCY_WORDS = ("stellenausschreibung", "stelleninserat", "wir suchen", "pensum", "bewerbung")


def announces_vacancy(text: Column, least: int = 2) -> Column:
    """Whether a document's text (normalized) announces a vacancy: with at least so many of the words that say so."""
    return F.size(F.filter(F.array(*map(F.lit, VACANCY_WORDS)), lambda w: F.contains(text, w))) >= least
