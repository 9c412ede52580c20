"""Main-text extraction with a tree-structured graphical model over the DOM.

Every element and every run of text is a node with a hidden label, content or not. Nodes have potentials from
their tag, the words of their class, id and role, and the shape of their text; parent and child are joined by
learned potentials. Sum-product messages, upward and then downward, give each node's content marginal; runs of
text with a marginal of one half or more are the main text.

The potentials are trained by maximum likelihood on labelled pages. No labelled page is given with the data, so
``labelled_pages`` writes ``TRAINING_PAGES`` of them in many layouts (semantic tags or named divisions, with menus,
banners, adverts, forms, sidebars, comments and footers around an article); the number is the training bound.

Up to 256 pages are inferred together, level by level; the work grows with nodes and levels, so deep nesting is no trap.

Edge cases: null or empty html has an empty text; markup may be broken or cut off; scripts, styles, templates and
comments are never text; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronolith.session import prepare

TRAINING_PAGES = 400
FEATURES = 1 << 13
TEXT = "#text"

#: Elements without content, elements whose content is never text, elements that begin a block. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe object svg canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: A start tag of the first kind ends an open element of the second, up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ENDS_PARAGRAPH = BLOCK - {"option", "optgroup", "tbody", "td", "th", "tr", "thead", "tfoot", "caption", "legend", "title", "head", "body", "html"}
PARAGRAPH_SCOPE = frozenset({"td", "th", "table", "caption", "button", "html"})


class Tree(HTMLParser):
    """A page's nodes in document order, tolerant of broken markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.marks, self.parents, self.blocks, self.texts = ["#page"], [""], [0], [0], [""]
        self.open, self.names = [0], ["#page"]
        self.places: dict[str, list[int]] = {}  # of each open name, its places in the stack
        self.block = 0
        self.silent = ""

    def node(self, tag: str, mark: str, text: str = "") -> int:
        self.tags.append(tag)
        self.marks.append(mark)
        self.parents.append(self.open[-1])
        self.blocks.append(self.block)
        self.texts.append(text)
        return len(self.tags) - 1

    def close_to(self, place: int) -> None:
        if any(n in BLOCK for n in self.names[place:]):
            self.block += 1
        for name in self.names[place:]:
            self.places[name].pop()
        del self.open[place:], self.names[place:]

    def nearest(self, wanted: frozenset | set, barrier: frozenset | set) -> int:
        """The last open element that is wanted, or 0 if there is none or a barrier stands after it."""
        if self.names[-1] in wanted and len(self.names) > 1:
            return len(self.names) - 1
        if not any(self.places.get(n) for n in wanted):
            return 0
        last = lambda names: max((self.places[n][-1] for n in names if self.places.get(n)), default=0)
        place = last(wanted)
        return place if place and place >= last(barrier) else 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            return
        if tag in ENDS_PARAGRAPH and (place := self.nearest({"p"}, PARAGRAPH_SCOPE)):
            self.close_to(place)
        if tag in IMPLIED and (place := self.nearest(*IMPLIED[tag])):
            self.close_to(place)
        if tag in BLOCK:
            self.block += 1
        mark = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
        if tag == "br":
            self.node(TEXT, "", " ")
        elif tag in VOID:
            return
        elif tag in SILENT:
            self.silent = tag
        else:
            self.open.append(self.node(tag, mark))
            self.places.setdefault(tag, []).append(len(self.names))
            self.names.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.silent = ""

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent:
                self.silent = ""
            return
        if place := self.nearest({tag}, set() if tag in BLOCK else BLOCK):
            self.close_to(place)

    def handle_data(self, data: str) -> None:
        if not self.silent and data:
            self.node(TEXT, "", data)


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree


def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


@lru_cache(1 << 16)
def _mark_features(tag: str, above: str, mark: str) -> tuple[int, ...]:
    """Features of a tag, of it below its parent's, and of the words of its class, id and role."""
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", mark).lower())
    return tuple(dict.fromkeys([_feature(f"tag {tag}"), _feature(f"tag {above} {tag}"), *(_feature(f"word {w}") for w in words)]))


def add_to(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add values at places that may repeat: by counting where they are many, one by one where they are few, so that a
    level never costs more than its nodes."""
    if 16 * len(at) > len(total):
        total += np.bincount(at, values, len(total))
    else:
        np.add.at(total, at, values)


class Forest:
    """The nodes of several pages, with features; parents come before children."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.tags) for t in trees]
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        base = np.repeat(self.first[:-1], sizes)
        self.parent = np.array([p for t in trees for p in t.parents], np.int64) + base
        self.root = np.zeros(len(base), bool)
        self.root[self.first[:-1]] = True
        self.is_text = np.array([tag == TEXT for t in trees for tag in t.tags], bool)
        depth = [0] * len(base)
        parents = self.parent.tolist()
        roots = self.root.tolist()
        for k, p in enumerate(parents):
            if not roots[k]:
                depth[k] = depth[p] + 1
        self.depth = np.array(depth, np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, (self.depth.max() if len(depth) else 0) + 2))
        self.levels = np.split(order, cuts[:-1]) if len(order) else []
        self._features(trees)

    def _features(self, trees: list[Tree]) -> None:
        lengths = np.array([len(x.strip()) for t in trees for x in t.texts], np.float64)
        words = np.array([x.count(" ") + 1 if x else 0 for t in trees for x in t.texts], np.float64)
        in_link = np.zeros(len(lengths), bool)
        is_link = np.array([tag == "a" for t in trees for tag in t.tags], bool)
        for level in self.levels[1:]:
            in_link[level] = in_link[self.parent[level]] | is_link[level]
        linked = lengths * in_link
        total, link = lengths.copy(), linked.copy()
        for level in reversed(self.levels[1:]):
            add_to(total, self.parent[level], total[level])
            add_to(link, self.parent[level], link[level])
        share = link / np.maximum(total, 1)
        size_bin = np.minimum(np.log2(total + 1).astype(int), 12)
        word_bin = np.minimum(np.log2(words + 1).astype(int), 8)
        link_bin = (share * 4).astype(int)
        size_id, word_id, link_id = (np.array([[_feature(f"{n} {kind} {k}") for k in range(14)] for kind in ("text", "element")]) for n in ("size", "words", "links"))
        kind = (~self.is_text).astype(int)
        shaped = np.stack((size_id[kind, size_bin], word_id[kind, word_bin], link_id[kind, link_bin]), 1)
        marks = [_mark_features(tag, t.tags[above], mark) for t in trees for tag, above, mark in zip(t.tags, t.parents, t.marks, strict=True)]
        counts = np.fromiter(map(len, marks), np.int64, len(marks)) + 3
        self.node = np.repeat(np.arange(len(marks)), counts)
        ends = np.cumsum(counts)
        self.feature = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for k in range(3):
            self.feature[ends - 3 + k] = shaped[:, k]
        rest = np.ones(len(self.feature), bool)
        rest[(ends[:, None] - np.arange(1, 4)).ravel()] = False
        self.feature[rest] = [f for m in marks for f in m]

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's content marginal, and its joint marginal with its parent (parent label, own label).

        ``edges``: log potentials by kind of child (element, text), parent's label, child's label.
        """
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.node, weights[self.feature], n)
        pair = edges[self.is_text.astype(int)]
        up, belief = np.zeros((n, 2)), own.copy()
        for level in reversed(self.levels[1:]):
            up[level] = np.logaddexp.reduce(pair[level] + belief[level][:, None, :], axis=2)
            for label in (0, 1):
                add_to(belief[:, label], self.parent[level], up[level, label])
        full = belief.copy()
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            outside = full[self.parent[level]] - up[level]
            both = outside[:, :, None] + pair[level] + belief[level][:, None, :]
            both -= np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None]
            joint[level] = np.exp(both)
            full[level] = np.logaddexp.reduce(both, axis=1)
        top = self.levels[0] if self.levels else np.zeros(0, int)
        full[top] -= np.logaddexp.reduce(full[top], axis=1)[:, None]
        return np.exp(full[:, 1]), joint


def train(pages: list[tuple[str, list[bool]]], rounds: int = 200, rate: float = 0.08) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge potentials from pages whose runs of text are labelled, in page order.

    An element is content if most of the text below it is; the page itself, and what holds it whole, never is.
    """
    trees = [parse(html) for html, _ in pages]
    forest = Forest(trees)
    label = np.zeros(len(forest.parent), bool)
    for k, (tree, (_, marked)) in enumerate(zip(trees, pages, strict=True)):
        at = [i for i, (tag, text) in enumerate(zip(tree.tags, tree.texts, strict=True)) if tag == TEXT and text.strip()]
        if len(at) != len(marked):
            raise ValueError(f"page {k} has {len(at)} runs of text and {len(marked)} labels")
        label[forest.first[k] + np.array(at, int)] = marked
    texts = np.array([bool(x.strip()) for t in trees for x in t.texts])
    size = np.array([len(x.strip()) for t in trees for x in t.texts], float)
    full, good = size.copy(), size * label
    for level in reversed(forest.levels[1:]):
        add_to(full, forest.parent[level], full[level])
        add_to(good, forest.parent[level], good[level])
    whole = np.array([tag in ("#page", "html", "body") for t in trees for tag in t.tags], bool)
    label = np.where(forest.is_text, label, (full > 0) & (good >= full / 2) & ~whole)
    blank = forest.is_text & ~texts  # white space has its parent's label
    label[blank] = label[forest.parent[blank]]
    weights, edges = np.zeros(FEATURES), np.zeros((2, 2, 2))
    square, square_e = np.zeros_like(weights), np.zeros_like(edges)
    kind, inner = forest.is_text.astype(int), ~forest.root
    seen = np.zeros_like(edges)
    np.add.at(seen, (kind[inner], label[forest.parent[inner]].astype(int), label[inner].astype(int)), 1)
    mean, mean_e = np.zeros_like(weights), np.zeros_like(edges)
    for t in range(1, rounds + 1):
        belief, joint = forest.marginals(weights, edges)
        gradient = np.bincount(forest.feature, (label - belief)[forest.node], FEATURES) / len(pages) - 3e-5 * weights
        expected = np.stack([joint[inner & (kind == k)].sum(0) for k in (0, 1)])
        step = (seen - expected) / len(pages) - 3e-5 * edges
        for value, slope, first, second in ((weights, gradient, mean, square), (edges, step, mean_e, square_e)):
            first += 0.1 * (slope - first)
            second += 0.001 * (slope**2 - second)
            value += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return weights, edges


def main_texts(pages: list[str], weights: np.ndarray, edges: np.ndarray) -> list[str]:
    """The main text of each page."""
    trees = [parse(html) for html in pages]
    forest = Forest(trees)
    if not trees:
        return []
    kept = forest.marginals(weights, edges)[0] >= 0.5
    out = []
    for k, tree in enumerate(trees):
        blocks: dict[int, list[str]] = {}
        for i in np.flatnonzero(kept[forest.first[k] : forest.first[k + 1]] & forest.is_text[forest.first[k] : forest.first[k + 1]]).tolist():
            blocks.setdefault(tree.blocks[i], []).append(tree.texts[i])
        found = (" ".join("".join(parts).split()) for parts in blocks.values())
        out.append(" ".join(x for x in found if x))
    return out


def extract(pages: DataFrame, weights: np.ndarray, edges: np.ndarray) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast((weights, edges))  # FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = main_texts([x or "" for x in part.column("html").to_pylist()], *shared.value)
                sizes = pa.array(map(len, texts), pa.int64())
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars long")


class _Writer:
    """Writes one labelled page: markup, and a label for every run of text that is not white space."""

    def __init__(self, chance: random.Random):
        self.chance, self.out, self.labels = chance, [], []
        alphabet = chance.choice(["etaoinshrdlu", "enisratdhuläöü", "esaitnrulodcéèçà", "aeosrnidlctñóí", "оеаинтсрвлк", "的一是不了人我在有他"])
        self.vocabulary = ["".join(chance.choice(alphabet) for _ in range(chance.randint(1, 9))) for _ in range(80)]
        self.separate, self.in_text = chance.random() < 0.5, False

    def words(self, low: int, high: int) -> str:
        found = [self.chance.choice(self.vocabulary) for _ in range(self.chance.randint(low, high))]
        if self.chance.random() < 0.1:
            found = [w.upper() + "!!" for w in found]
        return " ".join(found).capitalize()

    def raw(self, markup: str) -> None:
        if not markup:
            return
        self.in_text = False
        self.out.append(markup)
        if self.separate and markup[-1:] == ">" and self.chance.random() < 0.5:
            self.out.append("\n")

    def text(self, text: str, content: bool) -> None:
        if self.in_text:  # goes on with the run before it
            self.out.append(" " + escape(text))
            return
        self.in_text = True
        self.out.append(escape(text))
        self.labels.append(content)


def _element(w: _Writer, tag: str, name: str = "") -> tuple[str, str]:
    attribute = f' {w.chance.choice(["class", "id", "class"])}="{name}"' if name else ""
    return f"<{tag}{attribute}>", f"</{tag}>"


def _container(w: _Writer, semantic: list[str], names: list[str]) -> tuple[str, str]:
    """A container of one kind: by its tag, or a division or section named after it, or both."""
    kind = w.chance.random()
    name = w.chance.choice(names) + w.chance.choice(["", "", "-inner", "-box", "_wrap", " clearfix", "-1"])
    if semantic and kind < 0.5:
        return _element(w, w.chance.choice(semantic))
    if semantic and kind < 0.7:
        return _element(w, w.chance.choice(semantic), name)
    return _element(w, w.chance.choice(["div", "div", "section", "aside" if "aside" in semantic else "div"]), name)


def _links(w: _Writer, low: int, high: int) -> None:
    listed = w.chance.random() < 0.8
    w.raw("<ul>" if listed else "<div>")
    for _ in range(w.chance.randint(low, high)):
        w.raw('<li><a href="/x">' if listed else '<a href="/x">')
        w.text(w.words(1, 3), False)
        w.raw("</a></li>" if listed else "</a> ")
    w.raw("</ul>" if listed else "</div>")


def _plain(w: _Writer, low: int, high: int, content: bool) -> None:
    tag = w.chance.choice(["", "p", "p", "div", "span"])
    w.raw(f"<{tag}>" if tag else "")
    w.text(w.words(low, high), content)
    w.raw(f"</{tag}>" if tag else "")


def _form(w: _Writer) -> None:
    w.raw('<form action="/s">')
    w.raw("<label>")
    w.text(w.words(1, 4), False)
    w.raw('</label><input type="text" name="q">')
    if w.chance.random() < 0.5:
        w.raw("<select><option>")
        w.text(w.words(1, 2), False)
        w.raw("<option>")
        w.text(w.words(1, 2), False)
        w.raw("</select>")
    if w.chance.random() < 0.4:
        w.raw("<textarea>")
        w.text(w.words(1, 6), False)
        w.raw("</textarea>")
    w.raw("<button>")
    w.text(w.words(1, 2), False)
    w.raw("</button></form>")


def _aside(w: _Writer, kind: str) -> None:
    """One thing around the article."""
    if kind == "script":
        w.raw('<script>var t="</p>";go();</script><!-- note --><style>p{margin:0}</style>')
        return
    if kind == "form":
        _form(w)
        return
    semantic, names = {
        "menu": (["nav"], ["nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "navigation"]),
        "header": (["header"], ["header", "site-header", "masthead", "top", "topbar", "branding", "page-header"]),
        "footer": (["footer"], ["footer", "site-footer", "copyright", "colophon", "bottom", "legal"]),
        "sidebar": (["aside"], ["sidebar", "related", "widget", "side", "recommended", "popular", "newsletter", "share", "social", "tags"]),
        "notice": ([], ["cookie", "notice", "banner", "cookie-consent", "consent", "gdpr", "alert", "popup", "modal", "subscribe"]),
        "advert": ([], ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "adsbygoogle", "promotion"]),
        "comments": ([], ["comments", "comment", "comment-list", "discussion", "responses", "disqus", "replies", "reader-comments"]),
    }[kind]
    start, end = _container(w, semantic, names)
    w.raw(start)
    if kind == "menu":
        _links(w, 2, 8)
    elif kind == "comments":
        if w.chance.random() < 0.6:
            w.raw("<h3>")
            w.text(w.words(1, 3), False)
            w.raw("</h3>")
        for _ in range(w.chance.randint(1, 5)):
            a, b = w.chance.choice([("<div class=\"comment\">", "</div>"), ("<li>", "</li>"), ("<article class=\"comment\">", "</article>"), ("<div>", "</div>")])
            w.raw(a)
            for _ in range(w.chance.randint(1, 3)):
                _plain(w, 2, 40, False)
            w.raw(b)
        if w.chance.random() < 0.4:
            _form(w)
    else:
        for _ in range(w.chance.randint(1, 3)):
            roll = w.chance.random()
            if roll < 0.3:
                _links(w, 1, 5)
            elif roll < 0.4 and kind in ("header", "sidebar", "notice"):
                _form(w)
            elif roll < 0.55:
                w.raw("<h2>" if kind != "header" else "<h1>")
                w.text(w.words(1, 5), False)
                w.raw("</h2>" if kind != "header" else "</h1>")
            else:
                _plain(w, 1, 45 if kind != "footer" else 20, False)
    w.raw(end)


def _article(w: _Writer) -> None:
    semantic = w.chance.random()
    if semantic < 0.75:
        start, end = _element(w, "article", w.chance.choice(["", "", "", "post", "entry", "story", "article", "hentry"]))
    elif semantic < 0.82:
        start, end = _element(w, "main", w.chance.choice(["", "content"]))
    else:
        start, end = _element(w, w.chance.choice(["div", "section"]), w.chance.choice(["content", "article", "post", "entry-content", "post-content", "article-body", "main-content", "story-body", "text"]))
    w.raw(start)
    if w.chance.random() < 0.12:  # hardly any text
        w.raw("<p>")
        w.text(w.words(1, 4), True)
        w.raw("</p>" + end)
        return
    if w.chance.random() < 0.75:
        h = w.chance.choice(["h1", "h1", "h2"])
        w.raw(f"<{h}>")
        w.text(w.words(1, 12), True)
        w.raw(f"</{h}>")
    for _ in range(w.chance.choice([1, 1, 2, 3, 4, 8])):
        roll = w.chance.random()
        if roll < 0.55:
            w.raw("<p>")
            w.text(w.words(1, w.chance.choice([6, 40, 150])), True)
            w.raw(w.chance.choice(["</p>", "</p>", ""]))
        elif roll < 0.68:
            w.raw("<p>")
            if w.chance.random() < 0.5:
                w.text(w.words(1, 20) + " ", True)
            tag = w.chance.choice(["b", "i", "em", "strong", "span", 'a href="/y"', "code"])
            w.raw(f"<{tag}>")
            w.text(w.words(1, 20), True)
            if w.chance.random() < 0.3:
                w.raw("<br>")
            else:
                w.raw(f"</{tag.split()[0]}>")
                if w.chance.random() < 0.7:
                    w.text(" " + w.words(1, 20), True)
                w.raw("</p>")
        elif roll < 0.76:
            tag = w.chance.choice(["ul", "ol"])
            w.raw(f"<{tag}>")
            for _ in range(w.chance.randint(1, 5)):
                w.raw("<li>")
                w.text(w.words(1, 20), True)
                w.raw(w.chance.choice(["</li>", ""]))
            w.raw(f"</{tag}>")
        elif roll < 0.82:
            tag = w.chance.choice(["blockquote", "pre", "h2", "h3", "div", "section", "figcaption"])
            w.raw(f"<{tag}>")
            w.text(w.words(1, 30), True)
            w.raw(f"</{tag}>")
        elif roll < 0.88:
            w.raw("<table><tr><td>")
            w.text(w.words(1, 6), True)
            w.raw("</td><td>")
            w.text(w.words(1, 6), True)
            w.raw("</td></tr></table>")
        elif roll < 0.92:
            _aside(w, w.chance.choice(["advert", "sidebar", "form", "notice", "script", "comments", "menu"]))
        else:
            w.raw("<p>")
            w.text(w.words(20, 90), True)
            w.raw("</p>")
    w.raw(end)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 20) -> list[tuple[str, list[bool]]]:
    """Pages in many layouts, each with a label for every run of text: is it main text."""
    pages = []
    for number in range(count):
        w = _Writer(random.Random(seed * 100_003 + number))
        chance = w.chance
        if chance.random() < 0.2:  # a fragment without a head
            _article(w)
            pages.append(("".join(w.out), w.labels))
            continue
        w.raw('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>')
        w.text(w.words(2, 12), False)
        w.raw("</title>" + chance.choice(["", "<style>p{margin:0}</style>", '<script>var t="</p>";</script>']) + "</head><body>")
        before = [k for k in ("header", "menu", "notice", "script", "advert", "sidebar", "form") if chance.random() < 0.5]
        after = [k for k in ("sidebar", "advert", "comments", "form", "script", "notice", "footer") if chance.random() < 0.5]
        chance.shuffle(before)
        wrap = chance.choice(["", "", "main", "div", 'div class="container"', 'div id="page"', 'div class="wrapper"'])
        inner = chance.random() < 0.5
        for kind in before if inner else []:
            _aside(w, kind)
        w.raw(f"<{wrap}>" if wrap else "")
        for kind in [] if inner else before:
            _aside(w, kind)
        _article(w)
        for kind in [] if inner else after:
            _aside(w, kind)
        w.raw(f"</{wrap.split()[0]}>" if wrap else "")
        for kind in after if inner else []:
            _aside(w, kind)
        w.raw(chance.choice(["</body></html>", "</body></html>", ""]))
        pages.append(("".join(w.out), w.labels))
    return pages


@lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """The field trained on the labelled pages."""
    return train(labelled_pages())
