"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded over the tree.

A tolerant reader makes a tree of block elements; every run of inline text between block boundaries is a leaf. Scripts, styles, titles and
text areas are passed over; formulas are inline text; noscript, template, iframe, svg and object are nodes if they show something.
Each node gets statistics (subtree density, links, depth, siblings, place in the page) and hashed tokens of its own, its parent's
and its ancestors' tags and attributes. Boosted trees of depth `DEPTH` give each node the log odds to be main text.
Decoding takes the choice of nodes with the greatest total log odds in which no node is kept without its ancestors, by
one pass up and one down the tree, so no choice contradicts another.

There are no labels for pages, so the trees are fitted on the driver on `PAGES` pages that `training_page` makes: articles of several
shapes among menus, headers, footers, sidebars, notices, adverts, forms, related links and reader comments. The seed is fixed. Elements of forms
are dropped whatever the trees say, and of a page without any element all is kept.

Text of kept leaves has its character references decoded and white space turned into one space, is trimmed, and joined in page order
by one newline. Null and empty pages, and pages without kept text, give the empty string. Ids play no part, so null and
repeated rows are rows as others; empty tables give no row. Extra columns are carried by `with_main_text` under their names.
"""

from __future__ import annotations

import html as html_
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import map_batches, table, unused

PAGES, TREES, DEPTH, RATE, TOKENS, LEVELS = 400, 40, 4, 0.3, 512, 16
#: Elements of forms, which are never main text. A form that holds an article or a headline is the page's own wrapper, and no form.
_FORM = frozenset("button datalist fieldset input keygen legend meter optgroup option output progress select textarea".split())
_WRAPPED = frozenset("article main h1".split())

#: A comment, a declaration, an end tag without a name, or a tag. A value ends at its quote, without one at white space or `>`; a quote
#: that is never closed is a character like others.
_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^<>]*>"
    r"|(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)|[^>])*+)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = frozenset("script style".split())
#: Elements within a run of text that get a node once they show something, so that an empty one does not cut the run.
_LATE = frozenset("noscript template iframe svg object".split())
_TEXT_ONLY = frozenset("title textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
_INLINE |= frozenset("math annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements that end an svg which has no end tag.
_BREAKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr li main menu nav ol p pre section table ul".split())
#: Elements that end when one of the second kind begins.
_ENDS = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "head": frozenset(["body"]),
}
_ENDED_BY = {name: tuple(x for x, ends in _ENDS.items() if name in ends) for name in frozenset().union(*_ENDS.values())}
_SCOPE = frozenset("table ul ol dl body html noscript template iframe object".split())
STATISTICS = ("text", "link share", "leaves", "depth", "place among siblings", "siblings", "stops", "word length", "begins at", "share of page", "paragraphs", "links", "items", "text a tag", "siblings' text", "parent's text", "own leaf")


class Page:
    """The tree of one page, in page order; parallel lists by node."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names, self.text, self.linked, self.links = ["#root"], [-1], [()], [""], [0], [0]
        self._stack, self._run, self._link = [0], [], 0
        self._run_linked = self._run_links = self._svg = 0
        self._late: list[tuple[str, tuple]] = []
        self._late_open: dict[str, int] = {}  # how many of a name are in _late
        self._open: dict[str, list[int]] = {}  # where in the stack elements of a name are
        self._scopes: list[int] = []  # where in the stack elements of _SCOPE are
        self._read(source)

    def _add(self, tag: str, names: tuple, text: str = "", linked: int = 0, links: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.links.append(links)
        return len(self.tag) - 1

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                self._add("#text", (), text, min(self._run_linked, len(text)), self._run_links)
            self._run, self._run_linked, self._run_links = [], 0, 0

    def _place(self) -> None:
        """Gives the late elements their nodes."""
        if self._late:
            self._flush()
            for name, names in self._late:
                self._push(name, names)
            self._late, self._late_open = [], {}

    def _push(self, name: str, names: tuple) -> None:
        self._open.setdefault(name, []).append(len(self._stack))
        if name in _SCOPE:
            self._scopes.append(len(self._stack))
        self._stack.append(self._add(name, names))

    def _pop(self, k: int) -> int:
        """Ends the elements from place k of the stack on; how many of them were svg."""
        gone = 0
        while len(self._stack) > k:
            name = self.tag[self._stack.pop()]
            self._open[name].pop()
            if name in _SCOPE:
                self._scopes.pop()
            gone += name == "svg"
        return gone

    def _pop_late(self, k: int) -> int:
        gone = 0
        while len(self._late) > k:
            name = self._late.pop()[0]
            self._late_open[name] -= 1
            gone += name == "svg"
        return gone

    def _end(self, name: str) -> bool:
        """Ends the innermost open element of that name and what is in it; whether a node ended.

        Names that are not open cost nothing, others what they end, so the time is linear in the tags.
        """
        if self._late_open.get(name):
            k = len(self._late) - 1
            while self._late[k][0] != name:
                k -= 1
            self._svg -= self._pop_late(k)
            return False
        if not self._open.get(name):
            return False
        self._flush()
        self._svg -= self._pop_late(0) + self._pop(self._open[name][-1])
        return True

    def _say(self, raw: str) -> None:
        text = html_.unescape(raw) if "&" in raw else raw
        if self._late and text.strip():
            self._place()
        self._run.append(text)
        if self._link:
            self._run_linked += len(text)

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = _TAG.search(source, at)
            if m is None:
                if at < len(source):
                    self._say(source[at:])
                break
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    self._link = max(0, self._link - 1)
                if name in _INLINE:
                    continue
                if self._end(name):
                    self._link = 0
                elif self._svg and not self._late:
                    self._run.append(" ")
                continue
            closed = m[3].endswith("/")
            if name in _RAW or name in _TEXT_ONLY:
                if self._svg and closed:
                    continue
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if name in _INLINE:
                if name == "a":
                    self._place()
                    self._link, self._run_links = self._link + 1, self._run_links + 1
                elif name == "br":
                    self._run.append(" ")
                continue
            if name in _LATE:
                if name != "svg" or not closed:
                    self._late.append((name, _attribute_names(m[3])))
                    self._late_open[name] = self._late_open.get(name, 0) + 1
                    self._svg += name == "svg"
                continue
            if self._svg:
                if name not in _BREAKS:
                    if not self._late:
                        self._run.append(" ")
                    continue
                while self._svg:
                    self._end("svg")
            if name in _VOID:
                self._flush()
                continue
            self._place()
            self._flush()
            k = max((self._open[x][-1] for x in _ENDED_BY.get(name, ()) if self._open.get(x)), default=0)
            if k > (self._scopes[-1] if self._scopes else 0):
                self._pop(k)
            self._link = 0
            self._push(name, _attribute_names(m[3]))
        self._flush()


_NAMES: dict[str, tuple] = {}


def _attribute_names(raw: str) -> tuple:
    """Lower-case words of class, id, role and itemprop."""
    if not raw.strip():
        return ()
    if (found := _NAMES.get(raw)) is None:
        found = tuple(dict.fromkeys(w for m in _ATTRIBUTE.finditer(raw) for w in _WORD.findall(_HUMP.sub(" ", m[1]).lower())))
        if len(_NAMES) > 20_000:
            _NAMES.clear()
        _NAMES[raw] = found
    return found


_BUCKETS: dict[tuple, np.ndarray] = {}
_MASKS: dict[tuple, int] = {}


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % TOKENS


def _mask(kind: str, tag: str, names: tuple) -> int:
    """Buckets of the tokens that a tag and its names give as `kind` (own, parent or in), a bit each."""
    key = (kind, tag, names)
    if (found := _MASKS.get(key)) is None:
        found = 0
        for token in (f"{kind}:{tag}", *(f"{kind}.{x}" for x in names)):
            found |= 1 << _bucket(token)
        if len(_MASKS) > 20_000:
            _MASKS.clear()
        _MASKS[key] = found
    return found


def _buckets(own: tuple, parent: tuple | None, inside: int) -> np.ndarray:
    """Buckets of the tokens of a node, given (tag, names) of itself and its parent, and the mask of all its ancestors."""
    key = (own, parent, inside)
    if (found := _BUCKETS.get(key)) is None:
        mask = inside | _mask("own", *own) | (_mask("parent", *parent) if parent else 0)
        found = np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes(TOKENS // 8, "little"), np.uint8), bitorder="little"))
        if len(_BUCKETS) > 20_000:
            _BUCKETS.clear()
        _BUCKETS[key] = found
    return found


def node_features(page: Page) -> tuple[np.ndarray, list[np.ndarray]]:
    """(statistics, buckets of tokens) of each node."""
    n, parent = len(page.tag), page.parent
    depth, index, children = [0] * n, [0] * n, [0] * n
    text, linked, leaves, stops, words, paragraphs, links, items, tags = ([0] * n for _ in range(9))
    begin, tokens, said = [0] * n, [], 0
    inside, below = [0] * n, [0] * n  # masks of a node's ancestors, and of these and itself
    for i in range(n):
        p = parent[i]
        if p >= 0:
            depth[i], index[i] = depth[p] + 1, children[p]
            children[p] += 1
        own = (page.tag[i], page.names[i])
        inside[i] = below[p] if p >= 0 else 0
        below[i] = inside[i] | _mask("in", *own)
        tokens.append(_buckets(own, (page.tag[p], page.names[p]) if p >= 0 else None, inside[i]))
        begin[i] = said
        if t := page.text[i]:
            said += len(t)
            text[i], linked[i], leaves[i], links[i] = len(t), page.linked[i], 1, page.links[i]
            stops[i], words[i] = t.count(".") + t.count(","), t.count(" ") + 1
        else:
            tags[i] = 1
        paragraphs[i], items[i] = page.tag[i] == "p", page.tag[i] == "li"
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for x in (text, linked, leaves, stops, words, paragraphs, links, items, tags):
            x[p] += x[i]
    a = np.array([text, linked, leaves, stops, words, paragraphs, links, items, tags, depth, index, children, begin], float)
    text, linked, leaves, stops, words, paragraphs, links, items, tags, depth, index, children, begin = a
    up = np.maximum(parent, 0)
    stats = np.stack([
        np.log1p(text), linked / np.maximum(text, 1), np.log1p(leaves), depth, index / np.maximum(children[up] - 1, 1), np.log1p(children[up]),
        stops / np.maximum(words, 1), text / np.maximum(words, 1), begin / max(said, 1), text / max(said, 1), np.log1p(paragraphs), np.log1p(links),
        np.log1p(items), np.log1p(text / np.maximum(tags, 1)), np.log1p((text[up] - text) / np.maximum(children[up] - 1, 1)), np.log1p(text[up]), np.array([t == "#text" for t in page.tag], float),
    ], axis=1)
    return stats, tokens


class Forest:
    """Boosted trees over binned statistics and token indicators. Trees are complete; a node n has children 2n + 1 and 2n + 2."""

    def __init__(self, edges: np.ndarray):
        self.edges, self.base, self.trees = edges, 0.0, []

    def bins(self, stats: np.ndarray, tokens: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(stats), stats.shape[1] + TOKENS), np.uint8)
        for j in range(stats.shape[1]):
            out[:, j] = np.searchsorted(self.edges[j], stats[:, j], "right")
        if tokens:
            rows = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            out[rows, stats.shape[1] + np.concatenate(tokens)] = 1
        return out

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, above, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > above[at])
            out += value[at - (2**DEPTH - 1)]
        return out


def fit(stats: np.ndarray, tokens: list[np.ndarray], label: np.ndarray) -> Forest:
    """Newton boosting of the logistic loss on histograms."""
    edges = np.stack([np.quantile(s, np.linspace(0, 1, LEVELS + 1)[1:-1]) for s in stats.T])
    f = Forest(edges)
    x, m = f.bins(stats, tokens), stats.shape[1]
    (row, token), z = x[:, m:].nonzero(), np.zeros(len(x))
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = p - label, np.maximum(p * (1 - p), 1e-6)
        feature, above, at = np.zeros(inner, np.int64), np.full(inner, 255, np.int64), np.zeros(len(x), np.int64)
        for d in range(DEPTH):
            first, width = 2**d - 1, 2**d
            here = at - first
            sums = [np.bincount(here, w, width) for w in (g, h)]
            best = np.full(width, 1e-6)
            gain = lambda a, b: a * a / (b + 1.0)
            for j in range(m):
                left = [np.cumsum(np.bincount(here * LEVELS + x[:, j], w, width * LEVELS).reshape(width, LEVELS), 1)[:, :-1] for w in (g, h)]
                found = gain(*left) + gain(sums[0][:, None] - left[0], sums[1][:, None] - left[1]) - gain(*sums)[:, None]
                k = found.argmax(1)
                better = found[np.arange(width), k] > best
                best[better] = found[np.arange(width), k][better]
                feature[first : first + width][better], above[first : first + width][better] = j, k[better]
            with_ = [np.bincount(here[row] * TOKENS + token, w[row], width * TOKENS).reshape(width, TOKENS) for w in (g, h)]
            found = gain(*with_) + gain(sums[0][:, None] - with_[0], sums[1][:, None] - with_[1]) - gain(*sums)[:, None]
            k = found.argmax(1)
            better = found[np.arange(width), k] > best
            feature[first : first + width][better], above[first : first + width][better] = m + k[better], 0
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > above[at])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1.0)
        z += value[leaf]
        f.trees.append((feature, above, value))
    return f


def of_forms(page: Page) -> list[int]:
    """Nodes that begin what is of a form."""
    out, wraps = [], set()
    for i in range(len(page.tag) - 1, 0, -1):
        if page.tag[i] in _WRAPPED or i in wraps:
            wraps.add(page.parent[i])
        if page.tag[i] in _FORM or page.tag[i] == "form" and i not in wraps:
            out.append(i)
    return out


def decode(parent: list[int], odds: np.ndarray) -> list[bool]:
    """The choice of greatest total log odds in which a kept node's ancestors are kept. Parents come before children."""
    n = len(parent)
    keep = [float(o) for o in odds]  # gain over dropping the whole subtree
    keep[0] = max(keep[0], 0.0)
    for i in range(n - 1, 0, -1):
        if keep[i] > 0:
            keep[parent[i]] += keep[i]
    chosen = [False] * n
    chosen[0] = True
    for i in range(1, n):
        chosen[i] = chosen[parent[i]] and keep[i] > 0
    return chosen


_PARTS = "an be con de er fi go hu in ka lo mi na or pe qui ra se ti un va xe".split()


def training_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page and the text of its main leaves, in page order."""
    main: list[str] = []
    pick = lambda *x: x[int(rng.integers(len(x)))]

    def words(lo: int, hi: int, ends: bool = True) -> str:
        out = []
        for _ in range(int(rng.integers(lo, hi))):
            out.append("".join(pick(*_PARTS) for _ in range(int(rng.integers(1, 4)))) + (pick(".", ",", "") if ends and rng.random() < 0.2 else ""))
        return " ".join(out) + ("." if ends else "")

    def link(lo: int = 1, hi: int = 4) -> str:
        return f'<a href="/{words(1, 2, False)}">{words(lo, hi, False)}</a>'

    def menu(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(2, 9)))) + f"</{tag}>"

    def said(text: str) -> str:
        main.append(text)
        if rng.random() < 0.2 and len(text.split()) > 4:
            a = text.split()
            k = int(rng.integers(1, len(a) - 1))
            return " ".join(a[:k]) + f" {pick('<b>', '<em>', '<a href=/x>')}{a[k]}{pick('</b>', '</em>', '</a>')} " + " ".join(a[k + 1 :])
        return text

    def paragraph() -> str:
        text = said(words(4, 90) if rng.random() < 0.85 else words(1, 6))
        return pick("<p>", "<p>", "<p>", "<p class=text>", "<p><b>") + text + pick("</p>", "</p>", "</p>", "<br>")

    def comments() -> str:
        kind = pick("comments", "comment-list", "discussion", "responses")
        each = "".join(f'<{(t := pick("div", "li"))} class="comment"><p>{words(3, 40)}</p></{t}>' for _ in range(int(rng.integers(1, 5))))
        return f'<{(t := pick("section", "div"))} {pick("id", "class")}="{kind}"><h3>{words(1, 3, False)}</h3>{each}</{t}>'

    def side() -> str:
        inner = pick(menu(), f"<h4>{words(1, 4, False)}</h4>{menu()}", f"<p>{words(3, 20)}</p>")
        return pick(f"<aside>{inner}</aside>", f'<div class="{pick("sidebar", "widget", "related", "promo")}">{inner}</div>')

    def extra() -> str:
        return pick(
            f'<div class="{pick("ad", "ads", "advert", "banner", "sponsored")}">{words(2, 25)}</div>',
            f'<div id="{pick("cookie", "notice", "consent", "newsletter", "popup")}"><p>{words(4, 25)}</p></div>',
            f"<form action=/s><label>{words(1, 4, False)}</label><input name=q><button>{words(1, 2, False)}</button></form>",
            f'<div class="{pick("share", "social", "breadcrumb", "tags", "pager")}">{link()} {link()} {link()}</div>',
        )

    def body() -> str:
        out = [f"<h1>{said(words(2, 14, False))}</h1>"] if rng.random() < 0.9 else []
        for _ in range(int(rng.integers(1, 9))):
            r = rng.random()
            if r < 0.78:
                out.append(paragraph())
            elif r < 0.84:
                out.append(f"<h2>{said(words(1, 8, False))}</h2>" + paragraph())
            elif r < 0.9:
                out.append("<ul>" + "".join(f"<li>{said(words(2, 20))}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif r < 0.94:
                out.append(f"<blockquote>{said(words(4, 30))}</blockquote>")
            elif r < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{said(words(1, 5, False))}</td><td>{said(words(1, 5, False))}</td></tr>" for _ in range(2)) + "</table>")
            else:
                out.append(extra() if rng.random() < 0.6 else side())
        return "".join(out)

    head = f"<!DOCTYPE html><html><head><title>{words(2, 9, False)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    top = pick("", f"<header><h2>{words(1, 4, False)}</h2>{menu()}</header>", f'<div class="{pick("header", "masthead")}">{words(1, 5, False)}</div>')
    nav = pick(f"<nav>{menu()}</nav>", f"<nav>{menu()}</nav>", f'<div class="{pick("menu", "navbar", "navigation")}">{menu()}</div>', "")
    before = "".join(pick(side, extra)() for _ in range(int(rng.integers(0, 3))))
    article = pick("article", "article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post entry"', 'section class="story"')
    core = f"<{article}>{body()}" + (comments() if rng.random() < 0.15 else "") + f"</{article.split()[0]}>"
    after = "".join(pick(side, extra, comments)() for _ in range(int(rng.integers(0, 3))))
    foot = pick("", *[f"<footer>&copy; {words(1, 3, False)} &middot; {words(3, 25)}</footer>"] * 3, f'<div class="footer">{menu()}{words(3, 12)}</div>')
    middle = before + core + after
    if rng.random() < 0.3:
        middle = f'<div class="{pick("wrapper", "container", "page")}">{middle}</div>'
    return head + top + nav + middle + foot + "</body></html>", main


def labels(page: Page, main: list[str]) -> np.ndarray:
    """1 for leaves of the main text and their ancestors; the texts of `main` are in page order."""
    y, k = np.zeros(len(page.tag)), 0
    want = [" ".join(html_.unescape(t).split()) for t in main]
    for i, t in enumerate(page.text):
        if t and k < len(want) and t == want[k]:
            k += 1
            while i >= 0 and not y[i]:
                y[i] = 1
                i = page.parent[i]
    return y


_TRAINED: dict[int, Forest] = {}


def train(seed: int = 11, pages: int = PAGES) -> Forest:
    """The forest for a seed; fitted once a process."""
    if (key := seed * 100_003 + pages) not in _TRAINED:
        rng = np.random.default_rng(seed)
        stats, tokens, y = [], [], []
        for _ in range(pages):
            source, main = training_page(rng)
            page = Page(source)
            s, t = node_features(page)
            stats.append(s)
            tokens += t
            y.append(labels(page, main))
        _TRAINED[key] = fit(np.concatenate(stats), tokens, np.concatenate(y))
    return _TRAINED[key]


def main_texts(sources: list[str | None], forest: Forest) -> list[str]:
    """Main text of each page; nodes of about a hundred pages are scored at once."""
    out: list[str] = []
    for k in range(0, len(sources), 100):
        pages = [Page(s or "") for s in sources[k : k + 100]]
        found = [node_features(p) for p in pages]
        odds = forest.odds(forest.bins(np.concatenate([s for s, _ in found]), [t for _, ts in found for t in ts]))
        at = 0
        for p in pages:
            own = odds[at : at + len(p.tag)]
            at += len(p.tag)
            own[of_forms(p)] = -np.inf
            bare = all(t == "#text" for t in p.tag[1:])
            out.append("\n".join(t for t, c in zip(p.text, decode(p.parent, own)) if t and (c or bare)))
    return out


def with_main_text(pages: DataFrame, forest: Forest, *, html: str = "html", name: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of pages, and the main text."""
    keep = pages.columns if keep is None else keep
    shared = pages.sparkSession.sparkContext.broadcast(forest)
    own = unused([*keep, name], "source")
    rows = pages.select(*keep, F.col(html).cast("string").alias(own))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = main_texts(part.column(len(keep)).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, name])

    return map_batches(rows, extract, pages.select(*keep).schema.add(name, "string"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages: page_id, url, text, n_chars."""
    found = with_main_text(table(spark, sf_dir, "pages"), train(), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
