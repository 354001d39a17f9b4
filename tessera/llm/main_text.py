"""Main text of web pages: flat text blocks, shallow features, a decision tree.

A page is cut at its block-level tags into flat blocks. A block is described by
its word count and link density, by those of the block before and after it, and
by what encloses it: an article element, or an element that says that it is a menu,
notice, advert, comment and the like. A small decision tree, grown on the labelled
table below when the operator starts, says which blocks are main text. On pages without an
article element the neighbours decide: a short block between long ones stays, the same
block among links goes.

An element's name, role or hiding is taken at its word. A class or id, and a form, is
a hint only: it is void if the element holds an article, or more than half of the words of
a page without one. Words of comments stay a hint that holds. States such as
`has-sidebar`, `no-comments` or `comments-open` say nothing about the element. Classes of inline
elements count only where they make up a whole block.

Edge cases: a null or empty page gives an empty text; unclosed, misnested and cut
tags are closed by what follows; a comment or script without end runs to the end
of the page; repeated rows are read each on their own; other columns are not read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select object audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
OUTSIDE = frozenset("nav header footer aside menu dialog button fieldset head".split())
ARTICLE = frozenset(("article", "main"))
OUTSIDE_WORDS = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
                           "sidebar aside rail widget footer header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter "
                           "subscribe subscription signup login search share sharing social related recommended recommendations trending popular tags pagination pager "
                           "comment comments commentlist respond reply replies discussion disqus copyright legal disclaimer skip form").split())
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
STATE_STARTS = frozenset("no has have with without hide show layout theme".split())
STATE_ENDS = frozenset("open opened closed enabled disabled fixed allowed".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ARTICLE_ROLES = frozenset(("main", "article"))

# The labelled table. Words, link density; the same of the block before and after; in an article; in something outside it; label.
# First in an article, then in something outside it, then in neither: between nothing, a link, a short, a middling and a long block.
COLUMNS = ("words", "density", "words_before", "density_before", "words_after", "density_after", "article", "outside")
LABELLED = """
2 0.0 0 0.0 0 0.0 1 0 1
12 0.0 0 0.0 0 0.0 1 0 1
60 0.0 0 0.0 0 0.0 1 0 1
4 0.3 0 0.0 0 0.0 1 0 1
2 0.0 0 0.0 50 0.0 1 0 1
12 0.0 0 0.0 50 0.0 1 0 1
60 0.0 0 0.0 50 0.0 1 0 1
9 1.0 0 0.0 50 0.0 1 0 1
2 0.0 2 1.0 2 1.0 1 0 1
12 0.0 2 1.0 2 1.0 1 0 1
60 0.0 2 1.0 2 1.0 1 0 1
4 0.3 2 1.0 2 1.0 1 0 1
2 0.0 2 1.0 50 0.0 1 0 1
12 0.0 2 1.0 50 0.0 1 0 1
60 0.0 2 1.0 50 0.0 1 0 1
9 1.0 2 1.0 50 0.0 1 0 1
2 0.0 6 0.0 6 0.0 1 0 1
12 0.0 6 0.0 6 0.0 1 0 1
60 0.0 6 0.0 6 0.0 1 0 1
4 0.3 6 0.0 6 0.0 1 0 1
2 0.0 6 0.0 0 0.0 1 0 1
12 0.0 6 0.0 0 0.0 1 0 1
60 0.0 6 0.0 0 0.0 1 0 1
9 1.0 6 0.0 0 0.0 1 0 1
2 0.0 50 0.0 50 0.0 1 0 1
12 0.0 50 0.0 50 0.0 1 0 1
60 0.0 50 0.0 50 0.0 1 0 1
4 0.3 50 0.0 50 0.0 1 0 1
2 0.0 50 0.0 2 1.0 1 0 1
12 0.0 50 0.0 2 1.0 1 0 1
60 0.0 50 0.0 2 1.0 1 0 1
9 1.0 50 0.0 2 1.0 1 0 1
2 0.0 0 0.0 0 0.0 0 1 0
12 0.0 0 0.0 0 0.0 1 1 0
60 0.0 0 0.0 0 0.0 0 1 0
4 0.3 0 0.0 0 0.0 1 1 0
2 0.0 0 0.0 50 0.0 1 1 0
12 0.0 0 0.0 50 0.0 0 1 0
60 0.0 0 0.0 50 0.0 1 1 0
9 1.0 0 0.0 50 0.0 0 1 0
2 0.0 2 1.0 2 1.0 0 1 0
12 0.0 2 1.0 2 1.0 1 1 0
60 0.0 2 1.0 2 1.0 0 1 0
4 0.3 2 1.0 2 1.0 1 1 0
2 0.0 2 1.0 50 0.0 1 1 0
12 0.0 2 1.0 50 0.0 0 1 0
60 0.0 2 1.0 50 0.0 1 1 0
9 1.0 2 1.0 50 0.0 0 1 0
2 0.0 6 0.0 6 0.0 0 1 0
12 0.0 6 0.0 6 0.0 1 1 0
60 0.0 6 0.0 6 0.0 0 1 0
4 0.3 6 0.0 6 0.0 1 1 0
2 0.0 6 0.0 0 0.0 1 1 0
12 0.0 6 0.0 0 0.0 0 1 0
60 0.0 6 0.0 0 0.0 1 1 0
9 1.0 6 0.0 0 0.0 0 1 0
2 0.0 50 0.0 50 0.0 0 1 0
12 0.0 50 0.0 50 0.0 1 1 0
60 0.0 50 0.0 50 0.0 0 1 0
4 0.3 50 0.0 50 0.0 1 1 0
2 0.0 50 0.0 2 1.0 1 1 0
12 0.0 50 0.0 2 1.0 0 1 0
60 0.0 50 0.0 2 1.0 1 1 0
9 1.0 50 0.0 2 1.0 0 1 0
3 0.0 0 0.0 0 0.0 0 0 0
3 0.0 0 0.0 2 1.0 0 0 0
3 0.0 0 0.0 6 0.0 0 0 0
3 0.0 0 0.0 50 0.0 0 0 1
3 0.0 2 1.0 0 0.0 0 0 0
3 0.0 2 1.0 2 1.0 0 0 0
3 0.0 2 1.0 6 0.0 0 0 0
3 0.0 2 1.0 50 0.0 0 0 1
3 0.0 6 0.0 0 0.0 0 0 0
3 0.0 6 0.0 2 1.0 0 0 0
3 0.0 6 0.0 6 0.0 0 0 0
3 0.0 6 0.0 50 0.0 0 0 1
3 0.0 50 0.0 0 0.0 0 0 0
3 0.0 50 0.0 2 1.0 0 0 0
3 0.0 50 0.0 6 0.0 0 0 1
3 0.0 50 0.0 50 0.0 0 0 1
9 0.0 0 0.0 0 0.0 0 0 0
9 0.0 0 0.0 2 1.0 0 0 0
9 0.0 0 0.0 6 0.0 0 0 0
9 0.0 0 0.0 50 0.0 0 0 1
9 0.0 2 1.0 0 0.0 0 0 0
9 0.0 2 1.0 2 1.0 0 0 0
9 0.0 2 1.0 6 0.0 0 0 0
9 0.0 2 1.0 50 0.0 0 0 1
9 0.0 6 0.0 0 0.0 0 0 0
9 0.0 6 0.0 2 1.0 0 0 0
9 0.0 6 0.0 6 0.0 0 0 0
9 0.0 6 0.0 50 0.0 0 0 1
9 0.0 50 0.0 0 0.0 0 0 0
9 0.0 50 0.0 2 1.0 0 0 0
9 0.0 50 0.0 6 0.0 0 0 1
9 0.0 50 0.0 50 0.0 0 0 1
11 0.0 0 0.0 0 0.0 0 0 0
11 0.0 0 0.0 2 1.0 0 0 0
11 0.0 0 0.0 6 0.0 0 0 0
11 0.0 0 0.0 50 0.0 0 0 1
11 0.0 2 1.0 0 0.0 0 0 0
11 0.0 2 1.0 2 1.0 0 0 0
11 0.0 2 1.0 6 0.0 0 0 0
11 0.0 2 1.0 50 0.0 0 0 1
11 0.0 6 0.0 0 0.0 0 0 0
11 0.0 6 0.0 2 1.0 0 0 0
11 0.0 6 0.0 6 0.0 0 0 0
11 0.0 6 0.0 50 0.0 0 0 1
11 0.0 50 0.0 0 0.0 0 0 1
11 0.0 50 0.0 2 1.0 0 0 1
11 0.0 50 0.0 6 0.0 0 0 1
11 0.0 50 0.0 50 0.0 0 0 1
20 0.0 0 0.0 0 0.0 0 0 1
20 0.0 0 0.0 2 1.0 0 0 1
20 0.0 0 0.0 6 0.0 0 0 1
20 0.0 0 0.0 50 0.0 0 0 1
20 0.0 2 1.0 0 0.0 0 0 1
20 0.0 2 1.0 2 1.0 0 0 1
20 0.0 2 1.0 6 0.0 0 0 1
20 0.0 2 1.0 50 0.0 0 0 1
20 0.0 6 0.0 0 0.0 0 0 1
20 0.0 6 0.0 2 1.0 0 0 1
20 0.0 6 0.0 6 0.0 0 0 1
20 0.0 6 0.0 50 0.0 0 0 1
20 0.0 50 0.0 0 0.0 0 0 1
20 0.0 50 0.0 2 1.0 0 0 1
20 0.0 50 0.0 6 0.0 0 0 1
20 0.0 50 0.0 50 0.0 0 0 1
3 0.7 0 0.0 2 1.0 0 0 0
3 0.7 2 1.0 2 1.0 0 0 0
3 0.7 50 0.0 50 0.0 0 0 0
3 0.7 6 0.0 50 0.0 0 0 0
3 0.7 50 0.0 0 0.0 0 0 0
9 0.6 0 0.0 2 1.0 0 0 0
9 0.6 2 1.0 2 1.0 0 0 0
9 0.6 50 0.0 50 0.0 0 0 0
9 0.6 6 0.0 50 0.0 0 0 0
9 0.6 50 0.0 0 0.0 0 0 0
30 0.8 0 0.0 2 1.0 0 0 0
30 0.8 2 1.0 2 1.0 0 0 0
30 0.8 50 0.0 50 0.0 0 0 0
30 0.8 6 0.0 50 0.0 0 0 0
30 0.8 50 0.0 0 0.0 0 0 0
2 1.0 0 0.0 2 1.0 0 0 0
2 1.0 2 1.0 2 1.0 0 0 0
2 1.0 50 0.0 50 0.0 0 0 0
2 1.0 6 0.0 50 0.0 0 0 0
2 1.0 50 0.0 0 0.0 0 0 0
5 1.0 0 0.0 2 1.0 0 0 0
5 1.0 2 1.0 2 1.0 0 0 0
5 1.0 50 0.0 50 0.0 0 0 0
5 1.0 6 0.0 50 0.0 0 0 0
5 1.0 50 0.0 0 0.0 0 0 0
8 0.2 2 1.0 50 0.0 0 0 1
8 0.2 50 0.0 50 0.0 0 0 1
8 0.2 2 1.0 2 1.0 0 0 0
8 0.2 6 0.0 0 0.0 0 0 0
25 0.2 2 1.0 50 0.0 0 0 1
25 0.2 50 0.0 50 0.0 0 0 1
25 0.2 2 1.0 2 1.0 0 0 1
25 0.2 6 0.0 0 0.0 0 0 1
70 0.1 2 1.0 50 0.0 0 0 1
70 0.1 50 0.0 50 0.0 0 0 1
70 0.1 2 1.0 2 1.0 0 0 1
70 0.1 6 0.0 0 0.0 0 0 1
3 0.0 16 0.0 16 0.0 0 0 1
3 0.0 2 1.0 16 0.0 0 0 1
3 0.0 16 0.0 2 1.0 0 0 0
3 0.0 16 0.0 0 0.0 0 0 0
3 0.0 16 0.0 6 0.0 0 0 1
3 0.0 6 0.0 16 0.0 0 0 1
9 0.0 16 0.0 16 0.0 0 0 1
9 0.0 2 1.0 16 0.0 0 0 1
9 0.0 16 0.0 2 1.0 0 0 0
9 0.0 16 0.0 0 0.0 0 0 0
9 0.0 16 0.0 6 0.0 0 0 1
9 0.0 6 0.0 16 0.0 0 0 1
14 0.0 16 0.0 16 0.0 0 0 1
14 0.0 2 1.0 16 0.0 0 0 1
14 0.0 16 0.0 2 1.0 0 0 1
14 0.0 16 0.0 0 0.0 0 0 1
14 0.0 16 0.0 6 0.0 0 0 1
14 0.0 6 0.0 16 0.0 0 0 1
30 0.8 50 0.0 50 0.0 1 0 1
30 0.9 2 1.0 2 1.0 1 0 1
40 1.0 6 0.0 50 0.0 1 0 1
20 0.6 16 0.0 16 0.0 1 0 1
"""

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/!?a-zA-Z][^<>]*\Z""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _says(value: str) -> frozenset:
    """Words of a class or id that mark what lies outside the main text; states of the page are left out."""
    out = set()
    for token in value.split():
        words = _SPLIT.split(_HUMP.sub(" ", token).lower())
        words = [w for w in words if w]
        if words and words[0] not in STATE_STARTS and words[-1] not in STATE_ENDS:
            out |= OUTSIDE_WORDS.intersection(words)
    return frozenset(out)


def _role(name: str, attributes: str) -> tuple[bool, frozenset, bool, bool]:
    """Of an element by its name and attributes: outside, words that hint at it, an article, hidden."""
    outside, article, hints, hidden = name in OUTSIDE, name in ARTICLE, frozenset(("form",)) if name == "form" else frozenset(), False
    if attributes and name not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                outside |= value.lower() in OUTSIDE_ROLES
                article |= value.lower() in ARTICLE_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                hidden = True
            elif key in ("class", "id") and name not in ARTICLE:
                hints |= _says(value)
            elif key in ("class", "id"):
                outside |= not OUTSIDE_WORDS.isdisjoint(value.lower().split()) and "comment" in value.lower()
    return outside, hints, article, hidden


class _Hint:
    """An element whose class, id or name hints that it isn't main text."""
    __slots__ = ("parent", "comments", "article", "words", "holds")

    def __init__(self, parent, comments: bool):
        self.parent, self.comments, self.article, self.words, self.holds = parent, comments, False, 0, None


class _Reader:
    """Flat blocks of a page, read from left to right in a time proportional to its length."""

    def __init__(self):
        self.out: list = []            # text, words, words in links, in an article, outside, hint
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.hinted = True             # all words of the block so far lie in inline elements with a hint
        self.open: list = []           # name, outside, article, hint, inline hints, hidden
        self.state = (False, False, None, 0, False)
        self.counts: dict[str, int] = {}
        self.scopes: list = [[None, {}]]      # a block-level element and the inline elements open within it
        self.links = 0
        self.hints: list[_Hint] = []

    def flush(self):
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                outside, article, hint, _, _ = self.state
                self.out.append((" ".join(words), len(words), len("".join(self.linked).split()), article, outside or self.hinted, hint))
            self.parts.clear()
            self.linked.clear()
        self.hinted = True

    def text(self, chunk: str):
        chunk = html.unescape(chunk) if "&" in chunk else chunk
        if self.state[4] or not chunk:
            return
        self.parts.append(chunk)
        self.linked.append(chunk if self.links else " ")
        if not self.state[3] and self.hinted and not chunk.isspace():
            self.hinted = False

    def start(self, name: str, attributes: str):
        outside, hints, article, hidden = _role(name, attributes)
        was_outside, was_article, hint, inline_hints, was_hidden = self.state
        inline = name in INLINE
        if inline:
            inline_hints += bool(hints) or outside
            outside = False
        elif hints:
            hint = _Hint(hint, not COMMENT_WORDS.isdisjoint(hints))
            self.hints.append(hint)
        if article and not was_article and not was_outside:
            up = hint
            while up is not None and not up.article and not up.comments:
                up.article = True
                up = up.parent
        self.open.append((name, self.state))
        self.state = (was_outside or outside, was_article or article, hint, inline_hints, was_hidden or hidden)
        self.counts[name] = self.counts.get(name, 0) + 1
        if inline:
            own = self.scopes[-1][1]
            own[name] = own.get(name, 0) + 1
        else:
            self.scopes.append([name, {}])
        self.links += name == "a"

    def close(self, name: str):
        while True:
            gone, self.state = self.open.pop()
            self.counts[gone] -= 1
            self.links -= gone == "a"
            if gone in INLINE:
                self.scopes[-1][1][gone] -= 1
            else:
                self.scopes.pop()
            if gone == name:
                return

    def end(self, name: str):
        if name in INLINE:
            if self.scopes[-1][1].get(name):
                self.close(name)
        else:
            self.flush()
            if self.counts.get(name):
                self.close(name)

    def found(self) -> list[tuple[str, int, int, bool, bool]]:
        """Blocks with the hints settled."""
        self.flush()
        total, articles = 0, any(a and not o for _, _, _, a, o, _ in self.out)
        for _, n, _, _, outside, hint in self.out:
            if not outside:
                total += n
                if hint is not None:
                    hint.words += n
        for h in reversed(self.hints):           # inner elements come later
            if h.parent is not None:
                h.parent.words += h.words
        for h in self.hints:
            void = not h.comments and (h.article or (not articles and 2 * h.words > total))
            h.holds = not void or (h.parent is not None and h.parent.holds)
        return [(t, n, k, article, outside or (hint is not None and hint.holds)) for t, n, k, article, outside, hint in self.out]


_RAW_ENDS = {name: re.compile(f"</{name}[^>]*(?:>|$)", re.IGNORECASE) for name in RAW}
_CUT_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
_ENDED_BY = {"li": ("p", "li"), "dt": ("p", "dt"), "dd": ("p", "dd"), "tr": ("p", "tr"), "td": ("p", "td"), "th": ("p", "th"), "option": ("p", "option")}


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """Flat blocks in page order: text, words, words in links, in an article, outside of it."""
    r = _Reader()
    at, last = 0, page.rfind(">")
    while at <= last:
        m = _TAG.search(page, at, last + 1)
        if not m:
            break
        if m.start() > at:
            r.text(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if at > last and page.startswith("<!--", m.start()) and not page.endswith("-->", 0, at):
                return r.found()                 # a comment without end
            continue
        if m[1] or m[4]:
            r.end(name)
            continue
        if name in RAW:
            end = _RAW_ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            if name not in ("script", "style"):
                r.flush()
            continue
        if name not in INLINE:
            r.flush()
            while r.scopes[-1][0] in _ENDED_BY.get(name, ("p",)):
                r.close(r.scopes[-1][0])
        elif name in ("br", "img", "wbr"):
            if name == "br":
                r.text(" ")
            continue
        if name in VOID:
            continue
        r.start(name, m[3] or m[6] or "")
    rest = page[at:]
    cut = _CUT_TAG.search(rest, max(rest.rfind("<"), 0))
    comment = rest.find("<!--")
    r.text(rest[:min(cut.start() if cut else len(rest), comment if comment >= 0 else len(rest))])
    return r.found()


def features(found) -> np.ndarray:
    """One row per block, columns as in the labelled table."""
    own = np.array([(w, k / w) for _, w, k, _, _ in found], dtype=float).reshape(-1, 2)
    none = np.zeros((1, 2))
    place = np.array([(a, o) for *_, a, o in found], dtype=float).reshape(-1, 2)
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), place])


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 10):
    """A binary tree by least impurity: (column, bound, tree at most the bound, tree above), or a label."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = (2.0, 0, 0.0)
    for c in range(rows.shape[1]):
        values = np.unique(rows[:, c])
        for bound in (values[1:] + values[:-1]) / 2:
            low = rows[:, c] <= bound
            p, q = labels[low].mean(), labels[~low].mean()
            best = min(best, (low.mean() * 2 * p * (1 - p) + (~low).mean() * 2 * q * (1 - q), c, bound))
    if best[0] >= 2 * share * (1 - share):
        return bool(share >= 0.5)
    low = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


def fitted_tree(table: str = LABELLED):
    data = np.array([line.split() for line in table.strip().splitlines()], dtype=float)
    return grow(data[:, :-1], data[:, -1])


def main_text(page: str | None, tree) -> str:
    found = blocks(page) if page else []
    kept = []
    for block, row in zip(found, features(found).tolist() if found else [], strict=True):
        node = tree
        while not isinstance(node, bool):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node:
            kept.append(block[0])
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = fitted_tree()

    def run(batches):
        for b in batches:
            texts = [main_text(x, tree) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
