"""Main text of web pages: flat text blocks, told apart by a small decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a text block.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio".split()
)
#: Elements whose text is never the article's.
CHROME = frozenset("nav footer aside form button select dialog menu iframe search optgroup option fieldset".split())
#: Elements that hold running text.
PARAGRAPHS = frozenset("p blockquote pre".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are dropped with all they hold, if they end.
DROPPED = frozenset("noscript template svg object canvas".split())
#: Elements that a new one of their kind closes.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in a class, id or role that name what an article is not.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright"
    " disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation navigational newsletter notice notices alert pager pagination paywall popup promo promoted"
    " promotion recommended related reply replies respond search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription tags"
    " teaser toolbar topbar widget widgets complementary".split()
)
#: Words that name the article's own element.
MAIN = frozenset("main article content post entry story".split())
#: Words that name reader comments, and elements that hold controls: neither wraps an article by holding most of the text.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
CONTROLS = frozenset("nav footer button select menu iframe optgroup option".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
# the rest of a tag: quotes count after an equals sign, if they are closed
_REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[\"'])*+>")
_BEGINS = {name: re.compile(rf"<{name}(?=[\s/>])", re.I) for name in RAW}
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

# Labelled blocks: words and link density of the block, of the one before and of the one after;
# region (1 in the page's article, 0 the page names none, -1 outside of it); whether an element
# or a name around says that it is something else; heading; paragraph. The last value: part of the article.
LABELLED = [
    (45, 0.00, 60, 0.00, 52, 0.00, 1, 0, 0, 1, 1),
    (8, 0.00, 0, 0.00, 40, 0.00, 1, 0, 1, 0, 1),
    (4, 0.00, 40, 0.00, 35, 0.02, 1, 0, 1, 0, 1),
    (3, 0.00, 50, 0.00, 44, 0.00, 1, 0, 0, 1, 1),
    (2, 0.00, 6, 1.00, 30, 0.00, 1, 0, 0, 1, 1),
    (60, 0.10, 41, 0.00, 0, 0.00, 1, 0, 0, 1, 1),
    (1, 0.00, 55, 0.00, 0, 0.00, 1, 0, 0, 1, 1),
    (12, 0.25, 30, 0.00, 28, 0.00, 1, 0, 0, 1, 1),
    (9, 1.00, 33, 0.00, 25, 0.00, 1, 0, 0, 0, 1),
    (20, 0.50, 18, 0.00, 3, 1.00, 1, 0, 0, 1, 1),
    (5, 1.00, 40, 0.00, 2, 1.00, 1, 0, 0, 0, 1),
    (90, 0.02, 8, 1.00, 4, 1.00, 1, 0, 0, 1, 1),
    (45, 0.00, 60, 0.00, 52, 0.00, 1, 1, 0, 1, 0),
    (6, 0.00, 50, 0.00, 20, 0.00, 1, 1, 1, 0, 0),
    (3, 1.00, 3, 1.00, 3, 1.00, 1, 1, 0, 0, 0),
    (25, 0.00, 3, 0.50, 18, 0.00, 1, 1, 0, 1, 0),
    (14, 0.20, 40, 0.00, 30, 0.00, 1, 1, 0, 1, 0),
    (1, 1.00, 0, 0.00, 1, 1.00, -1, 1, 0, 0, 0),
    (2, 1.00, 1, 1.00, 1, 1.00, -1, 1, 0, 0, 0),
    (9, 0.00, 1, 1.00, 12, 0.00, -1, 1, 0, 1, 0),
    (40, 0.00, 22, 0.00, 35, 0.00, -1, 1, 0, 1, 0),
    (7, 0.00, 44, 0.00, 0, 0.00, -1, 1, 0, 0, 0),
    (40, 0.00, 22, 0.00, 35, 0.00, -1, 0, 0, 0, 0),
    (12, 0.00, 2, 1.00, 8, 0.00, -1, 0, 0, 0, 0),
    (3, 0.00, 0, 0.00, 1, 1.00, -1, 0, 1, 0, 0),
    (70, 0.05, 50, 0.00, 3, 0.00, -1, 0, 0, 0, 0),
    (2, 1.00, 2, 1.00, 2, 1.00, -1, 0, 0, 0, 0),
    (45, 0.00, 60, 0.00, 52, 0.00, 0, 0, 0, 1, 1),
    (33, 0.05, 4, 0.00, 40, 0.00, 0, 0, 0, 1, 1),
    (22, 0.12, 35, 0.00, 5, 0.60, 0, 0, 0, 1, 1),
    (80, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 1, 1),
    (28, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1, 1),
    (16, 0.00, 25, 0.00, 30, 0.00, 0, 0, 0, 1, 1),
    (12, 0.00, 44, 0.00, 50, 0.00, 0, 0, 0, 1, 1),
    (13, 0.00, 8, 0.00, 30, 0.00, 0, 0, 0, 1, 1),
    (6, 0.00, 28, 0.00, 40, 0.00, 0, 0, 0, 1, 1),
    (4, 0.00, 30, 0.00, 26, 0.00, 0, 0, 0, 1, 1),
    (3, 0.00, 60, 0.00, 45, 0.00, 0, 0, 0, 1, 1),
    (8, 0.00, 5, 1.00, 40, 0.00, 0, 0, 1, 0, 1),
    (5, 0.00, 2, 1.00, 25, 0.00, 0, 0, 1, 0, 1),
    (6, 0.00, 0, 0.00, 55, 0.00, 0, 0, 1, 0, 1),
    (7, 0.00, 40, 0.00, 33, 0.00, 0, 0, 1, 0, 1),
    (11, 0.00, 2, 1.00, 38, 0.00, 0, 0, 1, 0, 1),
    (3, 0.00, 30, 0.00, 3, 1.00, 0, 0, 1, 0, 0),
    (2, 0.00, 3, 0.00, 2, 1.00, 0, 0, 1, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0, 0),
    (2, 1.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0, 0),
    (4, 1.00, 5, 1.00, 40, 0.00, 0, 0, 0, 0, 0),
    (9, 1.00, 30, 0.00, 8, 1.00, 0, 0, 0, 0, 0),
    (14, 0.85, 12, 0.90, 15, 0.80, 0, 0, 0, 0, 0),
    (40, 0.70, 50, 0.00, 35, 0.66, 0, 0, 0, 0, 0),
    (25, 0.60, 6, 1.00, 4, 1.00, 0, 0, 0, 0, 0),
    (3, 0.00, 2, 1.00, 1, 1.00, 0, 0, 0, 0, 0),
    (5, 0.00, 3, 0.00, 4, 0.50, 0, 0, 0, 0, 0),
    (4, 0.00, 6, 0.00, 0, 0.00, 0, 0, 0, 0, 0),
    (6, 0.00, 45, 0.00, 0, 0.00, 0, 0, 0, 0, 0),
    (7, 0.30, 40, 0.00, 2, 1.00, 0, 0, 0, 0, 0),
    (8, 0.10, 4, 1.00, 0, 0.00, 0, 0, 0, 0, 0),
    (40, 0.00, 60, 0.00, 52, 0.00, 0, 1, 0, 1, 0),
    (12, 0.00, 2, 1.00, 40, 0.00, 0, 1, 0, 1, 0),
    (5, 0.00, 30, 0.00, 26, 0.00, 0, 1, 1, 0, 0),
    (2, 1.00, 2, 1.00, 2, 1.00, 0, 1, 0, 0, 0),
    (9, 0.00, 44, 0.00, 5, 0.00, 0, 0, 0, 1, 1),
    (4, 0.00, 30, 0.00, 6, 0.50, 0, 0, 0, 1, 1),
    (2, 0.00, 8, 0.00, 0, 0.00, 0, 0, 0, 1, 1),
    (12, 0.20, 40, 0.00, 3, 1.00, 0, 0, 0, 1, 1),
    (3, 1.00, 40, 0.00, 3, 1.00, 0, 0, 0, 1, 0),
    (6, 0.90, 4, 1.00, 5, 0.80, 0, 0, 0, 1, 0),
    (30, 0.00, 40, 0.00, 35, 0.00, 0, 0, 0, 0, 1),
    (26, 0.10, 3, 1.00, 30, 0.00, 0, 0, 0, 0, 1),
    (5, 0.00, 2, 0.00, 6, 0.00, 0, 1, 0, 1, 0),
    (24, 0.00, 30, 0.00, 28, 0.00, 0, 1, 0, 1, 0),
    (18, 0.00, 10, 0.00, 14, 0.00, -1, 0, 0, 1, 0),
    (50, 0.00, 40, 0.00, 44, 0.00, -1, 0, 0, 1, 0),
    (6, 0.00, 5, 0.00, 30, 0.00, -1, 0, 0, 1, 0),
    (3, 0.00, 2, 0.00, 0, 0.00, 1, 0, 0, 1, 1),
    (7, 0.00, 10, 0.00, 4, 0.00, 1, 0, 0, 0, 1),
    (2, 0.50, 10, 0.00, 4, 0.00, 1, 0, 0, 0, 1),
]


def grow(rows: np.ndarray, depth: int = 8) -> tuple | bool:
    """A decision tree by least Gini impurity: (feature, bound, tree at most, tree above), or a class."""
    x, y = rows[:, :-1], rows[:, -1]
    if depth == 0 or y.min() == y.max():
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            left = y[x[:, f] <= bound]
            right = y[x[:, f] > bound]
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (left, right))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(bound))
    if best is None:
        return bool(y.mean() >= 0.5)
    _, f, bound = best
    return f, bound, grow(rows[x[:, f] <= bound], depth - 1), grow(rows[x[:, f] > bound], depth - 1)


def decide(tree: tuple | bool, features: tuple) -> bool:
    while not isinstance(tree, bool):
        f, bound, low, high = tree
        tree = low if features[f] <= bound else high
    return tree


def _names(rest: str) -> set[str]:
    """The words in class, id and role; a name like has-sidebar says what a page has, not what it is."""
    found = set()
    for _, a, b, c in _NAMED.findall(rest):
        for name in (a or b or c).lower().split():
            parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
            if parts and parts[0] not in ("has", "with", "no", "is", "not"):
                found.update(parts)
    return found


class _Ahead:
    """The next match of each pattern from a place on; places only grow, so each pattern reads the page once."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def next(self, pattern: re.Pattern, at: int) -> tuple[int, int] | None:
        if pattern not in self.known or self.known[pattern] and self.known[pattern][0] < at:
            m = pattern.search(self.page, at)
            self.known[pattern] = m and m.span()
        return self.known[pattern]


def tokens(page: str) -> list[tuple[int, int, bool, str | None, str]]:
    """(start, end, whether it closes, name, rest) of each tag, and without a name what is no text, in time in proportion to the page.

    A comment or raw element that has no end takes the rest of the page; a tag without one is
    text. Once quotes of one tag swallow all that follows, tags end at their first bracket.
    """
    found: list[tuple[int, int, bool, str | None, str]] = []
    last, size, ahead, quoted = page.rfind(">"), len(page), _Ahead(page), True
    at = page.find("<")
    while 0 <= at < last:
        m = _NAME.match(page, at + 1)
        name, rest, closes = None, "", False
        if m:
            whole = _REST.match(page, m.end()) if quoted else None
            quoted = whole is not None
            stop = whole.end() if whole else page.find(">", m.end()) + 1
            name, rest, closes = m[2].lower(), page[m.end() : stop - 1], bool(m[1])
            if name in RAW and not closes:
                end = ahead.next(_ENDS[name], stop)
                if not rest.endswith("/"):
                    name, stop = None, end[1] if end else size
                elif end:  # self-closed: up to an end of its own, if one comes before the next such element
                    again = ahead.next(_BEGINS[name], stop)
                    if not again or end[0] < again[0]:
                        name, stop = None, end[1]
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4) + 3
            stop = stop if stop > 2 else size
        elif page[at + 1] in "!?/":
            stop = page.find(">", at) + 1
        else:
            at = page.find("<", at + 1)
            continue
        found.append((at, stop, closes, name, rest))
        at = page.find("<", stop)
    if at >= 0 and (at := page.find("<!--", at)) >= 0:
        found.append((at, size, False, None, ""))
    return found


def _dropped(found: list[tuple[int, int, bool, str | None, str]]) -> dict[int, int]:
    """Where each dropped element that ends begins and ends; an end belongs to the last one of its name that is open."""
    opened: dict[str, list[int]] = {name: [] for name in DROPPED}
    ends = {}
    for i, (_, _, closes, name, rest) in enumerate(found):
        if name not in DROPPED:
            continue
        if not closes:
            if name != "svg" or not rest.endswith("/"):
                opened[name].append(i)
        elif opened[name]:
            ends[opened[name].pop()] = i
    return ends


class Element:
    """A block element: what its name, class, id and role say, and the words (links aside) of its own blocks."""

    __slots__ = ("name", "parent", "candidate", "said", "header", "comments", "heading", "words")

    def __init__(self, name: str, parent: int, rest: str):
        names = _names(rest) if rest else set()
        whole = name in ("", "html", "body")
        self.name, self.parent, self.words = name, parent, 0
        self.candidate = name in ("article", "main") or bool(names & MAIN) and name in ("div", "section")
        self.said = not whole and (bool(names & HINTS) or name in CHROME or bool(rest and _HIDDEN.search(rest)))
        self.header = not whole and not self.said and not self.candidate and (name == "header" or "header" in names)
        self.comments = self.said and bool(names & COMMENTS)
        self.heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")


def _judged(elements: list[Element]) -> list[tuple[bool, bool]]:
    """(in the article, said to be something else) for each element, parents first.

    What is said of an element goes for all in it, unless it wraps the article: it holds most
    words of the elements that are named as an article and nothing else, or, where no such
    element has a quarter of the page's words, most of the words that are neither in comments
    nor controls, while little is outside of all that is said to be something else. A wrapper
    named after comments must hold nearly all words there are.
    """
    n = len(elements)
    furniture = [e.said or e.header for e in elements]
    named, apart = [False] * n, [False] * n  # within a clean candidate; within comments or controls
    for i, e in enumerate(elements):
        up = e.parent
        apart[i] = e.comments or e.name in CONTROLS or i > 0 and apart[up]
        named[i] = not apart[i] and (e.candidate and not e.said or i > 0 and named[up] and not furniture[i])
    words, held, article, clean = ([0] * n for _ in range(4))
    for i in range(n - 1, -1, -1):
        e = elements[i]
        words[i] += e.words
        held[i] += 0 if apart[i] else e.words
        article[i] += e.words if named[i] else 0
        clean[i] += e.words
        if i:
            words[e.parent] += words[i]
            held[e.parent] += held[i]
            article[e.parent] += article[i]
            clean[e.parent] += 0 if furniture[i] else clean[i]
    by_name = article[0] > 0 and 4 * article[0] >= held[0]
    outside = clean[0]
    judged: list[tuple[bool, bool]] = []
    vetoed = [False] * n
    for i, e in enumerate(elements):
        main, other = judged[e.parent] if i else (False, False)
        if furniture[i] and not other:
            if e.comments:
                wraps = 4 * (words[0] - words[i]) < words[i] and outside == 0
            elif by_name:
                wraps = 2 * article[i] > article[0]
            else:
                wraps = e.name not in CONTROLS and 2 * held[i] > held[0] and 4 * outside < held[i]
            if wraps:
                outside += clean[i]
            else:  # a header within the article heads the article itself
                vetoed[i] = e.said or not main
        other = other or vetoed[i]
        judged.append((main or e.candidate and not other, other))
    return judged


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool]]:
    """(text, words, words in links, in the article, said to be something else, heading, paragraph) in page order."""
    found: list[tuple[str, int, int, int, bool]] = []
    text: list[str] = []
    linked: list[str] = []
    elements = [Element("", 0, "")]
    # open elements by number, whether a heading is around each, and how many of each name are open
    stack: list[tuple[int, bool]] = [(0, False)]
    opened: dict[str, int] = {}
    in_link = False
    at = 0

    def close() -> None:
        body = " ".join("".join(text).split())
        if body:
            own, heading = stack[-1]
            n, n_linked = len(body.split()), len("".join(linked).split())
            elements[own].words += max(0, n - n_linked)
            found.append((body, n, n_linked, own, heading))
        text.clear()
        linked.clear()

    def add(piece: str) -> None:
        if piece:
            piece = html.unescape(piece)
            text.append(piece)
            if in_link:
                linked.append(piece)

    def leave() -> str:
        name = elements[stack.pop()[0]].name
        opened[name] -= 1
        return name

    tags = tokens(page)
    dropped = _dropped(tags)
    behind = 0
    for i, (start, stop, closes, name, rest) in enumerate(tags):
        if i < behind:
            continue
        add(page[at:start])
        if i in dropped:
            behind = dropped[i] + 1
            at = tags[dropped[i]][1]
            continue
        at = stop
        if name == "a":
            in_link = not closes
            text.append("")
            linked.append(" ")
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS:
            close()
            if closes:
                if opened.get(name):
                    while leave() != name:
                        pass
                if name != "li" and name != "p":
                    in_link = False
                continue
            if name in VOID:
                continue
            while elements[stack[-1][0]].name in SIBLINGS.get(name, ()):
                leave()
            own, heading = stack[-1]
            elements.append(Element(name, own, rest))
            opened[name] = opened.get(name, 0) + 1
            stack.append((len(elements) - 1, heading or elements[-1].heading))
    add(page[at:])
    close()
    judged = _judged(elements)
    return [(body, n, n_linked, *judged[own], heading, elements[own].name in PARAGRAPHS) for body, n, n_linked, own, heading in found]


def main_text(page: str, tree: tuple | bool) -> str:
    """The blocks that the tree takes for the article, joined by empty lines."""
    found = blocks(page)
    if not found:
        return ""
    named = any(b[3] for b in found)
    sizes = [(0, 0.0), *((b[1], min(1.0, b[2] / b[1])) for b in found), (0, 0.0)]
    kept = []
    for i, (body, _, _, main, other, heading, paragraph) in enumerate(found, 1):
        region = (1 if main else -1) if named else 0
        if decide(tree, (*sizes[i], *sizes[i - 1], *sizes[i + 1], region, int(other), int(heading), int(paragraph))):
            kept.append(body)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page: its article without menus, adverts, comments and the like.

    The page is cut at block elements into flat text blocks, with character references decoded
    and white space inside a block as one space. A tree trained on ``LABELLED`` looks at each
    block's words and link density, at those of its neighbours, and at what the elements around
    it say. Null html counts as empty and gives an empty text; broken or cut-off markup is read
    as far as it goes, and only a script, style, title or textarea without an end takes the rest of
    the page with it; formulas are text; rows repeat as they come; other columns are ignored.
    """
    tree = grow(np.array(LABELLED, float))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [main_text(h, tree) for h in part["html"].fillna("")]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    # ids as text: pandas would turn long ones beside a null into floats
    named = pages.selectExpr("cast(cast(page_id as bigint) as string) page_id", "cast(url as string) url", "html")
    return named.mapInPandas(read, "page_id string, url string, text string, n_chars bigint").withColumn("page_id", F.col("page_id").cast("long"))
