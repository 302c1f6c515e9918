"""Main text of HTML pages by minimum-cut labelling.

A page is read into text blocks with their element paths. A fixed linear classifier turns
a block's features (elements around it, words of class, id and role, share of link text,
length) into the costs of calling it content or boilerplate: its two terminal capacities.
Neighbouring blocks, and blocks next to each other below one parent, are joined by edges
whose capacity falls with their distance in the tree: the price of labelling them apart.
A maximum flow finds the cheapest labelling; the blocks on the source side are the text.

Character references are decoded, white space inside a block becomes one space, and
blocks are joined by one space in page order.

What a browser does not show is no text: scripts, styles, comments, controls, and what
stands in elements for browsers that cannot show them (RAW below). Formulas and the text of
drawings are text.

Defined cases: null or empty html, or a page without content, gives an empty text;
unclosed and stray tags, and pages cut off anywhere, are read as far as they go; very long
and deeply nested pages take time in proportion to their length, as an element's text is
added up once and end tags look their element up by counts of open ones; repeated rows are
read each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only_columns, table
from .ids import text_chunks

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe object canvas audio video textarea select option title desc head".split())
#: Those of them that reach to the page's end where their end tag is missing.
TO_THE_END = frozenset("script style textarea title".split())
#: An option's end tag may be left out before the next one and its parent's end.
_OPTION_END = re.compile(r"</option\s*>|(?=<(?:option|optgroup)\b|</(?:select|datalist|optgroup)\b)", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow ms mtext mspace msub msup msubsup mfrac msqrt mroot munder mover munderover semantics tspan".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("nav footer aside form header menu dialog button fieldset article main section".split())
#: Elements that a new one inside does not look beyond for one to end.
BOXES = SECTIONS | frozenset("div table ul ol dl blockquote".split())
#: Elements that end an open one of the same group.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social comment comments commentlist disqus reply replies respond sidebar related recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar copyright legal widget widgets toolbar pager pagination login search hidden skip disclaimer adsbygoogle".split()
)
#: Names of elements around a whole page, whose other names say what it has, not what it is.
WRAPPER_NAMES = frozenset("page wrapper wrap container layout with has no site root app outer".split())
CONTENT_NAMES = frozenset("article content post entry main story body text prose".split())

#: Weights of the classifier.
BIAS, WORDS, LINKS, HEADING, IN_ARTICLE, BOILER, NAMED_BOILER, NAMED_CONTENT, PAGE_HEADER = -0.6, 0.9, -5.0, 0.7, 3.0, -7.0, -6.0, 1.2, -6.0
#: Smoothness: between neighbours, and the part of it that each step in the tree leaves.
SMOOTH, DECAY, ACROSS = 0.9, 0.6, 0.05


class _Element:
    __slots__ = ("tag", "names", "role", "hidden", "parent", "depth", "chars", "heading", "mark", "box", "room")

    def __init__(self, tag, parent, attrs=""):
        self.tag, self.parent = tag, parent
        # open elements, by tag, that an end tag or a new element here may end
        self.box = Counter() if parent is None or tag in BOXES else parent.box
        self.room = Counter() if parent is None or tag in SECTIONS else parent.room
        self.depth = parent.depth + 1 if parent else 0
        self.chars, self.heading, self.mark = 0, False, None
        self.names, self.role, self.hidden = frozenset(), "", False
        if attrs and not attrs.isspace():
            got = {}
            for m in _ATTR.finditer(attrs):
                k = (m[1] or m[5]).lower()
                got.setdefault(k, m[2] or m[3] or m[4] or "")
            if "class" in got or "id" in got:
                self.names = frozenset(x.lower() for x in _NAME.findall(got.get("class", "") + " " + got.get("id", "")))
            self.role = got.get("role", "").lower()
            style = got.get("style", "").replace(" ", "").lower()
            self.hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in style


class _Block:
    __slots__ = ("text", "where", "links", "heading")

    def __init__(self, text, where, links, heading):
        self.text, self.where, self.links, self.heading = text, where, links, heading


def blocks(html: str) -> list[_Block]:
    """The page's text blocks in order; elements know how much text they hold."""
    root = _Element("html", None)
    here = root  # the innermost open element
    every: list[_Element] = []
    sections: Counter = Counter()  # open ones
    out: list[_Block] = []
    held: list[str] = []
    links = heading = 0
    at, n = 0, len(html)
    in_link = 0

    def end_block():
        nonlocal links, heading
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                here.chars += len(text)
                out.append(_Block(text, here, min(links, len(text)), bool(heading)))
        links = 0

    def add(s):
        nonlocal links
        held.append(s)
        if in_link:
            links += len(s)

    def opened(e):
        nonlocal here
        every.append(e)
        if e.tag in SECTIONS:
            sections[e.tag] += 1
        else:
            e.room[e.tag] += 1
            if e.tag not in BOXES:
                e.box[e.tag] += 1
        here = e

    def closed(last):
        """Ends the open elements up to `last`."""
        nonlocal here
        while True:
            e, here = here, here.parent
            if e.tag in SECTIONS:
                sections[e.tag] -= 1
            else:
                e.room[e.tag] -= 1
                if e.tag not in BOXES:
                    e.box[e.tag] -= 1
            if e is last:
                return

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(m[1])
            continue
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), m[2]
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            if closing and here.tag == tag:  # an inline element that was opened as a block
                end_block()
                if here is not root:
                    closed(here)
            elif not closing and ("class" in m[4] or "id" in m[4]):
                e = _Element(tag, here, m[4])
                if e.names & BOILER_NAMES:
                    end_block()
                    opened(e)
            continue
        if tag == "br" or tag in VOID:
            held.append(" ")
            if tag == "hr":
                end_block()
            continue
        if tag in RAW and not closing:
            end_block() if tag != "title" else None
            if not m[4].rstrip().endswith("/"):
                # without an end tag, what follows the start tag is read as any other
                if tag == "head":
                    found = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(html, at)
                elif tag == "option":
                    found = _OPTION_END.search(html, at)
                else:
                    found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = found.end() if found else n if tag in TO_THE_END else at
            held.append(" ")
            continue
        end_block()
        in_link = 0
        if closing:
            # a stray end tag does not reach out of a section
            if (sections if tag in SECTIONS else here.room)[tag] > 0:
                e = here
                while e.tag != tag:
                    e = e.parent
                closed(e)
            heading = 0
            continue
        if tag in ("html", "body"):
            continue
        same = CLOSES.get(tag) or ({"p"} if tag not in INLINE else set())
        if any(here.box[t] > 0 for t in same):
            e = here
            while e.tag not in same:
                e = e.parent
            closed(e)
        e = _Element(tag, here, m[4])
        opened(e)
        heading = tag in HEADINGS
        e.heading = tag == "h1"
    end_block()
    for e in reversed(every):
        e.parent.chars += e.chars
        e.parent.heading |= e.heading
    return out


def _around(e: _Element, total: int) -> tuple[float, _Element]:
    """(what the elements around a block add, its innermost sectioning element)."""
    chain = []
    at = e
    while at is not None and at.mark is None:
        chain.append(at)
        at = at.parent
    for x in reversed(chain):
        x.mark = _mark(x, total)
    return e.mark


def _mark(e: _Element, total: int) -> tuple[float, _Element]:
    own = 0.0
    # holds most of the page, and its title or a name that says so
    wrapper = e.chars * 2 > total and (e.heading or bool(e.names & WRAPPER_NAMES))
    if e.tag in BOILER_TAGS:
        own += BOILER
    if e.role in BOILER_ROLES:
        own += BOILER
    if e.hidden:
        own += BOILER
    if e.names and not wrapper and e.parent:
        if e.names & BOILER_NAMES:
            own += NAMED_BOILER
        elif e.names & CONTENT_NAMES:
            own += NAMED_CONTENT
    section = e
    if e.parent:
        outer, outer_section = e.parent.mark
        if e.tag in ("article", "main") or e.role == "main":
            own += IN_ARTICLE if outer < IN_ARTICLE else 0.0
        elif e.tag == "header" and outer < IN_ARTICLE:
            own += PAGE_HEADER
        if e.tag not in SECTIONS and own > NAMED_BOILER:
            section = outer_section
        own = max(own + outer, 2 * BOILER)
    return own, section


def _distance(a: _Element, b: _Element) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def max_flow_side(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut: terminal capacities first
    cancel at their node, then shortest augmenting paths in level graphs carry the rest."""
    extra = [a - b for a, b in zip(source, sink, strict=True)]
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[float] = []
    for a, b, w in edges:
        head[a].append(len(to))
        to.append(b)
        cap.append(w)
        head[b].append(len(to))
        to.append(a)
        cap.append(w)
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(v for v in range(n) if extra[v] > tiny)
        for v in queue:
            level[v] = 0
        reached = False
        while queue:
            v = queue.popleft()
            if extra[v] < -tiny:
                reached = True
            for k in head[v]:
                if cap[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[v] + 1
                    queue.append(to[k])
        if not reached:
            return [x >= 0 for x in level]
        nxt = [0] * n
        for s in range(n):
            while level[s] == 0 and extra[s] > tiny:
                path, v = [], s
                while True:
                    if extra[v] < -tiny:
                        break
                    while nxt[v] < len(head[v]):
                        k = head[v][nxt[v]]
                        if cap[k] > tiny and level[to[k]] == level[v] + 1:
                            break
                        nxt[v] += 1
                    else:
                        if not path:
                            v = -1
                            break
                        k = path.pop()
                        v = to[k ^ 1]
                        nxt[v] += 1
                        continue
                    path.append(k)
                    v = to[k]
                if v < 0:
                    break
                f = min([extra[s], -extra[v], *[cap[k] for k in path]])
                extra[s] -= f
                extra[v] += f
                for k in path:
                    cap[k] -= f
                    cap[k ^ 1] += f


def labelled(html: str) -> list[tuple[_Block, bool]]:
    """The page's blocks, and whether each is content."""
    got = blocks(html)
    if not got:
        return []
    total = sum(len(b.text) for b in got)
    content, boiler, section = [], [], []
    for b in got:
        around, sec = _around(b.where, total)
        words = b.text.count(" ") + 1
        score = BIAS + WORDS * min(log1p(words), 4.0) + LINKS * b.links / len(b.text) + HEADING * b.heading + around
        content.append(log1p(exp(score)))  # what calling it boilerplate costs
        boiler.append(log1p(exp(-score)))
        section.append(sec)
    edges = []
    last_below: dict[int, int] = {}
    for k, b in enumerate(got):
        if k:
            w = SMOOTH * DECAY ** _distance(got[k - 1].where, b.where)
            edges.append((k - 1, k, w if section[k - 1] is section[k] else w * ACROSS))
        parent = id(b.where.parent or b.where)
        before = last_below.get(parent)
        if before is not None and before < k - 1 and section[before] is section[k]:
            edges.append((before, k, SMOOTH * DECAY**2))
        last_below[parent] = k
    return list(zip(got, max_flow_side(len(got), content, boiler, edges), strict=True))


def main_text(html: str | None) -> str:
    return " ".join(b.text for b, keep in labelled(html or "") if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""

    def run(batches):
        for rows, pages_ in text_chunks(batches, 2):
            got = [main_text((h or b"").decode()) for h in pages_]
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return only_columns(pages, ("page_id", "url", "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
