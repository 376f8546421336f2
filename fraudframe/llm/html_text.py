"""HTML main text by minimum-cut labelling.

A page becomes its text blocks in order, each with the elements around it.  A small classifier
turns them into two costs per block, for calling it boilerplate and for calling it content; they
are its capacities to the two terminals.  Neighbours in page order and neighbours under the same
parent element are tied by smoothness edges.  The minimum cut, found by max-flow, is the cheapest
labelling; blocks on the content side are joined by one line end each.

Blocks whose terminal difference outweighs all their edges have the same label in every minimum
cut; they are settled first and their edges become capacities of their neighbours, so the flow
only runs on what is left.

A form or a side name (class, id) costs a block less the more of the page's text it holds, so one around
the whole page costs nothing; an article or main element inside ends it, and ends any other side matter but
nav, aside, footer, comments and lists of related articles.

Blocks end at block-level tags; ``br`` is white space.  Character references are decoded and
white space within a block becomes one space.  Nothing else is dropped or cut.

Defined results: null and empty html give the empty text and 0; broken markup (unclosed elements,
comments or tags, stray ``<``) is read as far as it goes; a null id stays null; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict, deque
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Element classes.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
                   "menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript svg annotation annotation-xml iframe object canvas head title textarea select button".split())
RAW = frozenset("script style textarea title iframe noscript".split())
SIDE_TAGS = frozenset("nav header footer aside form menu dialog".split())
# Side matter that may hold articles of its own: an article or main element in it is not the page's.
CLOSED_TAGS = frozenset("nav aside footer".split())
CLOSED_ROLES = frozenset("navigation complementary contentinfo".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond discussion disqus".split())
CLOSED_WORDS = COMMENT_WORDS | frozenset("related recommended".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
SIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
                       "consent gdpr notice notification alert nav navbar navigation menu breadcrumb breadcrumbs header masthead "
                       "footer sidebar side rail related recommended share sharing social comment comments reply replies respond "
                       "discussion disqus subscribe subscription newsletter signup login form popup modal overlay widget "
                       "pagination pager toolbar copyright legal skip hidden".split())
# Names that an article also gives to parts of its own: there they cost by what the part links to.
OWN_WORDS = frozenset("header masthead banner legal share sharing social notice alert side rail form widget hidden copyright menu".split())
OWN_NAMES = frozenset("header legal copyright".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_WORDS = frozenset("article content post entry story main maincontent".split())
#: What may stand in a head; its end tag may be missing, and anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSED_BY = {"p": BLOCKS - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
             "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

# Costs of the classifier (log-odds) and weights of the smoothness edges.
SIDE, SIDE_IN_MAIN, IN_MAIN, OUT_OF_MAIN = 12.0, 12.0, 6.0, 4.0
PER_WORD, MOST_WORDS, LINKED, STOPPED = 0.08, 3.0, 4.0, 0.8
PRIOR = 1.0
NEXT, SIBLING = 0.6, 0.9

_TOKEN = re.compile(r"""<!--|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+)/?>"""
                    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>""")
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_STATE = re.compile(r"(?:has|with|without|no)[-_]", re.I)  # such a name says what is inside, not what it is
# Python reads no more than 4,300 digits, zeros included; a reference of 8 digits is beyond all characters.
_ZEROS, _BEYOND = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
_STOP = re.compile(r"[.!?…:;]")


@dataclass
class Element:
    tag: str
    number: int
    unseen: bool = False
    side: bool = False      # boilerplate by tag, role or comment block, itself or above
    soft: bool = False      # within a form or an element with a name of side matter
    wrapper: int = 0        # number of the nearest such element
    weak: bool = False      # that element is part of an article and may be its own
    closed: bool = False    # within side matter that an article or main element does not end
    main: bool = False      # within the main element
    side_in_main: bool = False
    inner: int = 0          # number of the nearest block-level element, itself included
    outer: int = 0          # and of the one around that


@dataclass
class Block:
    parent: int
    side: bool
    main: bool
    side_in_main: bool
    soft: bool
    wrapper: int
    weak: bool
    depth: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _names(attributes: str) -> tuple[set[str], set[str], set[str]]:
    """Lower-cased parts of class and id names, roles, and whole names."""
    words, roles, wholes = set(), set(), set()
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            roles.update(value.lower().split())
        else:
            for name in value.split():
                if not _STATE.match(name):
                    words.update(p.lower() for p in _PART.findall(name))
                    words.add(name.lower())
                    wholes.add(name.lower())
    return words, roles, wholes


class Page:
    """One pass over the markup: the text blocks with what is around them."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.has_main = False
        self.around: dict[int, int] = {}  # wrapper -> the next one around it
        self._open = [Element("", 0)]
        self._counts: Counter[str] = Counter()
        self._number, self._links, self._block = 0, 0, None
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            self._say(html[at:m.start() if m else n])
            if not m:
                break
            at = m.end()
            if m[0] == "<!--":
                end = html.find("-->", at)
                at = n if end < 0 else end + 3
                continue
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._close(tag)
                continue
            self._enter(tag, m[3] or m[6] or "")
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(html, at)
                at = end.start() if end else n
        self._end()

    def _say(self, text: str) -> None:
        if self._open[-1].tag == "head" and text.strip():
            self._close("head")
        top = self._open[-1]
        if not text or top.unseen:
            return
        if "&" in text:
            text = unescape(_BEYOND.sub("\ufffd", _ZEROS.sub("&#", text)))
        if self._block is None:
            if not text.strip():
                return
            self._block = Block(top.outer, top.side, top.main, top.side_in_main, top.soft, top.wrapper, top.weak, len(self._open))
        self._block.pieces.append(text)
        if self._links:
            self._block.linked += len(text.split())

    def _end(self) -> None:
        if self._block is not None:
            self._block.text = " ".join("".join(self._block.pieces).split())
            if self._block.text:
                self.blocks.append(self._block)
            self._block = None

    def _enter(self, tag: str, attributes: str) -> None:
        if self._open[-1].tag == "head" and tag not in IN_HEAD:
            self._close("head")
        if tag in BLOCKS:
            self._end()
            for old, by in CLOSED_BY.items():
                if tag in by and self._counts[old] and self._within(old):
                    self._close(old)
        elif tag == "br" and self._block is not None:
            self._block.pieces.append(" ")
        if tag in VOID:
            return
        above = self._open[-1]
        self._number += 1
        e = Element(tag, self._number, above.unseen or tag in UNSEEN, above.side, above.soft, above.wrapper, above.weak, above.closed,
                    above.main, above.side_in_main, above.inner, above.outer)
        if tag in BLOCKS:
            e.inner, e.outer = e.number, above.inner
        words, roles, wholes = _names(attributes) if attributes.strip() else (set(), set(), set())
        structural = tag not in ("html", "body", "article", "main")
        roled = structural and not SIDE_ROLES.isdisjoint(roles)
        named = structural and tag not in HEADINGS and not SIDE_WORDS.isdisjoint(words)
        found = SIDE_WORDS & words
        # Within an article: only such words, and none of them as a whole name but those of an article's own parts.
        own = named and above.main and found <= OWN_WORDS and SIDE_WORDS & wholes <= OWN_NAMES
        if (tag in SIDE_TAGS or roled or named) and not (above.main and tag == "header"):  # a header within the article is its own
            if (tag in SIDE_TAGS and tag != "form") or roled or not COMMENT_WORDS.isdisjoint(words):
                e.side, e.side_in_main = True, above.main
            else:  # a name or a form may be around the whole page; its cost follows its share of the text
                e.weak = own and tag not in SIDE_TAGS and (above.weak or not above.soft)
                e.soft, e.wrapper = True, e.number
                self.around[e.number] = above.wrapper
            e.closed = e.closed or tag in CLOSED_TAGS or not CLOSED_ROLES.isdisjoint(roles) or not CLOSED_WORDS.isdisjoint(words)
        elif tag in ("article", "main") or "main" in roles or "article" in roles:
            if not above.closed:
                e.side = e.soft = e.side_in_main = e.weak = False
                e.main = True
                self.has_main = True
        elif tag in BLOCKS and not MAIN_WORDS.isdisjoint(words):
            e.main = e.main or not (above.side or above.soft)
            self.has_main = self.has_main or e.main
        self._open.append(e)
        self._counts[tag] += 1
        self._links += tag == "a"

    def _within(self, tag: str) -> bool:
        """Whether the open ``tag`` has only inline or closable elements above it."""
        for e in reversed(self._open):
            if e.tag == tag:
                return True
            if e.tag in BLOCKS and e.tag not in CLOSED_BY:
                return False
        return False

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end()
        if not self._counts[tag]:
            return
        while True:
            e = self._open.pop()
            self._counts[e.tag] -= 1
            self._links -= e.tag == "a"
            if e.tag == tag:
                return


def costs(page: Page) -> list[tuple[float, float]]:
    """(capacity to content, capacity to boilerplate) per block."""
    out, held, linked, total = [], Counter(), Counter(), 0
    for b in page.blocks:
        words = len(b.text.split())
        total += words
        held[b.wrapper] += words
        linked[b.wrapper] += b.linked
    for w in sorted(page.around, reverse=True):  # what is inside has the higher number
        if page.around[w]:
            held[page.around[w]] += held[w]
            linked[page.around[w]] += linked[w]
    for b in page.blocks:
        words = len(b.text.split())
        content = PRIOR + min(MOST_WORDS, PER_WORD * words) + STOPPED * bool(_STOP.search(b.text))
        boiler = PRIOR + LINKED * min(1.0, b.linked / words)
        share = held[b.wrapper] / total if b.soft and not b.side and not b.weak else 1.0
        if b.side:
            boiler += SIDE_IN_MAIN if b.side_in_main else SIDE
        elif b.soft and b.weak:
            boiler += SIDE * min(1.0, linked[b.wrapper] / held[b.wrapper])
        else:
            boiler += SIDE * (1.0 - share)
        if b.main and not b.side:
            content += IN_MAIN * share
            boiler += OUT_OF_MAIN * (1.0 - share)
        elif page.has_main:
            boiler += OUT_OF_MAIN
        out.append((content, boiler))
    return out


def edges(page: Page) -> dict[tuple[int, int], float]:
    """Smoothness between blocks next to each other in the page and under the same parent."""
    out: dict[tuple[int, int], float] = defaultdict(float)
    last: dict[int, int] = {}
    for i, b in enumerate(page.blocks):
        if i:
            apart = abs(b.depth - page.blocks[i - 1].depth)
            out[i - 1, i] += NEXT / (1 + apart)
        if b.parent in last:
            out[last[b.parent], i] += SIBLING
        last[b.parent] = i
    return out


def _max_flow_side(n: int, terminals: dict[int, tuple[float, float]], ties: dict[tuple[int, int], float]) -> set[int]:
    """Nodes on the source side of a minimum cut (blocking flows along shortest paths)."""
    source, sink = n, n + 1
    to, room, out = [], [], defaultdict(list)

    def edge(a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
    for v, (s, t) in terminals.items():
        edge(source, v, s, 0.0)
        edge(v, sink, t, 0.0)
    for (a, b), w in ties.items():
        edge(a, b, w, w)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if room[e] > 1e-9 and to[e] not in level:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if sink not in level:
            return set(level) - {source}
        turn, path, v = dict.fromkeys(level, 0), [], source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, v = [], source
            elif turn[v] < len(out[v]):
                e = out[v][turn[v]]
                if room[e] > 1e-9 and level.get(to[e]) == level[v] + 1:
                    path.append(e)
                    v = to[e]
                else:
                    turn[v] += 1
            elif path:
                e = path.pop()
                v = to[e ^ 1]
                turn[v] += 1
            else:
                break


def minimum_cut(terminals: list[tuple[float, float]], ties: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the content side."""
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for (a, b), w in ties.items():
        near[a][b] = near[b][a] = near[a].get(b, 0.0) + w
    lean = [c - b for c, b in terminals]
    label: dict[int, bool] = {}
    queue = deque(range(len(terminals)))
    while queue:
        v = queue.popleft()
        if v in label or abs(lean[v]) <= sum(near[v].values()):
            continue
        label[v] = lean[v] > 0
        for u, w in near.pop(v, {}).items():
            del near[u][v]
            lean[u] += w if label[v] else -w
            queue.append(u)
    rest = [v for v in range(len(terminals)) if v not in label]
    if rest:
        side = _max_flow_side(len(terminals), {v: (max(lean[v], 0.0), max(-lean[v], 0.0)) for v in rest},
                              {(a, b): w for a in rest for b, w in near[a].items() if a < b})
        label.update((v, v in side) for v in rest)
    return [label[v] for v in range(len(terminals))]


def main_text(html: str | None) -> str:
    page = Page(html or "")
    keep = minimum_cut(costs(page), edges(page))
    return "\n".join(b.text for b, k in zip(page.blocks, keep) if k)


def extracted(html: Column) -> Column:
    @F.pandas_udf("string")
    def page_text(s: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in s], dtype=object)
    return page_text(html)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the ``keep`` columns, text, n_chars."""
    out = small_batches(pages).select(*keep, extracted(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
