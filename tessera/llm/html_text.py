"""Main text of web pages: minimum-cut labelling of blocks.

A page is cut into blocks of running text (paragraphs, headings, list items, cells and so on). A classifier gives each
block the cost of calling it content or boilerplate; the costs are the capacities to the two terminals of a graph, and
edges between blocks that follow one another, weighted by how near they stand in the tree, make unlike labels of near
blocks dear. The minimum cut (by maximum flow) is the labelling of least total cost.

The classifier is a logistic regression on features of the block (text, links, tags and names around it). It is trained
here on pages made up from words of the page's own kinds of regions, whose labels are thus known.

Defined cases: null and empty pages have an empty text; a page without content blocks has an empty text; long pages are
read whole; repeated rows are each extracted; an empty table gives an empty table; other columns pass through, save those
named as a result column.
"""

import math
import re
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, REST, TEXT, ddl, pack, unpack, worker_cache

#: Elements that stand in a line of text; every other element begins a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
SILENT = frozenset("script style noscript template svg math head iframe object canvas select textarea button audio video map".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
#: An open element of the first kind ends where one of the second begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
#: Words in class, id and role that tell of a region.
BAD_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer header masthead menu modal nav navbar navigation newsletter"
    " notice pager pagination popup promo promoted related reply replies respond sidebar share sharing signup skip social sponsor sponsored subscribe tags toolbar topbar widget alert login search".split()
)
GOOD_NAMES = frozenset("article body content entry main post story text".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")


class Block:
    """A block's text, the share of it that is linked, what its open elements tell, and the element it stands in."""

    __slots__ = ("bad", "good", "heading", "hidden", "linked", "place", "text")

    def __init__(self, text, linked, place, bad, good, hidden, heading):
        self.text, self.linked, self.place, self.bad, self.good, self.hidden, self.heading = text, linked, place, bad, good, hidden, heading


class Place:
    """An open element that begins blocks, linked to the one around it; far is a place some way up, as in a skip list, so
    that the depth at which two places part is found in few steps."""

    __slots__ = ("depth", "far", "up")

    def __init__(self, up):
        self.up = up
        self.depth = up.depth + 1 if up else 0
        self.far = up if up is None or up.far is None or up.depth - up.far.depth != (up.far.depth - up.far.far.depth if up.far.far else -1) else up.far.far


def shared_depth(a: Place, b: Place) -> int:
    """How many elements below the page two places have in common."""
    if a.depth < b.depth:
        a, b = b, a
    while a.depth > b.depth:
        a = a.far if a.far and a.far.depth >= b.depth else a.up
    while a is not b:
        a, b = (a.far, b.far) if a.far is not b.far else (a.up, b.up)
    return a.depth


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _signs(tag: str, attrs: str) -> tuple[int, int, bool]:
    """(bad signs, good signs, hidden) of an element."""
    bad, good, hidden = int(tag in BAD_TAGS), int(tag in GOOD_TAGS), False
    if attrs and attrs.strip():
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                names = set(_NAME.findall(value))
                bad += bool(names & BAD_NAMES)
                good += bool(names & GOOD_NAMES) and not names & BAD_NAMES
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
    if tag == "header":
        bad += 1
    return bad, good, hidden


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order; character references decoded, white space made single spaces."""
    out: list[Block] = []
    stack: list[str] = []
    parts: list[str] = []
    linked = silent = at = links = 0
    # for each open element: the place it makes or stands in; bad and good signs, whether hidden or a heading, so far
    places, told = [Place(None)], [(0, 0, False, False)]
    opened: dict[str, list[int]] = {}
    walls: list[int] = []  # open elements that begin blocks

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, min(1.0, linked / len(text)), places[-1], *told[-1]))
            parts.clear()
        linked = 0

    def close(upto: int):
        nonlocal silent, links
        while len(stack) > upto:
            tag = stack.pop()
            places.pop()
            told.pop()
            opened[tag].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
            silent -= tag in SILENT
            links -= tag == "a"

    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        end = m.start() if m else n
        if end > at and not silent:
            piece = html[at:end]
            parts.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[1]:
            continue
        tag = m[1].lower()
        if m[0][1] == "/":
            if tag not in INLINE:
                flush()
            if opened.get(tag):
                k = opened[tag][-1]
                # an inline end tag does not reach out of its block
                if tag not in INLINE or places[k + 1] is places[-1]:
                    close(k)
            continue
        if tag not in INLINE:
            flush()
            if tag in PARAGRAPH_ENDS or tag in CLOSES:
                for k in reversed(walls):
                    open_ = stack[k]
                    if tag in PARAGRAPH_ENDS and open_ == "p" or open_ in CLOSES.get(tag, ()):
                        close(k)
                        break
                    if not (open_ == "p" or tag == "tr" and open_ in ("td", "th")):
                        break
        if tag in VOID or m[0].endswith("/>") and tag not in RAW and tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        if tag in RAW:  # its content is no markup
            e = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = e.end() if e else n
            continue
        bad, good, hidden = _signs(tag, m[2])
        before = told[-1]
        told.append((before[0] + bad, before[1] + good, before[2] or hidden, before[3] or tag in HEADINGS))
        places.append(places[-1] if tag in INLINE else Place(places[-1]))
        opened.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            walls.append(len(stack))
        stack.append(tag)
        silent += tag in SILENT
        links += tag == "a"
    flush()
    return out


FEATURES = ("one", "words", "short", "linked", "marks", "bad", "good", "hidden", "heading", "within", "rights")


def features(b: Block) -> list[float]:
    words = b.text.count(" ") + 1
    return [
        1.0, math.log1p(words) / 4, float(words < 4), b.linked, float(b.text[-1] in ".!?…:;\"”»"), min(b.bad, 2) / 1.0, float(b.good > 0), float(b.hidden), float(b.heading),
        float(b.good > 0 and b.bad == 0), float(b.text[0] == "\u00a9"),
    ]


def content_cost(b: Block, weights) -> float:
    """The log-odds of boilerplate: positive if the classifier would drop the block."""
    return -sum(w * x for w, x in zip(weights, features(b)))


def nearness(a: Block, b: Block) -> float:
    """Weight of the edge between blocks that follow one another: larger, the more of their elements they share."""
    apart = a.place.depth + b.place.depth - 2 * shared_depth(a.place, b.place)
    return 1.2 / (1 + max(0, apart - 1))


class Flow:
    """Maximum flow by shortest augmenting paths in levels, over an adjacency list."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [there, back]

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[s], queue = 0, [s]
        for x in queue:
            for e in self.edges[x]:
                if self.room[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def run(self, s: int, t: int) -> float:
        total = 0.0
        while (level := self.levels(s))[t] >= 0:
            turn = [0] * len(self.edges)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    least = min(self.room[e] for e in path)
                    total += least
                    for k, e in enumerate(path):
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    k = next(k for k, e in enumerate(path) if self.room[e] <= 1e-12)
                    x = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while turn[x] < len(self.edges[x]):
                    e = self.edges[x][turn[x]]
                    if self.room[e] > 1e-12 and level[self.to[e]] == level[x] + 1:
                        break
                    turn[x] += 1
                if turn[x] < len(self.edges[x]):
                    e = self.edges[x][turn[x]]
                    path.append(e)
                    x = self.to[e]
                elif path:
                    e = path.pop()
                    x = self.to[e ^ 1]
                    turn[x] += 1
                else:
                    break
        return total


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for content: the labelling of least cost, where costs[i] > 0 is the cost of keeping block i, and -costs[i]
    that of dropping it otherwise, and an edge costs its weight where its ends differ."""
    n = len(costs)
    flow = Flow(n + 2)
    for i, c in enumerate(costs):
        if c > 0:
            flow.add(i, n + 1, c)  # cut if i is kept: on the source's side
        elif c < 0:
            flow.add(n, i, -c)
    for a, b, w in edges:
        flow.add(a, b, w, w)
    flow.run(n, n + 1)
    level = flow.levels(n)
    return [level[i] >= 0 for i in range(n)]


def label(blocks: list[Block], weights) -> list[bool]:
    costs = [max(-8.0, min(8.0, content_cost(b, weights))) for b in blocks]
    for i, b in enumerate(blocks):
        if b.hidden:
            costs[i] = 1e6
    edges = [(i, i + 1, nearness(blocks[i], blocks[i + 1])) for i in range(len(blocks) - 1)]
    # blocks under one parent, though others stand between
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        around = id(b.place.up)  # blocks hold their places, so that the number stays the place's own
        j = last.get(around)
        if j is not None and j < i - 1:
            edges.append((j, i, 0.6))
        last[around] = i
    # where all costs agree there is nothing to cut
    if all(c > 0 for c in costs) or all(c <= 0 for c in costs):
        return [c <= 0 for c in costs]
    return minimum_cut(costs, edges)


def main_text(html: str | None, weights) -> str:
    blocks = blocks_of(html or "")
    return "\n\n".join(b.text for b, kept in zip(blocks, label(blocks, weights)) if kept) if blocks else ""


def _made_up(rng) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks, whether it is content."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    truth: list[bool] = []

    def block(tag, text, content, attrs=""):
        truth.append(content)
        return f"<{tag}{attrs}>{text}</{tag}>"

    def links(n):
        return "<ul>" + "".join(block("li", f'<a href="/{word()}">{say(1, 4)}</a>', False) for _ in range(n)) + "</ul>"

    bare = rng.random() < 0.15  # a page without telling names

    def named(names):
        return "" if bare else f' {rng.choice(["class", "id"])}="{rng.choice(names)}"'

    out = ""
    wrap = rng.random()
    if rng.random() < 0.8:
        out += f"<nav>{links(rng.randrange(2, 7))}</nav>" if rng.random() < 0.6 and not bare else f'<div{named(["menu", "navbar", "top-nav"])}>{links(rng.randrange(2, 7))}</div>'
    if rng.random() < 0.5 and not bare:
        out += block("div", say(4, 12) + ".", False, named(["ad", "banner", "cookie-notice", "promo"]))
    if rng.random() < 0.3:
        out += f"<header>{block('p', say(2, 8), False)}</header>"
    body = block("h1", say(2, 9), True)
    for _ in range(rng.randrange(1, 9)):
        kind = rng.random()
        if kind < 0.72:
            body += block("p", f"{say(1, 60)}{rng.choice(['.', '.', '.', '!', ''])}" + (f' <a href="/x">{say(1, 3)}</a>.' if rng.random() < 0.2 else ""), True)
        elif kind < 0.82:
            body += block("h2", say(1, 6), True)
        elif kind < 0.9:
            body += "<ul>" + "".join(block("li", say(2, 12), True) for _ in range(rng.randrange(2, 5))) + "</ul>"
        else:
            body += block("div", say(3, 10) + "." if not bare else f'<a href="/x">{say(2, 6)}</a>', False, named(["ad", "sponsored", "share-box", "related"]))
    out += f"<div>{body}</div>" if bare else f"<article>{body}</article>" if wrap < 0.45 else f"<main>{body}</main>" if wrap < 0.6 else f'<div{named(["content", "post-body", "entry"])}>{body}</div>' if wrap < 0.8 else f"<div>{body}</div>"
    if rng.random() < 0.4:
        out += f"<aside>{block('p', say(3, 20) + '.', False)}{links(rng.randrange(1, 4))}</aside>" if rng.random() < 0.5 and not bare else f'<div{named(["sidebar", "widget"])}>{links(rng.randrange(2, 5))}{block("p", say(3, 15), False) if not bare else ""}</div>'
    if rng.random() < 0.4 and not bare:
        out += f'<div{named(["comments", "comment-list", "disqus"])}>' + "".join(block("p", say(3, 30) + ".", False) for _ in range(rng.randrange(1, 5))) + "</div>"
    if rng.random() < 0.3:
        out += f"<form>{block('p', say(2, 6), False)}<input></form>"
    if rng.random() < 0.85:
        out += block("footer" if not bare else "div", f"&copy; {say(2, 10)}.", False)
    return f"<html><head><title>{say(2, 5)}</title></head><body>{out}</body></html>", truth


@lru_cache
def train(pages: int = 500, seed: int = 11) -> list[float]:
    """Weights of the classifier: logistic regression over the blocks of made-up pages."""
    import random

    import numpy as np

    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        html, truth = _made_up(rng)
        blocks = blocks_of(html)
        if len(blocks) == len(truth):
            x += [features(b) for b in blocks]
            y += truth
    x, y = np.array(x), np.array(y, float)
    w, ridge = np.zeros(x.shape[1]), 0.3 * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return [float(v) for v in w]


def _extractor(weights):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h, weights.value) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], names=[ID, REST, "text"])

    return run


def extract_main_text(pages: DataFrame, weights: list[float] | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The columns of pages but for the html, and text."""
    base = pack(pages, id_col, html_col, ["text"])
    id_type, rest = ddl(base.schema[ID].dataType), ddl(base.schema[REST].dataType)
    sent = pages.sparkSession.sparkContext.broadcast(weights or train())
    made = base.mapInArrow(_extractor(sent), f"{ID} {id_type}, {REST} {rest}, text string")
    return unpack(made, pages.drop(html_col), id_col, html_col, {"text": F.col("text")})
