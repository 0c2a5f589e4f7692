"""Operator 8: main text of web pages by minimum-cut labelling of blocks.

A page is read into text blocks in page order, each with the chain of elements
around it. A logistic model of block features (element names and their class, id and
role words, links, length, sentence marks), fitted in html_costs, gives log odds,
the cost of calling the block the other thing: these are the capacities of its edges
to the two terminals. Neighbouring blocks are joined by smoothness edges, stronger
the more ancestors they share, and so are consecutive children of one container,
however far apart. The minimum cut (max-flow by shortest augmenting paths) labels
all blocks at once; the blocks on the content side are the text.

Scripts, styles, templates and hidden elements hold no text at all, and forms none
unless they hold half of the page's text or more (pages wrapped in a form).
Character references are decoded, runs of white space in a block become one space,
``<br>`` is such white space, and blocks are joined by a blank line.

Defined cases:

* null, empty and text-free pages give the empty text; a page without any markup is one block and is kept;
* unclosed, misnested and cut-off tags are read as far as they go: a tag that never ends is text up to the end of page
  only if no name follows its ``<``;
* pages of any length and depth are read whole, in time in proportion to their length;
* repeated rows and equal or null ids are extracted one by one; an empty table gives an empty result; other columns of the
  input are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html_costs import features, weights

#: A quote opens a value only behind "=", as in the HTML standard; one that never ends is a character of a value without quotes.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)|[^<]+|<""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPACE = re.compile(r"\s+")
#: Elements whose content is raw text up to their end tag, and those that hold no reading text.
RAW = frozenset("script style textarea xmp noembed noframes".split())
SILENT = frozenset("script style textarea xmp noembed noframes noscript template head title svg math iframe object canvas select option button input label datalist dialog audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an open p ends at, besides p itself.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Containers that speak for or against content, with what they add to the cost difference (positive: content).
CONTAINER = {"article": 6.0, "main": 4.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "header": -3.0, "menu": -9.0, "address": -2.0}
_BAD = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion|ted)?|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|footer|header|masthead|copyright|comments?|disqus|replies|reply|respond|share|sharing|social|related|recommend(?:ed|ations)?|widget|tags?|pagination|pager|toolbar|skip|login|search)(?:$|[-_\s\d])", re.IGNORECASE)
_GOOD = re.compile(r"(?:^|[-_\s])(?:article|post|entry|content|body|story|main|text|page-content)(?:$|[-_\s\d])", re.IGNORECASE)
_ROLES = {"navigation": -9.0, "banner": -9.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "dialog": -9.0, "alert": -9.0, "main": 4.0, "article": 6.0}
#: A form that holds this share of a page's text is a wrapper of the page; what smaller ones hold is not read.
WRAPPER = 0.5


class Element:
    """An open element, with what is known about the chain above it: its length and the strongest words for and against content."""

    __slots__ = ("name", "parent", "silent", "number", "depth", "good", "bad", "form")

    def __init__(self, name: str, parent: Element | None, cost: float = 0.0, silent: bool = False, number: int = 0):
        self.name, self.parent, self.silent, self.number = name, parent, silent, number
        self.depth = parent.depth + 1 if parent is not None else 1
        self.good = max(cost, parent.good if parent is not None else 0.0)
        self.bad = min(cost, parent.bad if parent is not None else 0.0)
        self.form = number if name == "form" else parent.form if parent is not None else 0


@dataclass
class Block:
    parent: Element
    #: Elements that the block and the one before it have around both.
    shared: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _cost(name: str, attrs: str) -> tuple[float, bool]:
    """What an element says for its blocks, and whether it hides them."""
    cost, hidden = CONTAINER.get(name, 0.0), name in SILENT
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", html.unescape(value))
                if _BAD.search(value) and name not in ("html", "body"):
                    cost -= 7.0
                elif _GOOD.search(value):
                    cost += 2.0
            elif key == "role":
                cost += _ROLES.get(value.lower(), 0.0)
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                hidden = True
    return cost, hidden


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, empty ones left out."""
    root = Element("", None)
    here, count, out, links = root, 0, [], 0
    # The least depth since the last block, and how many elements of a name are open.
    low, names = 0, {}
    current: Block | None = None
    raw: str | None = None
    at = 0

    def close() -> None:
        nonlocal current, low
        if current is not None:
            current.text = _SPACE.sub(" ", html.unescape("".join(current.parts))).strip()
            if current.text:
                out.append(current)
                low = current.parent.depth
            current = None

    def leave(x: Element) -> None:
        """Close the elements down to x, which stays open."""
        nonlocal here, low
        while here is not x:
            names[here.name] -= 1
            here = here.parent
        low = min(low, here.depth)

    while at < len(page):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at, raw = (end.start() if end else len(page)), None
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[2] is None:
            s = m[0]
            if s[0] == "<" and len(s) > 1:
                continue
            if here.silent:
                continue
            if current is None:
                if s.isspace():
                    continue
                box = _container(here)
                low = min(low, box.depth)
                current = Block(box, low)
            current.parts.append(s)
            if links:
                current.linked += len(s)
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name == "br":
                if current is not None:
                    current.parts.append(" ")
                continue
            x = here if names.get(name) else None
            while x is not None and x.name != name:
                # An inline end tag does not reach over a block.
                if name in INLINE and x.name not in INLINE:
                    x = None
                    break
                x = x.parent
            if x is not None and x.parent is not None:
                if name not in INLINE:
                    close()
                leave(x.parent)
            elif name not in INLINE:
                close()
            continue
        if name == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if name not in INLINE:
            close()
            links = 0
            if name in ENDS_P:
                x = here
                while x is not None and (x.name in INLINE or x.name == "p"):
                    if x.name == "p":
                        leave(x.parent)
                        break
                    x = x.parent
                if name != "p":
                    leave(_container(here))
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]
                x = here
                while x is not None and (x.name in INLINE or x.name == "p" or x.name in same):
                    if x.name in same:
                        leave(x.parent)
                    x = x.parent
        if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
            continue
        cost, hidden = _cost(name, m[3])
        count += 1
        names[name] = names.get(name, 0) + 1
        here = Element(name, here, cost, here.silent or hidden, count)
        if name == "a":
            links += 1
        if name in RAW:
            raw = name
    close()
    return _without_forms(out)


def _without_forms(blocks: list[Block]) -> list[Block]:
    """The blocks but for those of forms that hold less than WRAPPER of the text; an inner form stands for itself."""
    size: dict[int, int] = {}
    for b in blocks:
        size[b.parent.form] = size.get(b.parent.form, 0) + len(b.text)
    least = WRAPPER * sum(size.values())
    small = {f for f, n in size.items() if f and n < least}
    out: list[Block] = []
    low = 0
    for b in blocks:
        low = min(low, b.shared)
        if b.parent.form not in small:
            b.shared = low if out else 0
            out.append(b)
            low = b.parent.depth
    return out


def _container(x: Element) -> Element:
    while x.name in INLINE and x.parent is not None:
        x = x.parent
    return x


def block_features(block: Block) -> np.ndarray:
    return features(block.parent.name, block.parent.good, block.parent.bad, block.text, block.linked)


def block_costs(block: Block, w: np.ndarray) -> tuple[float, float]:
    """Capacities to the content and to the boilerplate terminal: what it costs to call the block the other thing, as log odds."""
    score = float(block_features(block) @ w)
    return max(score, 0.0), max(-score, 0.0)


def max_flow(n: int, edges: list[tuple[int, int, float, float]], source: int, sink: int) -> list[bool]:
    """Which of n nodes are on the source side of a minimum cut; edges are (a, b, capacity, capacity back)."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c, back in edges:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to += [b, a]
        room += [c, back]
    while True:
        # Levels by breadth-first search, then blocking flow along them (Dinic).
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        at, path = [0] * n, []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                first = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[first] ^ 1]
                del path[first:]
            while at[a] < len(graph[a]):
                e = graph[a][at[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(graph[a]):
                path.append(graph[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def label(blocks: list[Block], w: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    n = len(blocks)
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        content, boiler = block_costs(b, w)
        edges.append((n, i, content, 0.0))
        edges.append((i, n + 1, boiler, 0.0))
        if i:
            near = b.shared / max(b.parent.depth + blocks[i - 1].parent.depth - b.shared, 1)
            edges.append((i - 1, i, 0.15 + 1.2 * near, 0.15 + 1.2 * near))
        # The block before this one in the same container, wherever it is.
        p = b.parent.parent.number if b.parent.parent is not None else -1
        j = last.get(p)
        if j is not None and j < i - 1:
            edges.append((j, i, 0.8, 0.8))
        last[p] = i
    return max_flow(n + 2, edges, n, n + 1)[:n]


def main_text(page: str | None, w: np.ndarray | None = None) -> str:
    """The text of the blocks that the cut leaves on the content side, under the fitted weights unless others are given."""
    blocks = blocks_of(page or "")
    if len(blocks) == 1 and blocks[0].parent.parent is None:
        return blocks[0].text
    w = np.array(weights()) if w is None else w
    return "\n\n".join(b.text for b, keep in zip(blocks, label(blocks, w), strict=True) if keep) if blocks else ""


def _extracted(fitted: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(fitted)
        for batch in batches:
            text = [main_text(x.as_py(), w) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages(page_id, url, html)."""
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(_extracted(weights()), "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
