"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks in page order. A block has a cost of being content and a
cost of being boilerplate, from the elements around it, their class and id names, its
length and the share of its text in links. The costs are the capacities of its edges to the
two terminals. Neighbours in page order, and blocks whose paths in the element tree share
much, are tied by smoothness edges. The maximum flow's cut gives the labelling of least
total cost; blocks left with the source are content.

Elements that are never main text (scripts, styles, forms, navigation and the like) have a
terminal edge that no cut severs. Pages without text, null and empty pages give "". Broken
markup is read as far as it goes: unclosed elements end with the element around them, a head
at the first element or text that can't stand in it, a list of choices at the next block,
and a tag that the document's end cuts off is text. Rows that repeat a page_id stay
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_columns

# Elements of the HTML standard by the way they carry text.
HIDDEN = frozenset(
    "script style template noscript head title iframe object canvas audio video select option textarea datalist "
    "annotation annotation-xml desc metadata defs symbol".split()
)
#: Elements that leave an open head open.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements that a block ends, and blocks that may stand in them.
CHOICES, IN_CHOICES = frozenset("select option optgroup datalist".split()), frozenset("hr legend button".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Boilerplate wherever they stand.
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Elements that an opening tag ends, if they are the innermost open block.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Words in class, id and role that mark boilerplate, and main text.
AWAY = re.compile(
    r"(?:^|[\W_])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"overlay|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side|rail|aside|complementary|header|masthead|topbar|toolbar|footer|foot|colophon|contentinfo|"
    r"copyright|legal|disclaimer|comments?|commentlist|disqus|discussion|respond|replies|reply|reviews?|share|sharing|social|follow|related|recommend(?:ed|ations)?|"
    r"popular|trending|newsletter|subscribe|subscription|signup|login|search|widget|tags?|tagcloud|pagination|pager|skip|teaser|outbrain|taboola)(?:$|[\W_])"
)
TOWARDS = re.compile(r"(?:^|[\W_])(?:article|articlebody|content|main|post|entry|story|body|text|page)(?:$|[\W_])")

_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

FIRM = 1000
#: Smoothness between neighbours in page order, by what their paths share.
SAME_PARENT, NEAR, FAR = 3, 1, 0


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    tag: str
    linked: int
    outside: bool
    away: bool
    article: bool
    towards: bool


class Reader(HTMLParser):
    """Text blocks with the elements around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, list[str]]] = []
        self.deep = {"outside": 0, "away": 0, "article": 0, "towards": 0}
        self.count = 0
        self.parts: list[str] = []
        self.linked = 0
        self.hidden = 0
        self.links = 0

    def _flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            blocks = [e for e in self.stack if e[0] in BLOCKS]
            deep = self.deep
            self.blocks.append(Block(
                text, tuple(e[1] for e in blocks), blocks[-1][0] if blocks else "body", self.linked,
                deep["outside"] > 0, deep["away"] > 0, deep["article"] > 0, deep["towards"] > 0,
            ))
        self.parts, self.linked = [], 0

    def _close(self, at: int) -> None:
        for tag, _, flags in self.stack[at:]:
            for flag in flags:
                self.deep[flag] -= 1
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.stack[at:]

    def updatepos(self, i, j):
        return j  # line numbers aren't asked for

    def _end_hidden(self, tag: str) -> None:
        """Close what is open and can't hold this tag: a head, and choices."""
        names = [e[0] for e in self.stack]
        if "template" in names:
            return
        inner = [n for n in names if n in HIDDEN]
        # A noscript keeps its own elements; only body ends a head around it.
        if "head" in inner and tag not in IN_HEAD and (tag == "body" or inner[-1] in ("head", "title")):
            self._close(names.index("head"))
        elif inner[-1] in CHOICES and tag in BLOCKS and tag not in IN_CHOICES:
            at = len(names)
            while at and (names[at - 1] in CHOICES or names[at - 1] not in BLOCKS and any(n in CHOICES for n in names[:at])):
                at -= 1
            self._close(at)

    def handle_starttag(self, tag, attrs):
        if self.hidden > 0:
            self._end_hidden(tag)
        if tag in BLOCKS:
            self._flush()
            for ended in range(len(self.stack) - 1, -1, -1):
                name = self.stack[ended][0]
                if name in CLOSES.get(tag, ()) or name == "p":
                    self._close(ended)
                elif name in BLOCKS:
                    break
        elif tag in ("br", "text"):
            self.parts.append(" ")
        if tag in VOID:
            return
        flags, deep = [], self.deep
        inside = deep["article"] > 0
        if tag in OUTSIDE or tag == "header" and not inside:
            flags.append("outside")
        said = ""
        if attrs:
            names = {k: (v or "").lower() for k, v in attrs}
            said = " ".join(names.get(k, "") for k in ("class", "id", "role"))
            if tag not in ("html", "body", "article", "main"):
                hidden = "hidden" in names or names.get("aria-hidden") == "true" or _UNSEEN.search(names.get("style", ""))
                if hidden or not said.isspace() and AWAY.search(said) and not (tag in HEADINGS or tag == "header" and inside):
                    flags.append("away")
        if tag in ("article", "main") and not deep["away"] and not deep["outside"]:
            flags.append("article")
        elif said and "away" not in flags and TOWARDS.search(said):
            flags.append("towards")
        for flag in flags:
            deep[flag] += 1
        self.count += 1
        self.stack.append((tag, self.count, flags))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name == tag:
                self._close(at)
                return
            # An inline end tag doesn't reach beyond its block.
            if name in BLOCKS and tag not in BLOCKS:
                return

    def handle_data(self, data):
        if self.hidden == 1 and self.stack[-1][0] == "head" and not data.isspace():
            self._close(len(self.stack) - 1)
        if self.hidden <= 0:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def close(self):
        super().close()
        self._flush()


def costs(block: Block, marked: bool) -> tuple[int, int]:
    """(cost of being boilerplate, cost of being content); `marked`: the page has an article."""
    if block.outside:
        return 0, FIRM
    words = block.text.count(" ") + 1
    content = 2 if marked and not block.article else 6
    boiler = 8 if marked and not block.article else 2
    content += min(8, words // 8) + (2 if block.tag in HEADINGS else 0)
    if block.article:
        content += 20
    elif block.towards:
        content += 6
    if block.away:
        boiler += 60
    if not block.article:
        boiler += round(12 * block.linked / max(1, len(block.text)))
    return content, boiler


def ties(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, capacity): neighbours in order, and neighbours under one parent."""
    out = []
    last: dict[tuple[int, ...], int] = {}
    for i, block in enumerate(blocks):
        if i:
            common = 0
            for a, b in zip(block.path[:-1], blocks[i - 1].path[:-1]):
                if a != b:
                    break
                common += 1
            deep = max(len(block.path), len(blocks[i - 1].path)) - 1
            out.append((i - 1, i, SAME_PARENT if common == deep else NEAR if deep - common == 1 else FAR))
        before = last.get(block.path[:-1])
        if before is not None and before != i - 1:
            out.append((before, i, SAME_PARENT))
        last[block.path[:-1]] = i
    return [t for t in out if t[2]]


class Network:
    """Maximum flow by shortest augmenting levels."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def tie(self, a: int, b: int, there: int, back: int) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [there, back]

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            node = queue.popleft()
            for e in self.out[node]:
                if self.room[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[node] + 1
                    queue.append(self.to[e])
        return level

    def cut(self, source: int, sink: int) -> list[bool]:
        """Whether each node stays with the source once the flow is greatest."""
        while (level := self._levels(source))[sink] >= 0:
            turn = [0] * len(self.out)
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    full = next(i for i, e in enumerate(path) if self.room[e] == 0)
                    node = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                while turn[node] < len(self.out[node]):
                    e = self.out[node][turn[node]]
                    if self.room[e] > 0 and level[self.to[e]] == level[node] + 1:
                        break
                    turn[node] += 1
                else:
                    if node == source:
                        break
                    e = path.pop()
                    node = self.to[e ^ 1]
                    turn[node] += 1
                    continue
                path.append(e)
                node = self.to[e]
        return [x >= 0 for x in level]


def label(blocks: list[Block]) -> list[bool]:
    """Whether each block is content, at the least total cost."""
    n = len(blocks)
    net = Network(n + 2)
    marked = any(b.article for b in blocks)
    for i, block in enumerate(blocks):
        content, boiler = costs(block, marked)
        net.tie(n, i, content, 0)
        net.tie(i, n + 1, boiler, 0)
    for i, j, room in ties(blocks):
        net.tie(i, j, room, room)
    return net.cut(n, n + 1)[:n]


def main_text(html: str | None) -> str:
    """Content blocks of a page, joined by an empty line."""
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    reader.close()
    return "\n\n".join(b.text for b, good in zip(reader.blocks, label(reader.blocks)) if good)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batch: pa.RecordBatch) -> list:
        texts = [main_text(h) for h in batch.column(0).to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return arrow_columns(named, ["html"], out, run).drop("html")
