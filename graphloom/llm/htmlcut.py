"""Main text of HTML pages by a minimum cut between content and boilerplate.

A page is split into blocks of text. A linear classifier over a block's text and its DOM ancestors gives what it costs to call it
boilerplate or content; these costs are the capacities of its edges from the source and to the sink. Blocks that follow each
other and blocks that are near in the DOM are joined by smoothness edges, weaker the longer the way between them in the tree.
Blocks on the source side of a minimum cut are the content.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm._common import small_batches

# Names of HTML elements by their role.
HIDDEN = frozenset("script style template noscript noembed noframes head title svg math iframe object audio video canvas textarea select datalist".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Of these, those that some pages wrap all their text in, or forget to close.
WRAPPERS = frozenset("form fieldset button dialog".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial alert banner banners breadcrumb breadcrumbs byline consent cookie cookies copyright disclaimer dropdown footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related search share sharing sidebar sidenav signin signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar tracking widget widgets".split()
)
REMARK_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
REMARK_NAMES = frozenset("discussion reply".split())
#: A class that begins so tells a state of the page, not what the element is.
STATES = frozenset("has is with without no not js can".split())
CONTENT_WORDS = frozenset("article articlebody content entry maincontent post postbody story text".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Start tags that may stand in a head; any other, and text, ends an open one.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: An open element of the second set is closed by a start tag of the first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: A name and its value, which may hold anything; a quote that is not closed reaches to the end.
ATTRIBUTE = re.compile(r"([^\s/][^\s/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]\S*)))?")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: White space of HTML.
BLANKS = " \t\n\f\r"

#: Capacities: a sure call, a clear sign, what only a class or id says, and smoothness between neighbours.
SURE, CLEAR, NAMED, SMOOTH = 12.0, 4.0, 2.5, 1.5
#: What a class or id says on a page that has no content otherwise.
DOUBTED = 1.0
#: That nothing marks a block as boilerplate speaks for content: lists, tables and short paragraphs stand outside of articles too.
UNMARKED = 2.5
#: A wrapper that holds more than this part of a page's text outside links is none.
WRAPPED = 0.5


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    depth: int
    #: What the element itself says: 1 content, -1 boilerplate, -2 boilerplate whatever is within, 0 nothing.
    own: int
    hidden: bool
    #: Characters of text outside links, of wrappers only.
    size: int = 0
    #: Of the node and its ancestors, set after the page is read.
    sign: int = 0


@dataclass
class Block:
    node: Node
    text: str
    links: int
    heading: bool = field(default=False)


def _named(value: str) -> int:
    """What a class or an id says: 1 content, -1 boilerplate, -2 remarks of readers, 0 nothing, or both."""
    content = boiler = False
    for name in value.split():
        words = [w.lower() for w in PARTS.findall(name)]
        if not words or words[0] in STATES:
            continue
        if not REMARK_WORDS.isdisjoint(words) or words[-1] in REMARK_NAMES:
            return -2
        about = not CONTENT_WORDS.isdisjoint(words)
        # The head of an article is a part of it; other parts are named by what they are, or what they are of.
        if words[-1] == "header" and about:
            continue
        if words[-1] in BOILER_WORDS or words[0] in BOILER_WORDS:
            boiler = True
        elif about:
            content = True
    return content - boiler


def _says(tag: str, attributes: str) -> tuple[int, bool]:
    """What an element itself says (-3: a header, see _resolve), and whether it is hidden."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        found.setdefault(name.lower(), a or b or c)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    role = found.get("role", "").lower()
    if tag in BOILER_TAGS or role in BOILER_ROLES:
        return -2, hidden
    if tag in ("body", "html"):
        return 0, hidden
    says = [_named(found[k]) for k in ("class", "id", "itemprop") if k in found]
    if -2 in says:
        return -2, hidden
    named = max(-1, min(1, sum(says)))
    if tag in CONTENT_TAGS or role in ("main", "article"):
        return 1, hidden
    if tag == "header" and named <= 0:
        return -3, hidden
    return named, hidden


def _resolve(nodes: list[Node], total: int) -> None:
    """Set the sign of each node, which stand after their parents: what is within boilerplate is so, else the nearest that says
    something tells."""
    for n in nodes:
        own = n.own
        if own == -2 and n.tag in WRAPPERS and n.size > WRAPPED * total:
            own = 0
        if own == -3:  # the header of an article is a part of it, that of a page is not
            own = 0 if n.parent.sign == 1 else -2
        n.sign = -2 if n.parent.sign == -2 else own or n.parent.sign


def out_of_head(node: Node, whole: bool) -> Node:
    """The parent of node if that is a head, or if `whole`, of the head that node is in; else node."""
    up = node
    while whole and up and up.tag != "head":
        up = up.parent
    return up.parent if up and up.tag == "head" else node


def blocks(html: str) -> list[Block]:
    """The visible blocks of text of a page in order, character references decoded, white space made single."""
    node = root = Node("", None, 0, 0, False)
    nodes: list[Node] = []
    out: list[Block] = []
    pieces: list[str] = []
    at, end, links, in_link, total = 0, len(html), 0, False, 0

    #: Open wrappers.
    wrappers: list[Node] = []

    def flush() -> None:
        nonlocal pieces, links, total
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(node, text, links, node.tag in HEADINGS))
                plain = max(0, len(text) - links)
                total += plain
                for up in wrappers:
                    up.size += plain
            pieces, links = [], 0

    def say(raw: str) -> None:
        nonlocal links, node
        if node.tag == "head" and raw.strip(BLANKS):
            node = node.parent
        if node.hidden or not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            links += len(text)

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        m = TOKEN.match(html, lt)
        if not m:
            if html.startswith("/", lt + 1):
                at = html.find(">", lt) + 1 or end  # an end tag without a name is a comment up to its ">"
            elif html[lt + 1 : lt + 2].isascii() and html[lt + 1 : lt + 2].isalpha():
                at = end  # a tag that the page's end cuts off: no ">" follows
            else:
                say("<")
                at = lt + 1
            continue
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag or at == end and html[end - 1] != ">":
            continue
        tag = tag.lower()
        if not close and tag not in IN_HEAD:
            node = out_of_head(node, tag == "body")
        if tag == "a":
            # An anchor without a target is no link, and a second start tag ends the first.
            in_link = not close and any(name.lower() == "href" for name, *_ in ATTRIBUTE.findall(attributes))
        if tag == "br":
            pieces.append(" ")
        if tag in BREAKS:
            flush()
        elif tag not in HIDDEN:
            continue
        if close:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
                while wrappers and wrappers[-1].depth > node.depth:
                    wrappers.pop()
            continue
        if tag in VOID:
            continue
        if tag in RAW and tag in HIDDEN:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if tag in BREAKS and node.tag == "p":
            node = node.parent
        while node.tag in CLOSES.get(tag, ()):
            node = node.parent
        while wrappers and wrappers[-1].depth > node.depth:
            wrappers.pop()
        own, hidden = _says(tag, attributes)
        node = Node(tag, node, node.depth + 1, own, node.hidden or hidden or tag in HIDDEN)
        nodes.append(node)
        if tag in WRAPPERS:
            wrappers.append(node)
    flush()
    _resolve(nodes, total)
    return out


def score(b: Block, named: float = NAMED) -> float:
    """How much more it costs to call a block boilerplate than content."""
    sign = b.node.sign
    if sign == -2:
        return -SURE
    words, size = b.text.count(" ") + 1, len(b.text)
    s = min(words, 40) / 20 - 1 - CLEAR * min(1.0, b.links / size)
    s += 0.8 if b.text[-1] in ".!?…\"”»" else 0.0
    s += {"p": 0.8, "blockquote": 0.5, "pre": 0.8, "li": -0.3, "td": -0.5, "th": -0.5}.get(b.node.tag, 0.3 if b.heading else 0.0)
    return s + (CLEAR + 2 if sign == 1 else -named if sign == -1 else UNMARKED)


def distance(a: Node, b: Node) -> int:
    """Steps between two nodes of the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block to the one before it, and to the last before it under its parent and grandparent."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        near = {i - 1} if i else set()
        for up in (b.node.parent, b.node.parent and b.node.parent.parent):
            if up is not None:
                near.add(last.get(id(up), i))
                last[id(up)] = i
        for j in sorted(near - {i}):
            out.append((j, i, SMOOTH / (1 + distance(found[j].node, b.node) / 2)))
    return out


def min_cut(costs: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """The source side of a minimum cut. costs: capacity from the source, or if negative to the sink; links: both ways.

    Flow is pushed along shortest ways until none is left.
    """
    n = len(costs)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, c in enumerate(costs):
        if c > 0:
            edge(s, i, c, 0.0)
        elif c < 0:
            edge(i, t, -c, 0.0)
    for a, b, c in links:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue and level[t] < 0:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        way: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in way)
                for k, e in enumerate(way):
                    room[e] -= least
                    room[e ^ 1] += least
                for k, e in enumerate(way):
                    if room[e] <= 1e-9:
                        a = to[e ^ 1]
                        del way[k:]
                        break
                continue
            while turn[a] < len(graph[a]):
                e = graph[a][turn[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[way.pop() ^ 1]
                continue
            way.append(e)
            a = to[e]


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by empty lines."""
    found = blocks(html or "")
    if not found:
        return ""
    for named in (NAMED, DOUBTED):
        costs = [score(b, named) for b in found]
        keep = [True] * len(found) if min(costs) >= 0 else min_cut(costs, edges(found))
        if any(keep):
            break
    else:
        # Nothing but links, say: what nothing marks is then all the content that there is.
        keep = [b.node.sign >= 0 for b in found]
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html); null or empty html gives an empty text.

    Pages are taken whole, however long. Repeated rows are pages of their own with equal texts, null ids and urls stay null, further
    columns don't pass, and an empty table gives an empty one. A page with text that nothing marks as boilerplate has a text.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    return small_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
