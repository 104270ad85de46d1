"""Operator 2, HTML extraction: blocks of text labelled as content or boilerplate by a minimum cut."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, narrow

# HTML's elements by role, and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
EXCLUDED = frozenset("noscript template svg object select canvas audio video".split())
#: Those out of which an end tag does not close an element around them.
BARRIER = frozenset("noscript template object select".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER_TAGS = frozenset("aside button dialog fieldset footer form head header legend menu nav".split())
WRAPPER_TAGS = frozenset("fieldset form".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments commentlist complementary "
    "contentinfo cookie cookies consent disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices outbrain overlay pager pagination paywall popup promo promotion recommended related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe taboola tags toolbar topbar widget".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text".split())

#: Words that are boilerplate however much of the page's text they hold.
READERS_WORDS = frozenset("comment comments commentlist disqus replies reply".split())

#: The classifier's costs, in units of an edge as a page's blocks have it: what containers say, then what the text says (up
#: to ``length`` for long ones, ``link`` for text that is all links). Soft enough for neighbours to outvote.
EVIDENCE = {"bias": -0.5, "boiler_tag": -6.0, "boiler": -5.0, "content": 3.0, "hint": 1.5, "link": -4.0, "length": 2.0, "heading": 0.5, "paragraph": 1.0}
#: Capacities between blocks that follow each other, and between those with the same parent element.
ADJACENT, SIBLING = 0.6, 0.8
#: An element that claims to be boilerplate but holds more than this share of the page's characters only wraps the page.
WRAPS = 0.5
SCALE = 1000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)))?")
NAMING = frozenset("class id role itemprop".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ANY_EXCLUDED = re.compile(rf"<(?:{'|'.join(sorted(EXCLUDED))})(?=[\s/>]|\Z)", re.I)


#: What an element says of its text: hint of content (1) or that it is an article (2), and claims to be boilerplate.
State = tuple[int, tuple[int, ...]]


class Claims:
    """Elements that say that they are boilerplate: by tag or by attributes, and whether they may only wrap the page."""

    def __init__(self) -> None:
        self.cost: list[float] = []
        self.wrapper: list[bool] = []

    def add(self, cost: float, wrapper: bool) -> int:
        self.cost.append(cost)
        self.wrapper.append(wrapper)
        return len(self.cost) - 1

    def state(self, tag: str, attributes: str, state: State) -> State:
        kind, claims = state
        words, hidden = set(), False
        for m in ATTRIBUTE.finditer(attributes) if "=" in attributes or "hidden" in attributes.lower() else ():
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            hidden = hidden or name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true"
            if name in NAMING:
                words |= {w.lower() for w in WORD.findall(value)}
        if hidden:
            return kind, (*claims, self.add(2 * EVIDENCE["boiler_tag"], False))
        if tag in BOILER_TAGS and not (tag == "header" and kind == 2):  # an article's own header is part of it
            return kind, (*claims, self.add(EVIDENCE["boiler_tag"], tag in WRAPPER_TAGS))
        if tag in CONTENT_TAGS:  # within what is boilerplate by its attributes an article is one
            return 2, tuple(c for c in claims if self.cost[c] <= EVIDENCE["boiler_tag"])
        if words & BOILER_WORDS and not words & CONTENT_WORDS and tag not in ("html", "body"):
            return kind, (*claims, self.add(EVIDENCE["boiler"], not words & READERS_WORDS))
        if words & CONTENT_WORDS and not kind and tag != "body":
            return 1, claims
        return state


def _after_raw(page: str, tag: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
    return end.end() if end else len(page)


def excluded(page: str) -> dict[int, int]:
    """Where the EXCLUDED elements that their own end tag closes end, by the end of their start tag.

    The others, whose end tag is missing, hide nothing: an element around them was closed first, or the page ended.
    """
    out: dict[int, int] = {}
    if not ANY_EXCLUDED.search(page):
        return out
    levels: list[tuple[list[tuple[str, int]], dict[str, int]]] = [([], {})]  # elements, and how many of each, within each barrier
    total = dict.fromkeys(EXCLUDED, 0)
    at = 0
    while m := TAG.search(page, at):
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag or tag in VOID:
            continue
        while m[1] and total.get(tag) and not levels[-1][1].get(tag):  # a barrier whose end tag is missing
            for name, _ in levels.pop()[0]:
                if name in total:
                    total[name] -= 1
        stack, opened = levels[-1]
        if not m[1]:
            if m[3].endswith("/") and (tag in RAW or tag in EXCLUDED):
                continue
            if tag in RAW:
                at = _after_raw(page, tag, at)
                continue
            if tag in EXCLUDED:
                total[tag] += 1
            if tag in BARRIER:
                levels.append(([(tag, at)], {tag: 1}))
            else:
                stack.append((tag, at))
                opened[tag] = opened.get(tag, 0) + 1
        elif opened.get(tag):
            name = ""
            while name != tag:
                name, start = stack.pop()
                opened[name] -= 1
                if name in total:
                    total[name] -= 1
            if tag in EXCLUDED:
                out[start] = at
            if tag in BARRIER:
                levels.pop()
    return out


@dataclass
class Block:
    """A block's text, its characters inside links, its innermost block element, what its containers say, its parent element."""

    text: str
    linked: int
    tag: str
    state: State
    parent: int


def blocks(page: str) -> tuple[list[Block], Claims]:
    """The blocks of a page that have text, in page order."""
    out: list[Block] = []
    claims = Claims()
    stack: list[tuple[str, State, int]] = [("", (0, ()), 0)]  # tag, state, number
    opened: dict[str, int] = {}
    text: list[str] = []
    linked = links = numbered = at = 0
    hidden = excluded(page)

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                own = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), 0)
                parent = next((stack[k][2] for k in range(own - 1, -1, -1) if stack[k][0] in BLOCK), 0) if own == len(stack) - 1 else stack[-1][2]
                out.append(Block(words, linked, stack[own][0], stack[-1][1], parent))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and opened.get("option"):
            text.append(" ")
        elif raw:
            text.append(html.unescape(raw) if "&" in raw else raw)
            if links:
                linked += len(text[-1].strip())

    def pop(tag: str) -> None:
        nonlocal links
        while True:
            name = stack.pop()[0]
            opened[name] -= 1
            links -= name == "a"
            if name == tag:
                return

    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                at = _after_raw(page, tag, at)
            text.append(" ")
            continue
        if tag in EXCLUDED:
            at = hidden.get(at, at)
            text.append(" ")
            continue
        if opened.get("option") and not m[1] and (tag in BLOCK or tag in ("option", "optgroup")):
            pop("option")
        if tag in BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if m[1]:
            if opened.get(tag):
                pop(tag)
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == tag or tag == "p" and opened.get("p") and not any(t in BLOCK and t != "p" for t, _, _ in stack[-3:]):
            pop(tag)
        numbered += 1
        stack.append((tag, claims.state(tag, m[3], stack[-1][1]), numbered))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
    add(page[at:])
    flush()
    return out, claims


def evidence(found: list[Block], claims: Claims) -> list[float]:
    """What the classifier gives for content (above 0) or boilerplate (below) for each block by itself.

    A claim is void where its element wraps the page: it holds more than WRAPS of all characters, and no article or main
    element outside of it has text.
    """
    total, articles = sum(len(b.text) for b in found), sum(len(b.text) for b in found if b.state[0] == 2)
    held, inside = [0] * len(claims.cost), [0] * len(claims.cost)
    for b in found:
        for c in b.state[1]:
            held[c] += len(b.text)
            inside[c] += len(b.text) * (b.state[0] == 2)
    valid = [not (w and h > WRAPS * total and i == articles) for w, h, i in zip(claims.wrapper, held, inside)]
    out = []
    for b in found:
        kind, own = b.state
        e = EVIDENCE["bias"] + min((claims.cost[c] for c in own if valid[c]), default=EVIDENCE["content"] if kind == 2 else EVIDENCE["hint"] * kind)
        e += EVIDENCE["link"] * min(1, b.linked / len(b.text)) + min(EVIDENCE["length"], math.log2(1 + len(b.text) / 60))
        e += EVIDENCE["heading"] * (b.tag[0:1] == "h" and b.tag[1:].isdigit()) + EVIDENCE["paragraph"] * (b.tag == "p")
        out.append(e)
    return out


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow each other, and between one and the next of the same parent element."""
    last: dict[int, int] = {}
    edges = [(i, i + 1, ADJACENT) for i in range(len(found) - 1)]
    for i, b in enumerate(found):
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return edges


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    A node of positive gain hangs on the source with that capacity, one of negative gain on the sink; an edge costs its
    capacity if it is cut. Flow through nodes of at most two edges is routed first: such a node is replaced by what it
    passes on to its neighbours' terminals and by one edge between them (the series and parallel rules), without a change
    of the minimum. Edges of a page are nested as its elements are, so that takes all of a page's nodes, in time linear in
    their number; what is left of other graphs is solved by max_flow(). Labels then follow backwards.
    """
    gain, near = list(gain), [dict() for _ in gain]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + c
    gone, done = [False] * len(gain), []
    queue = [i for i in range(len(gain)) if len(near[i]) <= 2]
    while queue:
        x = queue.pop()
        if gone[x] or len(near[x]) > 2:
            continue
        gone[x] = True
        g, around = gain[x], list(near[x].items())
        done.append((x, g, around))
        for u, _ in around:
            del near[u][x]
        if len(around) == 1:
            (u, a), = around
            gain[u] -= min(a, -g) - min(0.0, a - g)
        elif len(around) == 2:
            (u, a), (v, b) = around
            none, both, left, right = min(0.0, a + b - g), min(a + b, -g), min(a, b - g), min(b, a - g)
            c = max(0.0, (left + right - none - both) / 2)
            gain[u] -= left - none - c
            gain[v] -= right - none - c
            if c > 0:
                near[u][v] = near[v][u] = near[u].get(v, 0.0) + c
        queue += [u for u, _ in around if len(near[u]) <= 2]
    kept = [False] * len(gain)
    rest = [i for i in range(len(gain)) if not gone[i]]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        inner = [(number[i], number[j], c) for i in rest for j, c in near[i].items() if i < j]
        for i, side in zip(rest, max_flow([gain[i] for i in rest], inner)):
            kept[i] = side
    for x, g, around in reversed(done):
        kept[x] = sum(c if kept[u] else -c for u, c in around) + g > 1e-9
    return kept


def max_flow(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source's side of a minimum cut, by Dinic's algorithm over integers."""
    n = len(gain)
    if all(g > 0 for g in gain) or all(g <= 0 for g in gain):
        return [g > 0 for g in gain]
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            room.append(round(c * SCALE))

    for i, g in enumerate(gain):
        edge(source, i, g, 0) if g > 0 else edge(i, sink, -g, 0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [v >= 0 for v in level[:n]]
        left, path, x = [0] * (n + 2), [], source
        while True:
            if x == sink:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not room[e])
                x = to[path[cut] ^ 1]
                del path[cut:]
            while left[x] < len(out[x]) and not (room[e := out[x][left[x]]] and level[to[e]] == level[x] + 1):
                left[x] += 1
            if left[x] < len(out[x]):
                path.append(out[x][left[x]])
                x = to[path[-1]]
            elif x == source:
                break
            else:
                x = to[path.pop() ^ 1]
                left[x] += 1


def main_text(page: str | None) -> str:
    """The main text of one page; see extract_text()."""
    found, claims = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, minimum_cut(evidence(found, claims), smoothness(found))) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page row (page_id, url, html); no shuffle.

    A null or empty page has the empty text and 0 characters; null ids and urls stay null; repeated rows each get
    their row; broken or cut-off markup is read as far as it goes, very long pages whole, in time linear in their length;
    an empty table gives an empty result; further columns are ignored.
    """
    src = narrow(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2):
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
