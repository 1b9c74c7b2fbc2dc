"""Main text of web pages by a minimum cut. A page is a sequence of blocks; a linear classifier, learnt from planted pages,
gives each block a log odds of being content, which becomes the capacity of its edge to one of two terminals; neighbours in
the page and blocks in one container are tied by smoothness edges, learnt from the same pages. The maximum flow between
the terminals finds the labelling of least cost, and blocks on the content side, in page order, are the text.

Scale: one scan, one page at a time; memory is that of a page and its blocks."""

from __future__ import annotations

import functools
import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import html_planted
from lodestone.llm.common import passes
from lodestone.llm.html_planted import MARK

#: Elements whose contents are no text of the page.
SKIPPED = "script|style|noscript|template|title|svg|math|iframe|object|canvas|audio|video|textarea|select|datalist|button"
#: Elements that stand within a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label link mark meta meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup td th time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element closes an open one of the same kind, up to the element that holds such kinds.
CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "option": ("select",)}
#: Elements that hold one block of a container.
HOLDERS = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd tr blockquote figcaption caption summary pre address".split())
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BOILERPLATE = frozenset("nav aside footer form dialog menu fieldset".split())
CONTENT = frozenset("article main".split())
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alert": -1, "menu": -1, "menubar": -1, "main": 1, "article": 1}
#: Words in class and id that name reader comments, other boilerplate, and content.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion reader readers".split())
OTHERS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login share sharing social related recommended recommendations popular trending sidebar side widget widgets breadcrumb breadcrumbs pagination pager menu nav navbar navigation topbar toolbar footer foot masthead copyright legal disclaimer modal popup overlay paywall skip hidden".split())
BODIES = frozenset("article content entry post story body text main".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    rf"|<(?P<raw>{SKIPPED})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:/>|>.*?(?:</(?P=raw)\s*+[^>]*+>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
#: A comment or declaration that never ends.
UNENDED = re.compile(r"<[!?/]")
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


@dataclass(frozen=True)
class Weights:
    """Of the classifier's log odds, by features(), and of the smoothness edges, by TIES."""

    odds: tuple[float, ...]
    ties: tuple[float, ...]


#: Planted pages that the classifier learns from, and the seed they are made from: the bound of the training.
PLANTED_PAGES, PLANTED_SEED = 450, 20
#: Smoothness edges: next blocks in one container, next blocks whose containers lie in one another, other next blocks, and
#: blocks that follow each other in one container with others between them.
TIES = ("together", "nested", "apart", "siblings")


@dataclass
class Block:
    text: str
    links: int  # characters in links
    container: int  # number of the element around the one that holds it
    outer: int  # number of the element around that
    tag: str
    state: int  # 1 in content, -2 in sticky boilerplate, -1 in other boilerplate, 0 neither
    named: bool  # in an element whose name is that of content


def _state(tag: str, attrs: str, state: int, named: bool) -> tuple[int, bool]:
    """The nearest element that says something counts; within navigation, forms, asides and comments nothing else does."""
    if state == -2:
        return state, named
    found = {}
    if attrs and not attrs.isspace():
        for m in ATTRIBUTE.finditer(attrs):
            found[m[1].lower()] = next((x for x in m.groups()[1:] if x is not None), "")
    words = {w.lower() for k in ("class", "id") if k in found for w in WORD.findall(found[k])}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return -2, named
    if tag in BOILERPLATE or words & COMMENTS:
        return -2, named
    if (role := ROLES.get(found.get("role", "").lower(), 0)) < 0:
        return -2, named
    if tag in CONTENT or role > 0:
        return 1, True
    if tag == "header" and state != 1:
        return -2, named
    if words & OTHERS and tag not in ("body", "html") and not words & BODIES:
        return -1, named
    if words & BODIES:
        return (0 if state == -1 else state), True
    return state, named


class _Open:
    """The open elements (tag, number, state, named), and the places of each tag among them."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, number: int, state: int, named: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, number, state, named))

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these kinds, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order. Inline elements, table cells and line breaks part words, not blocks;
    unclosed and stray tags are taken as browsers take them, nearly. Time grows with the page's length."""
    out: list[Block] = []
    opened = _Open()
    stack = opened.stack
    parts: list[str] = []
    link_parts = 0
    n, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal link_parts
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            tag, number, state, named = stack[-1]
            if tag in HOLDERS:  # its paragraphs and the like stand in the element around it
                container, outer = stack[-2][1], stack[max(len(stack) - 3, 0)][1]
            else:
                container, outer = number, stack[max(len(stack) - 2, 0)][1]
            out.append(Block(text, min(link_parts, len(text)), container, outer, tag, state, named))
        link_parts = 0

    whole = page.rfind(">") + 1  # no tag ends beyond it
    for m in TOKEN.finditer(page, 0, whole):
        if m.start() > at:
            text = page[at : m.start()]
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if in_link:
                link_parts += len(text.strip())
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"] is not None:
                parts.append(" ")
            continue
        tag = tag.lower()
        closing = bool(m["end"] or m["end2"])
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag in ("br", "td", "th"):
                parts.append(" ")
            continue
        flush()
        if closing:
            if place := opened.last(tag):
                opened.cut(place)
            in_link = 0
            continue
        if tag in ENDS_P and stack[-1][0] == "p":
            opened.cut(len(stack) - 1)
        if tag in CLOSES and (place := opened.last(tag)) > opened.last(*CLOSES[tag]):
            opened.cut(place)
        if tag in VOID or (m["attrs"] or m["attrs2"] or "").endswith("/"):
            continue
        n += 1
        state, named = _state(tag, m["attrs"] or m["attrs2"] or "", stack[-1][2], stack[-1][3])
        opened.push(tag, n, state, named)
    if at < len(page):
        text = UNENDED.split(page[at:], maxsplit=1)[0]
        parts.append(html.unescape(text) if "&" in text else text)
    flush()
    return out


def features(block: Block) -> tuple[float, ...]:
    words = block.text.count(" ") + 1
    return (
        1.0,
        float(block.state > 0),
        float(block.named and block.state >= 0),
        float(block.state == -2),
        float(block.state == -1),
        min(6.0, float((words // 4).bit_length())),  # doublings beyond four words
        float(block.text[-1] in ".!?…。！？\"”»)" and words > 3),
        float(block.tag in HEADINGS),
        float(block.tag == "h1"),
        block.links / len(block.text),
        float("©" in block.text),
    )


def log_odds(block: Block, w: Weights) -> float:
    return sum(a * b for a, b in zip(w.odds, features(block), strict=True))


def relations(some: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, number in TIES) of all smoothness edges: at most two for each block."""
    out = []
    before: dict[int, int] = {}
    for i, b in enumerate(some):
        if i:
            a = some[i - 1]
            out.append((i - 1, i, 0 if a.container == b.container else 1 if a.container == b.outer or a.outer == b.container else 2))
        if (j := before.get(b.container, i - 1)) < i - 1:
            out.append((j, i, 3))
        before[b.container] = i
    return out


def edges(some: list[Block], w: Weights) -> list[tuple[int, int, float]]:
    """Smoothness: each block and the next, and each block and the one before it in the same container."""
    return [(a, b, w.ties[k]) for a, b, k in relations(some) if w.ties[k] > 0]


def minimum_cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stand on the source's side of the minimum cut between a source tied to nodes of positive odds and a
    sink tied to the others; of cuts of equal cost the one with the smallest source side. Nodes whose terminal's edge outweighs
    all their ties are settled first, and pull their neighbours; flow augments along shortest paths, phase by phase, between
    the others. On integers (thousandths), so that the result does not depend on rounding."""
    n = len(odds)
    room = [round(1000 * x) for x in odds]  # what is left of the terminals' edges: of the source's, or minus the sink's
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    tied = [0] * n
    for a, b, c in ties:
        c = round(1000 * c)
        near[a].append((b, c))
        near[b].append((a, c))
        tied[a] += c
        tied[b] += c
    settled: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if settled[i] is None and (room[i] > tied[i] or -room[i] >= tied[i]):
            settled[i] = room[i] > tied[i]
            for j, c in near[i]:
                if settled[j] is None:
                    room[j] += c if settled[i] else -c
                    tied[j] -= c
                    todo.append(j)
    rest = [i for i in range(n) if settled[i] is None]
    place = {i: k for k, i in enumerate(rest)}
    sides = _flow([room[i] for i in rest], [(place[a], place[b], round(1000 * c)) for a, b, c in ties if a in place and b in place])
    for i, side in zip(rest, sides, strict=True):
        settled[i] = side
    return settled


def _flow(room: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """The source's side after a maximum flow; room and ties are integers."""
    n = len(room)
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in ties:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(c)
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if room[i] > 0)
        for i in queue:
            level[i] = 0
        reached, depth = False, -1
        while queue:
            i = queue.popleft()
            if reached and level[i] >= depth:
                continue
            for e in out[i]:
                j = to[e]
                if cap[e] > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    if room[j] < 0 and not reached:
                        reached, depth = True, level[j]
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        at = [0] * n
        for s in range(n):
            while room[s] > 0 and level[s] == 0:
                path: list[int] = []
                i = s
                while True:
                    if room[i] < 0:
                        flow = min(room[s], -room[i], *(cap[e] for e in path))
                        room[s] -= flow
                        room[i] += flow
                        for e in path:
                            cap[e] -= flow
                            cap[e ^ 1] += flow
                        break
                    while at[i] < len(out[i]):
                        e = out[i][at[i]]
                        if cap[e] > 0 and level[to[e]] == level[i] + 1:
                            break
                        at[i] += 1
                    else:
                        if not path:
                            break
                        i = to[path.pop() ^ 1]
                        at[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if i == s and not path:
                    break


def labelled(page: str) -> tuple[list[Block], list[bool]]:
    """The blocks of a planted page, and which of them are content."""
    some = blocks(page)
    labels = [MARK in b.text for b in some]
    for b in some:
        b.text = b.text.replace(MARK, "")
    return some, labels


def cut(some: list[Block], w: Weights) -> list[bool]:
    return minimum_cut([log_odds(b, w) for b in some], edges(some, w))


@functools.lru_cache(maxsize=1)
def fitted(n: int = PLANTED_PAGES, seed: int = PLANTED_SEED) -> Weights:
    """Learnt from n planted pages: log odds by logistic regression on half of them; ties in proportion to the log ratio of
    equal to different labels at their ends, at the scale that labels most blocks of the other half right."""
    made = [labelled(p) for p in html_planted.pages(n, seed)]
    learn, hold = made[::2], made[1::2]
    x = np.array([features(b) for some, _ in learn for b in some])
    y = np.array([k for _, labels in learn for k in labels], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's steps, with a little ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w)), x.T @ (y - p) - 0.3 * w)
    equal, all_ = np.ones(len(TIES)), np.full(len(TIES), 2.0)
    for some, labels in learn:
        for a, b, k in relations(some):
            equal[k] += labels[a] == labels[b]
            all_[k] += 1
    ratio = np.maximum(0, np.log(equal / (all_ - equal)))
    odds = tuple(round(v, 3) for v in w.tolist())
    tries = [Weights(odds, tuple(round(v, 3) for v in (scale * ratio).tolist())) for scale in (0, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0)]
    return max(tries, key=lambda t: sum(a == b for some, labels in hold for a, b in zip(cut(some, t), labels, strict=True)))


def main_text(page: str | None, w: Weights | None = None) -> str:
    """The content blocks, one a line. A null or empty page, and one without content, has an empty text."""
    if not page:
        return ""
    some = blocks(page)
    if not some:
        return ""
    return "\n".join(b.text for b, k in zip(some, cut(some, w or fitted()), strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row, also where ids are null or repeat; other columns are not read. A null or empty page
    has an empty text; an empty table gives an empty table. Very long pages take time and memory in proportion. One scan, no
    shuffle; the weights are learnt on the driver from planted pages, as many at every size of the input."""
    kind, weights = pages.schema["page_id"].dataType.simpleString(), fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in passes(batch, "html"):
                got = [main_text(t, weights) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
