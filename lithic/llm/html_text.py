"""Operator 5, main text of HTML pages by minimum-cut labelling.

A page is cut into blocks, runs of text between block-level tags. A linear classifier gives two costs for each block, of
calling it content and of calling it boilerplate. Its terms are what the block's ancestors say by their names, classes, ids
and roles (a fixed table), and the block's own features: length, share of links, punctuation, kind of element. The weights
of these features are fitted: pages that mark their article and their menus and footers themselves teach, by logistic
regression over a bounded sample. The costs are the capacities from and to the two terminals of a flow network. Neighbours
on the page, and neighbours below one parent, are joined by smoothness edges. The minimum cut separates content from
boilerplate. Blocks whose own costs outweigh all their edges are settled first, which leaves the cut as it is; the maximum
flow is found over what remains.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements that never split a block, that have no end tag, whose content is no markup, and whose text is never shown.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br"
    " mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mmultiscripts mspace mstyle mpadded mphantom menclose merror semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|noscript|template|textarea|iframe"
UNSEEN = frozenset("select button svg object canvas audio video".split())
STRUCTURE = frozenset("html body article main section div nav aside header footer form table td th ul ol li dl blockquote figure dialog menu fieldset".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 legend".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "a": {"a"}}

# Each alternative begins with what no other can, and takes all it can for good: reading is linear in the page. A tag,
# comment or raw element that never ends goes to the page's end.
REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+"
TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*+)|<(?P<raw>{RAW})(?=[\s/>]){REST}(?:>(?:.*?</(?P=raw)\s*+>|.*+)|\Z)|<(?P<end>/?+)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>{REST})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
REMARKS = re.compile(r"(\d+\s+)?(reader\s+|user\s+)?(comments?|replies|responses|discussion|leave a (reply|comment)|join the discussion)\W*(\(?\d+\)?)?", re.I)

# What an element's name says, boilerplate below 0 and content above; names of boilerplate and of content in
# classes, ids and roles; words around such a name that leave it the boilerplate, and words before it that only mention it.
BY_TAG = {"nav": -9, "footer": -9, "aside": -9, "form": -9, "menu": -9, "dialog": -9, "header": -9, "article": 5, "main": 3, "address": -2}
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright dialog discussion disqus"
    " feedback footer form gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promotion recommendations recommended register"
    " related replies reply respond responses search searchbox share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toc toolbar topbar widget widgets".split()
)
AROUND = frozenset(
    "area articles author bar block body bottom box buttons container content form icons inner item items left links list main menu message meta outer posts primary right secondary section slot text thread top unit widget wrap wrapper".split()
)
MENTIONS = frozenset("has with without no not is show hide js under after before below above".split())
CONTENT = {"article": 5, "content": 3, "post": 3, "entry": 3, "story": 4, "main": 3, "body": 2, "text": 2}
STRONG, NEXT_EDGE, PARENT_EDGE, SCALE = -9, 0.4, 0.6, 1000
#: Pages whose blocks teach the weights, blocks taken of each, and blocks of each kind below which nothing is fitted.
MAX_PAGES, MAX_BLOCKS, LEAST = 400, 200, 30


def says(token: str, inside: float) -> float:
    """What one class, id or role says: STRONG for boilerplate, above 0 for content, 0 for nothing."""
    words = [w.lower() for w in PART.findall(token)]
    if not words or words[0] in MENTIONS:
        return 0
    if words[-1] == "header" and (inside > 0 or set(words[:-1]) & {"article", "post", "entry", "story", "section"}):
        return 0
    if "".join(words) in BOILERPLATE or words[-1] in BOILERPLATE:
        return STRONG
    if words[0] in BOILERPLATE and all(w in AROUND or w in BOILERPLATE or w.isdigit() for w in words[1:]):
        return STRONG
    return max(CONTENT.get(w, 0) for w in words)


def weight(tag: str, rest: str, inside: float) -> float:
    """What one element adds to the leaning of the blocks in it."""
    if tag in ("html", "body"):
        return 0
    if tag in UNSEEN:
        return 4 * STRONG
    out = 0 if tag == "header" and inside > 0 else BY_TAG.get(tag, 0)  # an article's own heading
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "style" and re.search(r"(display\s*:\s*none|visibility\s*:\s*hidden)", value, re.I):
            return STRONG
        if name in ("class", "id", "role", "itemprop"):
            found = [says(t, inside) for t in value.split()] or [0]
            if min(found) < 0:
                out = min(out, STRONG)
            elif out >= 0:
                out = max(out, *found)
    return out


class Block:
    """A run of text: its parts, how much of it is linked, the numbers of the elements it lies in, its own element, and the leaning of all."""

    __slots__ = ("holders", "leaning", "linked", "parts", "tag", "told")

    def __init__(self, holders: tuple[int, ...], tag: str, leaning: float, told: int) -> None:
        self.parts, self.linked, self.holders, self.tag, self.leaning, self.told = [], 0, holders, tag, leaning, told

    @property
    def parent(self) -> int:
        return self.holders[-1]


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with the leaning of their ancestors."""
    # An element: (tag, number, content leaning, boilerplate leaning, what its name or an ancestor's tells). Ancestors of one kind count once, the strongest.
    stack: list[tuple[str, int, float, float, int]] = [("", 0, 0.0, 0.0, 0)]
    out, now, number, links, at = [], None, 0, 0, 0

    def text(piece: str) -> None:
        nonlocal now
        if not piece:
            return
        if now is None:
            if piece.isspace():
                return
            holders = [e for e in stack if e[0] not in INLINE]
            now = Block(tuple(e[1] for e in holders[-8:]), holders[-1][0], stack[-1][2] + stack[-1][3], stack[-1][4])
            out.append(now)
        now.parts.append(piece)
        if links:
            now.linked += len(piece)

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            now = None if m["raw"].lower() in ("title", "iframe", "textarea") else now
            continue
        if not m["tag"]:
            continue
        tag, rest = m["tag"].lower(), m["rest"]
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag not in INLINE:
            now = None
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    links -= sum(e[0] == "a" for e in stack[k:])
                    del stack[k:]
                    break
                if tag not in STRUCTURE and stack[k][0] in STRUCTURE:
                    break
            continue
        if tag in VOID:
            continue
        ends = CLOSES.get(tag, ())
        if tag not in INLINE:
            while len(stack) > 1 and (stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack[-1][0] in INLINE and any(e[0] == "p" for e in stack)):
                links -= stack[-1][0] == "a"
                stack.pop()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in ends:
                links -= sum(e[0] == "a" for e in stack[k:])
                del stack[k:]
                break
            if stack[k][0] in STRUCTURE:
                break
        if tag not in STRUCTURE and (rest == "/" or rest[-2:] in (" /", '"/', "'/")):
            continue  # written as empty; a last "/" may also end an attribute without quotes
        number += 1
        _, _, good, bad, told = stack[-1]
        w = weight(tag, rest, good)
        told = -1 if told < 0 or w == STRONG and tag in BY_TAG else max(told, int(tag in ("article", "main")))
        stack.append((tag, number, max(good, w), min(bad, w), told))
        links += tag == "a"
    text(page[at:])
    return out


def features(b: Block, t: str) -> list[float]:
    """Of one block with its text: length, share of links, punctuation, kind of element."""
    n = max(1, len(t))
    marks = sum(t.count(c) for c in ".,;:!?")
    kinds = (b.tag == "p", b.tag in HEADING, b.tag in ("li", "dd", "dt"), b.tag in ("td", "th"))
    return [1.0, min(np.log1p(n), 6) / 3, min(1.0, b.linked / n), min(1.0, 20 * marks / n), float(t[-1:] in ".!?"), *map(float, kinds)]


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """The weights of a logistic regression with both classes of equal weight; none where a class has under LEAST rows."""
    if min(y.sum(), (1 - y).sum()) < LEAST:
        return None
    share, w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()), np.zeros(x.shape[1])
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (y - p)) - 1e-3 * w
        w += np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), slope)
    return w


def remarks(found: list[Block], texts: list[str]) -> set[int]:
    """Places of the blocks that follow a heading such as "3 comments" in its parent, the heading included."""
    out, under = set(), None
    for k, (b, t) in enumerate(zip(found, texts, strict=True)):
        if under is not None and under not in b.holders:
            under = None
        if under is None and b.tag in HEADING and REMARKS.fullmatch(t) and len(b.holders) > 1:
            under = b.holders[-2]
        if under is not None:
            out.add(k)
    return out


def margins(found: list[Block], texts: list[str], weights: np.ndarray | None = None) -> list[int]:
    """For each block the cost of calling it boilerplate less that of calling it content."""
    out, marked, said = [], any(b.leaning >= 2 for b in found), remarks(found, texts)
    for k, (b, t) in enumerate(zip(found, texts, strict=True)):
        share = b.linked / max(1, sum(map(len, b.parts)))
        if weights is None:
            own = min(len(t), 400) / 200
        else:
            own = min(2.0, max(-2.0, float(np.dot(weights, features(b, t)))))
            own = max(own, min(len(t), 400) / 200) if share <= 0.6 else own  # features may speak for short texts, never against long ones
        # Where the page marks its content, text elsewhere is doubtful; where it doesn't, plain text is content.
        own -= (2.5 if marked and b.leaning <= 0 else -0.3) + (4 if b.leaning <= 0 else 1) * (share > 0.6) + 9 * (k in said)
        out.append(round(SCALE * (b.leaning + own)))
    return out


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    out, last = [], {}
    for k, b in enumerate(found):
        if k:
            out.append((k - 1, k, round(SCALE * NEXT_EDGE)))
        if b.parent in last:
            out.append((last[b.parent], k, round(SCALE * PARENT_EDGE)))
        last[b.parent] = k
    return out


def minimum_cut(margin: list[int], pairs: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it is on the source's side, content. A tie is content."""
    n = len(margin)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, w in pairs:
        near[a].append((b, w))
        near[b].append((a, w))
    margin, label = list(margin), [None] * n
    free = [sum(w for _, w in x) for x in near]  # edges to nodes not settled
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if label[k] is not None or abs(margin[k]) < free[k]:
            continue
        label[k] = margin[k] >= 0
        for j, w in near[k]:
            if label[j] is None:
                free[j] -= w
                margin[j] += w if label[k] else -w
                todo.append(j)
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        side = _source_side([margin[k] for k in rest], rest, near, label)
        for k in rest:
            label[k] = k in side
    return label


def _source_side(margin: list[int], rest: list[int], near: list[list[tuple[int, int]]], label: list) -> set[int]:
    """Dinic's maximum flow; the nodes that cannot reach the sink any more."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {k: {} for k in [source, sink, *rest]}
    for k, m in zip(rest, margin, strict=True):
        for j, w in near[k]:
            if label[j] is None:
                room[k][j] = room[k].get(j, 0) + w
        if m > 0:
            room[source][k], room[k][source] = m, 0
        elif m < 0:
            room[k][sink], room[sink][k] = -m, 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, c in room[a].items():
                if c > 0 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            break
        where = {k: list(x) for k, x in room.items()}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(room[x][y] for x, y in zip(path, path[1:], strict=False))
                for x, y in zip(path, path[1:], strict=False):
                    room[x][y] -= flow
                    room[y][x] = room[y].get(x, 0) + flow
                path = [source]
                continue
            while where[a] and not (room[a][where[a][-1]] > 0 and level.get(where[a][-1], -1) == level[a] + 1):
                where[a].pop()
            if where[a]:
                path.append(where[a][-1])
            else:
                path.pop()
                if path:
                    where[path[-1]].pop()
    back, queue = {sink}, deque([sink])  # who can still reach the sink
    while queue:
        b = queue.popleft()
        for a in room[b]:
            if a not in back and room[a].get(b, 0) > 0:
                back.add(a)
                queue.append(a)
    return {k for k in rest if k not in back}


def read(page: str | None) -> tuple[list[Block], list[str]]:
    """The page's blocks that have a text, and these texts."""
    found = [(b, " ".join(html.unescape("".join(b.parts)).split())) for b in blocks(page or "")]
    found = [(b, t) for b, t in found if t]
    return [b for b, _ in found], [t for _, t in found]


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    found, texts = read(page)
    label = minimum_cut(margins(found, texts, weights), edges(found))
    return "\n".join(t for t, content in zip(texts, label, strict=True) if content)


def taught(pages: DataFrame, max_pages: int) -> np.ndarray | None:
    """The weights fitted to blocks that lie in an article or main element, or in a menu, footer and the like: at most MAX_BLOCKS of each of max_pages pages, the first by hash."""
    some = pages.select(F.xxhash64("html").alias("k")).distinct().orderBy("k").limit(max_pages)
    last = some.agg(F.max("k").alias("k")).first()["k"]
    if last is None:
        return None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for page in batch.column(0).to_pylist():
                told = [(b, t) for b, t in zip(*read(page), strict=True) if b.told][:MAX_BLOCKS]
                x += [features(b, t) for b, t in told]
                y += [int(b.told > 0) for b, _ in told]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])

    rows = pages.where(F.xxhash64("html") <= last).groupBy(F.xxhash64("html").alias("k")).agg(F.first("html").alias("html")).select("html")
    got = sorted((r.y, r.x) for r in rows.mapInArrow(each, "x array<double>, y int").collect())  # at most max_pages * MAX_BLOCKS rows
    return fitted(np.array([x for _, x in got]), np.array([y for y, _ in got])) if got else None


def html_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_pages: int = MAX_PAGES) -> DataFrame:
    """One row per input row: id, url, text (empty if none), n_chars. A narrow map, after the weights are fitted to at most ``max_pages`` pages.

    A null page counts as empty. Repeated rows are each returned, and teach once; null ids and urls stay null. No rows: no
    rows. Other columns are ignored, whatever their names. Pages of any length are read whole, in time linear in their length.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    weights = taught(rows.select(F.coalesce("html", F.lit("")).alias("html")), max_pages)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(each, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
