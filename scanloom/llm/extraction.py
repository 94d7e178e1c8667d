"""HTML main-text extraction by minimum cut.

A page becomes its text blocks in order. A logistic classifier turns each block's text, markup and place into log-odds of being content;
they are the capacities to the two terminals. Neighbouring blocks and blocks close in the element tree are joined
by smoothness edges. The minimum cut (max-flow) is the labelling of least total cost.

The weights are learned from at most ``SAMPLE`` pages of at most ``SAMPLE_BYTES`` (those of least hash): blocks inside elements whose
role is plain (article and main, against nav, footer, aside, advert classes and the like) are the examples, the role itself is
hidden from the fit, and the weights start from, and are drawn towards, ``PRIOR``. Roles add fixed odds to the learned ones.

Blocks whose terminal capacity is at least the sum of their edges lie on that terminal's side of some
minimum cut, so they are settled before the flow runs; this changes no result and leaves few blocks.

Defined results: null html counts as empty and gives empty text; unclosed tags end at the next > or with the page, unclosed comments
with the page; very long, deep or broken pages take time and memory linear in their length; cuts of equal cost give the one
with fewest blocks; repeated rows give repeated results; key columns may have any names and types; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 1000  # capacities are integers: log-odds in thousandths
ADJACENT = 700
SIBLING = 900

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe svg math noembed noframes xmp object audio video canvas select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section summary table tbody td tfoot th thead tr ul button".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - {"button", "option", "body", "html", "head"}
TAG_ODDS = {"nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "noscript": -9.0, "button": -8.0, "head": -9.0, "header": -5.0, "article": 5.0, "main": 4.0, "figcaption": -0.5, "address": -2.0}
# Parameters: words of class, id and role attributes that mark an element.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion promoted banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side aside footer foot masthead header topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social follow subscribe subscription newsletter signup login signin search comment comments commentlist reply replies respond disqus discussion related recommended recommendations trending popular widget pagination pager tags taglist copyright legal disclaimer skip hidden sr banner complementary contentinfo".split()
)
GOOD_WORDS = frozenset("article content post entry story body main text prose".split())

# Parameters: openings and phrases that notices, teasers, reader comments, adverts and legal lines have in common.
CUES = {
    "notice": r"\bcookies?\b|\bconsent\b|\bprivacy (?:policy|settings)\b|\baccept all\b|\bdatenschutz|\bgdpr\b|\bjavascript\b",
    "teaser": r"\b(?:read|up) next\b|\bread more\b|\brelated (?:articles?|stories|posts)\b|\brecommended\b|\byou (?:may|might) also\b|\bmore (?:from|stories)\b|\bmost (?:read|popular)\b|\btrending\b|\blire aussi\b|\bmehr zum thema\b|\bte puede interesar\b",
    "comment": r"\b(?:says|said|wrote|writes):|\breply\b|\bleave a (?:comment|reply)\b|\bposted (?:by|on)\b|\bcommented\b|\bcomments? \(\d|\d+ comments?\b|\b\d+ (?:minutes?|hours?|days?) ago\b",
    "advert": r"\badvertisement\b|\bsponsored\b|\bbuy now\b|\bspecial offer\b|\bnewsletter\b|\bsubscribe\b|\bsign up\b|\blog in\b|\bfollow us\b|\bshare (?:this|on)\b|\banzeige\b|\bpublicité\b|\bpublicidad\b",
    "legal": r"©|\ball rights reserved\b|\bcopyright\b|\bterms of (?:use|service)\b|\bimprint\b|\bimpressum\b",
}
_CUES = [re.compile(x) for x in CUES.values()]
#: A block without any of these strings has no cue.
_HINTS = ("cooki", "onsent", "privacy", "accept all", "datenschutz", "gdpr", "javascript", "next", "read ", "related", "recommend", "you m", "more ", "trending", "lire aussi", "mehr zum", "te puede", "says:", "said:", "wrote:", "writes:", "reply", "comment", "posted", " ago", "advert", "sponsor", "buy now", "offer", "newsletter", "subscribe", "sign up", "log in", "follow us", "share ", "anzeige", "publicit", "publicid", "©", "rights reserved", "copyright", "terms of", "imprint", "impressum")
#: Names of the features and the weights the fit starts from; a cue counts less in a long block.
PRIOR = {"bias": -1.2, "length": 0.9, "links": -4.0, "sentence": 0.6, "heading": 0.8, "paragraph": 0.3, "item": 0.0, "first": -0.2, "last": -0.2, "notice": -4.5, "teaser": -4.5, "comment": -4.5, "advert": -3.5, "legal": -4.0}
SAMPLE, SAMPLE_BYTES = 500, 64 << 10
STEPS, RATE, PULL = 200, 0.1, 0.05

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_MARK = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SENTENCE = re.compile(r"[.!?…]")


class Block:
    __slots__ = ("text", "linked", "role", "node", "tag", "heading", "inside")

    def __init__(self, text: str, linked: int, role: float, node: int, tag: str, heading: bool, inside: bool) -> None:
        self.text, self.linked, self.role, self.node, self.tag, self.heading, self.inside = text, linked, role, node, tag, heading, inside


class Tree:
    """Elements that hold blocks: parent and depth by number. Element 0 is the page."""

    def __init__(self) -> None:
        self.parent, self.depth = [0], [0]

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def apart(self, a: int, b: int, most: int) -> int:
        """How far the deeper of two elements lies below their common ancestor; ``most`` + 1 if further than that."""
        steps_a = steps_b = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a, steps_a = self.parent[a], steps_a + 1
            else:
                b, steps_b = self.parent[b], steps_b + 1
            if max(steps_a, steps_b) > most:
                return most + 1
        return max(steps_a, steps_b)


def _mark_odds(attributes: str) -> float:
    """Log-odds of an element's attributes."""
    bad = good = False
    for m in _MARK.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*+:\s*+none", value):
            return -9.0
        if kind in ("class", "id", "role"):
            words = {w.lower() for w in _WORD.findall(value)}
            bad |= not words.isdisjoint(BAD_WORDS)
            good |= not words.isdisjoint(GOOD_WORDS)
    return -7.0 if bad else 3.0 if good else 0.0


def blocks(page: str) -> tuple[list[Block], Tree]:
    """Text blocks in page order with the log-odds that the roles of the elements around them give."""
    out: list[Block] = []
    tree = Tree()
    stack: list[tuple[str, float, int, bool, bool]] = [("", 0.0, 0, False, False)]  # tag, log-odds so far, number, inside an article, in a heading
    open_: Counter[str] = Counter()
    pieces: list[str] = []
    linked = links = at = 0
    end = len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                tag, odds, node, inside, heading = stack[-1]
                out.append(Block(text, min(linked, len(text)), odds, node, tag, heading, inside))
            pieces.clear()
        linked = 0

    def push(tag: str, odds: float, inside: bool) -> None:
        stack.append((tag, max(-18.0, min(8.0, odds)), tree.add(stack[-1][2]), inside, stack[-1][4] or tag in HEADINGS))
        open_[tag] += 1

    def pop() -> None:
        open_[stack.pop()[0]] -= 1

    def said(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if links:
                linked += len(text.strip())

    begin = 0
    while at < end:
        at = page.find("<", at)
        if at < 0:
            break
        mark = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            said(page[begin:at])
            at = begin = close + 3 if close >= 0 else end
            continue
        if not (mark.isascii() and mark.isalpha() or mark in ("/", "!", "?") and mark):
            at += 1  # a sign, not a tag
            continue
        m = _TAG.match(page, at)
        if m is None:
            said(page[begin:at])
            close = page.find(">", at)
            if close < 0:
                begin = end  # an unclosed tag ends with the page
                break
            m = _TAG.match(page[at : close + 1].replace("=", " "))  # with an unclosed quotation: up to the next >
            at = begin = close + 1
            if m is None:
                continue
        else:
            said(page[begin:at])
            at = begin = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                flush()
            if open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            pieces.append(" ")
            if not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*+>", re.IGNORECASE).search(page, at)
                at = begin = close.end() if close else end
            continue
        if tag in ("br", "hr", "img"):
            pieces.append(" ")
        if tag == "hr":
            flush()
        if tag in VOID:
            continue
        if tag == "a":
            links += 1
            continue
        if tag in BLOCK:
            flush()
            links = 0
            if tag in ENDS_P and (stack[-1][0] == "p" or stack[-1][0] in HEADINGS):
                pop()
            if tag in ("li", "tr", "td", "th", "dt", "dd") and stack[-1][0] == tag:
                pop()
            _, odds, _, inside, _ = stack[-1]
            own = -0.5 if tag == "header" and inside else TAG_ODDS.get(tag, 0.0)
            push(tag, odds + own + (_mark_odds(m[3]) if m[3] else 0.0), inside or tag in ("article", "main"))
        elif m[3] and ("hidden" in m[3] or "none" in m[3]) and _mark_odds(m[3]) <= -9.0:
            flush()
            push(tag, stack[-1][1] - 9.0, stack[-1][3])
    said(page[begin:end])
    flush()
    return out, tree


def features(found: list[Block]) -> np.ndarray:
    """A row for each block, in the order of ``PRIOR``. Roles are no features."""
    rows, none, final = [], [0.0] * len(_CUES), len(found) - 1
    for i, b in enumerate(found):
        n, low = len(b.text), b.text.lower()
        cues = [1 / (1 + n / 300) if c.search(low) else 0.0 for c in _CUES] if any(x in low for x in _HINTS) else none
        rows.append((1.0, math.log1p(n / 40), (b.linked / n) ** 2, _SENTENCE.search(b.text) is not None, b.heading, b.tag == "p", b.tag in ("li", "dd", "td"), i == 0, i == final, *cues))
    return np.array(rows, dtype=float).reshape(len(found), len(PRIOR))


def fit(pages: list[str]) -> np.ndarray:
    """Weights of the features from blocks whose role is plain; ``PRIOR`` where there are none of both kinds."""
    start = np.array(list(PRIOR.values()))
    rows, labels = [], []
    for page in pages:
        found, _ = blocks(page)
        if not found:
            continue
        plain = np.array([b.role <= -7.0 or b.inside and b.role >= 4.0 for b in found])
        rows.append(features(found)[plain])
        labels.append(np.array([b.role > 0 for b in found])[plain])
    x, y = (np.concatenate(rows), np.concatenate(labels).astype(float)) if rows else (np.zeros((0, len(start))), np.zeros(0))
    if not 0 < y.sum() < len(y):
        return start
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # either kind counts as much
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for i in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - PULL * (w - start) / len(start)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w + RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


def _edges(found: list[Block], tree: Tree) -> list[tuple[int, int, int]]:
    """Smoothness edges: neighbours in the page, and the next block with the same parent."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT >> tree.apart(found[i - 1].node, b.node, ADJACENT.bit_length())))
        parent = tree.parent[b.node]
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SIBLING))
        elif parent in last:
            edges.append((i - 1, i, SIBLING - ADJACENT))
        last[parent] = i
    return [e for e in edges if e[2] > 0]


def min_cut(odds: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the content side of a minimum cut: source edges ``odds`` > 0, sink edges < 0."""
    n = len(odds)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    odds = list(odds)
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:  # settle nodes that no choice of their neighbours can turn
        i = todo.pop()
        if label[i] is None and abs(odds[i]) >= sum(near[i].values()):
            label[i] = odds[i] > 0
            for j, c in near[i].items():
                odds[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    excess = {i: odds[i] for i in rest}
    while rest:  # blocking flows along shortest paths, from nodes with source capacity to nodes with sink capacity
        level = {i: 0 for i in rest if excess[i] > 0}
        wave, met = list(level), False
        while wave and not met:
            ahead = []
            for i in wave:
                for j, c in near[i].items():
                    if c > 0 and j not in level:
                        level[j] = level[i] + 1
                        met |= excess[j] < 0
                        ahead.append(j)
            wave = ahead
        if not met:
            for i in rest:
                label[i] = i in level
            break
        arcs = {i: iter(list(near[i])) for i in level}
        for source in [i for i in level if excess[i] > 0]:
            path = [source]
            while path and excess[source] > 0:
                i = path[-1]
                if excess[i] < 0:
                    flow = min(-excess[i], excess[source], *(near[a][b] for a, b in zip(path, path[1:])))
                    for a, b in zip(path, path[1:]):
                        near[a][b] -= flow
                        near[b][a] += flow
                    excess[source] -= flow
                    excess[i] += flow
                    path = [source]
                    arcs[source] = iter(list(near[source]))
                    continue
                step = next((j for j in arcs[i] if near[i][j] > 0 and level.get(j) == level[i] + 1), None)
                if step is None:
                    path.pop()
                    level[i] = -1  # a dead end for this round
                else:
                    path.append(step)
                    if excess[step] >= 0:
                        continue
                    arcs[i] = _again(step, arcs[i])
    return [bool(x) for x in label]


def _again(first: int, rest: Iterator[int]) -> Iterator[int]:
    yield first
    yield from rest


def extract(page: str | None, weights: np.ndarray | None = None) -> str:
    """The page's main text: its content blocks joined by newlines."""
    found, tree = blocks(page or "")
    if not found:
        return ""
    odds = features(found) @ (np.array(list(PRIOR.values())) if weights is None else weights) + [b.role for b in found]
    labels = min_cut([round(UNIT * x) for x in odds.tolist()], _edges(found, tree))
    return "\n".join(b.text for b, keep in zip(found, labels) if keep)


def learned(df: DataFrame, column: str = "html") -> np.ndarray:
    """The classifier's weights for a table of pages."""
    pages = df.select(F.col(column).alias("html"), F.xxhash64(column).alias("h")).where(F.octet_length("html") <= SAMPLE_BYTES)
    drawn = F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * SAMPLE / max(1, df.count())))
    return fit(pages.where(drawn).orderBy("h", "html").limit(SAMPLE).toArrow()["html"].to_pylist())


def main_text(df: DataFrame, keys: list[str], column: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """(keys..., text, n_chars) for each row of a table of pages; weights are learned from the table unless given."""
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    weights = learned(df, column) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), weights) for x in batch.column(len(keys))]
            arrays = [*batch.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "text", "n_chars"])

    return df.select(*keys, column).mapInArrow(run, f"{fields}, text string, n_chars long")
