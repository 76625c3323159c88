"""Operator 7, HTML extraction: a tree-structured graphical model over DOM nodes, read by sum-product messages."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import labelled_pages

# Fixed values of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table"
    " tbody td tfoot th thead tr ul".split()
)
VOID_BLOCKS = frozenset(["hr"])
UNREAD = frozenset("script style title textarea noscript template iframe object svg select button noframes".split())
#: An open element that a start tag of one of these closes.
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "p": BLOCKS,
}
#: Where the search for an element to close stops.
SCOPES = frozenset(["ul", "ol", "table", "body", "html"])
FURNITURE = frozenset("nav header footer aside form menu dialog search fieldset".split())
CONTAINERS = frozenset("div section article main body html center details figure".split())
CONTROLS = re.compile(r"<(?:input|button|select|textarea)\b", re.I)

TRAINING_PAGES, STEPS, RATE, RIDGE = 600, 300, 0.5, 1e-4

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?>[^<>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^<>\"']*+)*+)(?=>)|[^>]*+)>)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LABEL = re.compile(r'data-main="([01])"')
_LETTERS = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    cues: tuple[str, ...] = ()
    label: int = -1
    chars: int = 0
    linked: int = 0
    controls: int = 0


@dataclass
class Page:
    """Block elements in page order, parents first, and the runs of text with the block that each stands in."""

    nodes: list[Node] = field(default_factory=lambda: [Node("html", -1)])
    runs: list[tuple[int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    """The tree of block elements of a page, however broken its markup."""
    page, stack, text, link, at, skip = Page(), [0], [], 0, 0, ""
    nodes = page.nodes
    depths: dict[str, list[int]] = {}  # where each tag stands in the stack
    barred: list[int] = [0]  # and where tags do that stop a search
    unended: set[str] = set()

    def flush() -> None:
        if text:
            said = " ".join("".join(text).split())
            text.clear()
            if said:
                page.runs.append((stack[-1], said))

    def close(name: str, scopes: frozenset[str] | tuple = ()) -> None:
        depth = (depths.get(name) or [0])[-1]
        if not depth or (scopes and depth < barred[-1]):
            return
        flush()
        while len(stack) > depth:
            tag = nodes[stack.pop()].tag
            depths[tag].pop()
            if tag in SCOPES:
                barred.pop()

    def add(raw: str) -> None:
        if raw and not skip:
            said = unescape(raw)
            text.append(said)
            n = len(said.strip())
            nodes[stack[-1]].chars += n
            nodes[stack[-1]].linked += n if link else 0

    last = source.rfind(">") + 1  # no tag ends after the last bracket
    while m := _TAG.search(source, at, last):  # from `at`: raw text is not searched for tags
        add(source[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):  # a comment that never ends
            at = len(source)
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name == skip:
                skip = ""
            elif skip:
                continue
            elif name == "a":
                link = max(0, link - 1)
            elif name in BLOCKS and name not in ("html", "body"):
                close(name)
            continue
        if skip:
            continue
        if name in UNREAD:
            nodes[stack[-1]].controls += name in ("textarea", "select", "button")
            ending = None if name in unended else re.compile(rf"</{name}\b", re.I).search(source, at)
            if not ending:
                unended.add(name)
            if name in ("script", "style", "title", "textarea", "noframes", "iframe"):  # raw text up to the end tag
                at = ending.start() if ending else len(source)
            skip = name if ending else ""
            continue
        if name == "a":
            link += 1
        elif name == "input":
            nodes[stack[-1]].controls += 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS:
            flush()
            for open_, closers in CLOSED_BY.items():
                if name in closers:
                    close(open_, SCOPES)
            cues = tuple(
                sorted({w for a in _ATTRIBUTE.finditer(m["rest"]) for w in _LETTERS.findall((a[2] or a[3] or a[4] or "").lower())})
            )
            said = _LABEL.search(m["rest"])
            nodes.append(Node(name, stack[-1], cues, int(said[1]) if said else -1))
            if name not in VOID_BLOCKS:
                stack.append(len(nodes) - 1)
                depths.setdefault(name, []).append(len(stack) - 1)
                if name in SCOPES:
                    barred.append(len(stack) - 1)
            link = 0
    add(source[at:])
    flush()
    return page


def features(page: Page) -> list[list[str]]:
    """Names of what holds for each node, alone or with all it contains."""
    nodes = page.nodes
    total = [[n.chars, n.linked, n.controls] for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        up = total[nodes[i].parent]
        for k in range(3):
            up[k] += total[i][k]
    out = []
    for node, (chars, linked, controls) in zip(nodes, total, strict=True):
        share = linked / chars if chars else 0
        out.append(
            [
                "bias",
                f"tag:{node.tag}",
                *[f"cue:{c}" for c in node.cues],
                f"size:{0 if not chars else 1 + (chars >= 25) + (chars >= 100) + (chars >= 400)}",
                f"links:{0 if not linked else 1 + (share >= 0.3) + (share >= 0.8)}",
                *(["controls"] if controls else []),
            ]
        )
    return out


def kind(tag: str) -> int:
    """Which table of potentials an element and its parent share."""
    return 0 if tag in FURNITURE else 1 if tag in CONTAINERS else 2


@dataclass
class Model:
    """Log odds of each feature, and for each kind of child the potentials of (parent, child) labels."""

    weights: dict[str, float]
    tables: list[list[list[float]]]

    def marginals(self, page: Page) -> list[float]:
        """The probability that each node is content, by messages up to the root and down again."""
        nodes = page.nodes
        own = [sum(self.weights.get(f, 0.0) for f in found) for found in features(page)]
        belief, up = list(own), [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children stand after their parents
            up[i] = self._message(self.tables[kind(nodes[i].tag)], belief[i], False)
            belief[nodes[i].parent] += up[i]
        for i in range(1, len(nodes)):
            without = belief[nodes[i].parent] - up[i]
            belief[i] += self._message(self.tables[kind(nodes[i].tag)], without, True)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, b)))) for b in belief]

    @staticmethod
    def _message(table: list[list[float]], odds: float, down: bool) -> float:
        """Log odds that a neighbour of log odds ``odds`` sends along an edge."""
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        to = [(1 - p) * (table[0][x] if down else table[x][0]) + p * (table[1][x] if down else table[x][1]) for x in (0, 1)]
        return math.log(to[1] / to[0])


def labels_of(page: Page) -> list[int]:
    out = []
    for node in page.nodes:
        out.append(node.label if node.label >= 0 else out[node.parent] if node.parent >= 0 else 0)
    return out


def train(pages: list[str]) -> Model:
    """Node weights by logistic regression, edge potentials by counts of (parent, child) labels for each kind of child."""
    found, label, counts = [], [], np.ones((3, 2, 2))
    for page in map(parse, pages):
        own = labels_of(page)
        found += features(page)
        label += own
        for node, x in zip(page.nodes[1:], own[1:], strict=True):
            counts[kind(node.tag), own[node.parent], x] += 1
    names = {f: i for i, f in enumerate(sorted({f for x in found for f in x}))}
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    column = np.array([names[f] for x in found for f in x])
    y, w = np.array(label, float), np.zeros(len(names))
    state = np.full(len(names), 1e-8)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.bincount(row, weights=w[column], minlength=len(y))))
        grad = np.bincount(column, weights=(p - y)[row], minlength=len(w)) / len(y) + RIDGE * w
        state += grad**2
        w -= RATE * grad / np.sqrt(state)
    prior = math.log(y.mean() / (1 - y.mean()))
    weights = {f: float(w[i]) - (prior if f == "bias" else 0.0) for f, i in names.items()}
    return Model(weights, (counts / counts.sum(axis=2, keepdims=True)).tolist())


@functools.cache
def default_model() -> Model:
    return train(list(labelled_pages(TRAINING_PAGES)))


def main_text(source: str, model: Model) -> str:
    """The text of the blocks that are content likelier than not, in page order, joined by newlines."""
    page = parse(source)
    if not page.runs:
        return ""
    p = model.marginals(page)
    return "\n".join(said for node, said in page.runs if p[node] >= 0.5)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of the main text of every row of ``pages``.

    Null or empty html, and pages without content, give empty text. Null ids and urls stay as they are, repeated rows
    are read each for itself, more columns are left alone, no rows give no rows. Whole pages are read.
    """
    model = model or default_model()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) if x.is_valid else "" for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
