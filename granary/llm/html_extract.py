"""Main text of HTML pages by a tree-structured graphical model.

Nodes are the block elements of the DOM and, as leaves, the text segments in them; each is content or not. A node's own
potential is linear in features of tag, class, id, role, length, link share and punctuation; parent and child are tied
by a 2 by 2 potential. Sum-product passes messages from the leaves up and back down; segments whose marginal reaches
one half are the text. Weights are trained on labelled pages by the likelihood's gradient (observed less expected).

Labelled pages are a parameter; without any, a generated set of common layouts is used. Null, empty and broken markup
gives what text the parser finds, or the empty string. Rows are independent. Extra columns are not read.
A head without end tag ends at the first tag or text that can't stand in it, other hidden elements without end tag at
the next block.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import arrow_map, texts_of

# fixed values: element classes of HTML
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
HIDDEN = frozenset("head script style noscript template title svg math iframe object canvas select textarea button audio video".split())
#: What may stand in a head.
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: Hidden elements that a block ends where their own end tag is missing; browsers show the text after them.
RECOVERS = frozenset("noscript svg math object canvas select button audio video".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table article section div main body nav aside footer header form".split())
BLOCKS = ENDS_P | SCOPES
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    label: int | None = None
    text: list[str] = field(default_factory=list)
    linked: int = 0


class _Tree(HTMLParser):
    """Nodes in page order; a parent comes before its children."""

    def __init__(self, unclosed=frozenset()):
        super().__init__(convert_charrefs=True)
        self.unclosed = unclosed
        #: Numbers, in page order, of the open hidden elements, and of those that ended without their end tag.
        self.numbers: list[int] = []
        self.missed: set[int] = set()
        self.n_hidden = 0
        self.nodes = [Node("root", -1)]
        self.open: list[tuple[str, int]] = [("root", 0)]
        #: Where each tag stands in open, and the nodes in open: found without a walk over open elements.
        self.where: dict[str, list[int]] = {"root": [0]}
        self.parents = [0]
        self.segment = -1
        self.hidden = self.links = 0

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no known kind is a comment
            return self.parse_bogus_comment(i)

    def _push(self, tag, at):
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, at))
        if at >= 0:
            self.parents.append(at)

    def handle_starttag(self, tag, attrs):
        if self.open[-1] == ("head", -1) and tag not in IN_HEAD:
            self._close("head")
        if tag in VOID:
            if tag == "br" and self.segment >= 0:
                self.nodes[self.segment].text.append(" ")
            elif tag == "hr":
                self.segment = -1
            return
        if tag in HIDDEN:
            if tag in ("button", "select"):
                self._close(tag, SCOPES)
            self._push(tag, -1)
            self.hidden += 1
            self.numbers.append(self.n_hidden)
            if tag not in RECOVERS:
                self.unclosed -= {self.n_hidden}
            self.n_hidden += 1
            return
        if tag in INLINE:
            self._push(tag, -2)
            self.links += tag == "a"
            return
        if tag in BLOCKS and not self.unclosed.isdisjoint(self.numbers):
            hidden = [k for k, (_, at) in enumerate(self.open) if at == -1]
            self._cut(next(k for k, n in zip(hidden, self.numbers, strict=True) if n in self.unclosed))
        if tag in ENDS_P:
            self._close("p", SCOPES)
        if tag in SIBLINGS:
            for t in SIBLINGS[tag]:
                self._close(t, SCOPES - {"table"} if t in ("td", "th") else SCOPES)
        self.segment = -1
        if self.hidden:
            self._push(tag, -3)
            return
        parent = self.parents[-1]
        a = {k: v or "" for k, v in attrs}
        names = tuple(x.lower() for k in ("class", "id", "role") for x in _TOKEN.findall(a.get(k, "")))
        label = int(a["data-label"]) if a.get("data-label") in ("0", "1") else None
        self.nodes.append(Node(tag, parent, names, label))
        self._push(tag, len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "iframe", "script"):
            self.handle_endtag(tag)

    def _cut(self, k, own=False):
        """The k-th open element and those in it end; own if by its end tag."""
        for t, at in self.open[k:]:
            self.hidden -= at == -1
            self.links -= at == -2 and t == "a"
            self.where[t].pop()
            if at >= 0:
                self.segment = -1
                self.parents.pop()
        gone, self.numbers = self.numbers[self.hidden :], self.numbers[: self.hidden]
        self.missed.update(gone[own and self.open[k][1] == -1 :])
        del self.open[k:]

    def _close(self, tag, stop=frozenset()):
        k = (self.where.get(tag) or [0])[-1]
        if k and not any(self.where.get(t, [0])[-1:] > [k] for t in stop):
            self._cut(k, True)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in VOID:
            # an inline end tag can't close blocks
            self._close(tag, ENDS_P | SCOPES if tag in INLINE else frozenset())

    def handle_data(self, data):
        if self.open[-1] == ("head", -1) and data.strip():
            self._close("head")
        if self.hidden:
            return
        if self.segment < 0:
            if not data.strip():
                return
            parent = self.parents[-1]
            self.nodes.append(Node("#text", parent))
            self.segment = len(self.nodes) - 1
        node = self.nodes[self.segment]
        node.text.append(data)
        node.linked += len(data) * bool(self.links)


def parse(html: str) -> list[Node]:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    if missed := tree.missed.union(tree.numbers):
        tree = _Tree(frozenset(missed))
        tree.feed(html)
        tree.close()
    return tree.nodes


def clean(node: Node) -> str:
    return " ".join("".join(node.text).split())


def features(nodes: Sequence[Node], i: int) -> list[str]:
    n = nodes[i]
    if n.tag != "#text":
        return [f"tag:{n.tag}", *(f"name:{x}" for x in set(n.names))]
    t = clean(n)
    share = n.linked / max(1, sum(map(len, n.text)))
    return [
        "text",
        f"size:{min(9, len(t).bit_length())}",
        f"link:{0 if share == 0 else 1 if share < 0.5 else 2}",
        f"in:{nodes[n.parent].tag}",
        f"stop:{t[-1:] in '.!?:'}",
    ]


@dataclass(frozen=True)
class Model:
    unary: dict[str, float]
    edge: tuple[tuple[float, float], tuple[float, float]]


def _soft(a: float, b: float) -> float:
    hi = max(a, b)
    return hi + math.log(math.exp(a - hi) + math.exp(b - hi))


def marginals(parents: Sequence[int], unary: Sequence[float], edge) -> tuple[list[float], list[list[float]]]:
    """P(content) of each node, and the expected 2 by 2 counts of edges."""
    n = len(parents)
    up = [[0.0, u] for u in unary]  # own potential and messages of the children
    sent = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        a, b = up[i]
        sent[i] = m = (_soft(a + edge[0][0], b + edge[0][1]), _soft(a + edge[1][0], b + edge[1][1]))
        p = up[parents[i]]
        p[0] += m[0]
        p[1] += m[1]
    whole = [list(up[0])] + [[0.0, 0.0] for _ in range(n - 1)]
    out = [1 / (1 + math.exp(min(700, whole[0][0] - whole[0][1])))]
    counts = [[0.0, 0.0], [0.0, 0.0]]
    for i in range(1, n):
        p = whole[parents[i]]
        rest = (p[0] - sent[i][0], p[1] - sent[i][1])
        joint = [[rest[y] + edge[y][x] + up[i][x] for x in (0, 1)] for y in (0, 1)]
        whole[i] = [_soft(joint[0][0], joint[1][0]), _soft(joint[0][1], joint[1][1])]
        z = _soft(*whole[i])
        for y in (0, 1):
            for x in (0, 1):
                counts[y][x] += math.exp(joint[y][x] - z)
        out.append(math.exp(whole[i][1] - z))
    return out, counts


def _labels(nodes: Sequence[Node]) -> list[int]:
    """Marks hold for whole subtrees until another mark; the ancestors of content are content."""
    y: list[int] = []
    for n in nodes:
        y.append(n.label if n.label is not None else y[n.parent] if n.parent >= 0 else 0)
    for i in range(len(nodes) - 1, 0, -1):
        if y[i]:
            y[nodes[i].parent] = 1
    return y


def fit(pages: Sequence[str], steps: int = 80, rate: float = 0.3, l2: float = 0.002) -> Model:
    """Pages carry their labels as data-label="1" or "0" on elements."""
    data = []
    for html in pages:
        nodes = parse(html)
        data.append(([n.parent for n in nodes], [features(nodes, i) for i in range(len(nodes))], _labels(nodes)))
    w = dict.fromkeys((f for _, fs, _ in data for x in fs for f in x), 0.0)
    size = dict.fromkeys(w, 0.0)
    edge, grown = [[0.5, 0.0], [0.0, 0.5]], [[0.0, 0.0], [0.0, 0.0]]
    for _ in range(steps):
        g = dict.fromkeys(w, 0.0)
        ge = [[0.0, 0.0], [0.0, 0.0]]
        for parents, fs, y in data:
            got, counts = marginals(parents, [sum(w[f] for f in x) for x in fs], edge)
            for x, yes, p in zip(fs, y, got, strict=True):
                for f in x:
                    g[f] += yes - p
            for i in range(1, len(y)):
                ge[y[parents[i]]][y[i]] += 1
            for a in (0, 1):
                for b in (0, 1):
                    ge[a][b] -= counts[a][b]
        for f in w:
            d = g[f] / len(data) - l2 * w[f]
            size[f] += d * d
            w[f] += rate * d / (math.sqrt(size[f]) + 1e-8)
        for a in (0, 1):
            for b in (0, 1):
                d = ge[a][b] / len(data) - l2 * edge[a][b]
                grown[a][b] += d * d
                edge[a][b] += rate * d / (math.sqrt(grown[a][b]) + 1e-8)
    return Model(w, (tuple(edge[0]), tuple(edge[1])))


# fixed values: names that layouts give to what isn't the article
NAMES = "ad ads advert advertisement banner sponsor sponsored promo notice cookie consent alert popup modal newsletter subscribe share social related recommended sidebar widget menu breadcrumb navigation nav navbar toolbar header masthead footer copyright legal disclaimer comment comments reply replies respond discussion disqus login signup search form tags pagination".split()
BODY_NAMES = "content post entry article story main body text page wrapper container".split()


def layouts(n: int = 160, seed: int = 5) -> list[str]:
    """Labelled pages of common layouts."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(a, b)))

    def sentence(a: int = 3, b: int = 30) -> str:
        return words(a, b).capitalize() + "."

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"

    def filler(tag: str, name: str) -> str:
        inner = rng.choice([links, lambda: sentence(3, 40), lambda: f"<p>{sentence(3, 40)}</p>" * rng.randint(1, 3), lambda: f"<h3>{words(1, 4)}</h3><p>{sentence()}</p>" + links()])()
        attr = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f'<{tag}{attr} data-label="0">{inner}</{tag}>'

    def around() -> str:
        kind = rng.random()
        if kind < 0.35:
            return filler(rng.choice(["nav", "header", "footer", "aside", "form"]), rng.choice(["", "", rng.choice(NAMES)]))
        return filler(rng.choice(["div", "div", "section", "ul" if kind > 0.95 else "div"]), rng.choice(NAMES))

    def block() -> str:
        k = rng.random()
        if k < 0.2:  # one word or many, without a full stop
            return f"<p>{words(1, rng.choice([2, 8, 40, 300]))}</p>"
        if k < 0.62:
            return f"<p>{' '.join(sentence() for _ in range(rng.randint(1, 6)))}</p>"
        if k < 0.72:
            return f"<h2>{words(1, 8)}</h2>"
        if k < 0.8:
            return "<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if k < 0.85:
            return f"<blockquote>{sentence()}</blockquote>"
        if k < 0.89:
            return f"<pre>{words(2, 20)}</pre>"
        if k < 0.93:
            return "<table><tr>" + "".join(f"<td>{words(1, 4)}</td>" for _ in range(3)) + "</tr></table>"
        return f'<p>{sentence()} <a href="#">{words(1, 4)}</a> {sentence()}</p>'

    out = []
    for _ in range(n):
        blocks = [f"<h1>{words(2, 10)}</h1>"] * rng.randint(0, 1) + [block() for _ in range(rng.randint(1, 10))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            blocks.insert(rng.randint(0, len(blocks)), around())
        tag = rng.choice(["article", "article", "main", "div", "section"])
        name = f' class="{rng.choice(BODY_NAMES)}"' if tag in ("div", "section") or rng.random() < 0.4 else ""
        core = f'<{tag}{name} data-label="1">{"".join(blocks)}</{tag}>'
        if rng.random() < 0.4:
            core = f'<div class="{rng.choice(BODY_NAMES)}">{core}{around() if rng.random() < 0.5 else ""}</div>'
        out.append("<html><body>" + "".join(around() for _ in range(rng.randint(0, 3))) + core + "".join(around() for _ in range(rng.randint(0, 3))) + "</body></html>")
    return out


@lru_cache(1)
def default_model() -> Model:
    return fit(layouts())


def main_text(html: str, model: Model) -> str:
    nodes = parse(html)
    unary = [sum(model.unary.get(f, 0.0) for f in features(nodes, i)) for i in range(len(nodes))]
    p, _ = marginals([n.parent for n in nodes], unary, model.edge)
    found = (clean(n) for n, q in zip(nodes, p, strict=True) if n.tag == "#text" and q >= 0.5)
    return "\n".join(t for t in found if t)


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text and n_chars."""
    model = model or default_model()
    kind = pages.select(id_col).dtypes[0][1]

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(t, model) for t in texts_of(b.column(2))]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=[id_col, url_col, "text", "n_chars"])

        return step

    picked = pages.select(F.col(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias(html_col))
    return arrow_map(picked, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint", make)
