"""Main text of web pages by a tree-structured graphical model over their block elements.

A page becomes the tree of its block elements; each has a hidden label (main text or not). The joint probability is
that of the root, of each child's label given its parent's (by the child's tag) and of each element's features given
its label. Sum-product message passing, up the tree and down again, gives every element's marginal in two passes; the
text blocks of elements whose marginal is above one half are the main text, in page order. All probabilities are counts (with a
prior) from labelled pages: ``labelled_pages`` makes a fixed set with the layouts and names that pages use, and
``train`` takes any other.

Defined cases: a null or empty page, or one without main text, gives an empty text; unclosed elements end with the page,
stray end tags are ignored; scripts, styles and comments are never text; an attribute ``data-main`` of a page's own means nothing;
very long pages are read whole; repeated rows and null ids or urls are kept as they come; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, map_batches

# Fixed values of HTML.
BLOCKS = frozenset(
    (
        "html head title body header footer nav main article section aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
        "blockquote pre figure figcaption form fieldset legend label select option button textarea address details summary dialog menu hgroup search noscript hr iframe"
    ).split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = "script|style|template|iframe|textarea|select"
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<unread>{UNREAD})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=unread)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?<![\w-])(class|id|role|data-main|hidden|style)(?![\w-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Tree:
    """Block elements in page order: parent, tag, names; and the text blocks with their elements."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    label: list[int | None] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    ends: list[bool] = field(default_factory=list)  # with a sentence's end
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: list[str], label: int | None) -> int:
        for values, value in ((self.parent, parent), (self.tag, tag), (self.names, names), (self.label, label), (self.chars, 0), (self.linked, 0), (self.ends, False)):
            values.append(value)
        return len(self.tag) - 1


def parse(page: str, labelled: bool = False) -> Tree:
    """The tree of a whole page; ``labelled`` reads the labels of pages that are made for training."""
    tree = Tree()
    stack = [tree.add(-1, "#page", [], None)]
    held: list[str] = []
    links, at = 0, 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                tree.blocks.append((stack[-1], text))
                tree.ends[stack[-1]] |= text[-1] in ".!?…:\"”»"

    def text(raw: str) -> None:
        if raw:
            raw = html.unescape(raw)
            held.append(raw)
            n = len(raw.strip())
            tree.chars[stack[-1]] += n
            if links:
                tree.linked[stack[-1]] += n

    for found in _TOKEN.finditer(page):
        text(page[at : found.start()])
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links = 0 if found["end"] else 1
        if tag == "br":
            held.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        links = 0
        if found["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[depth]] == tag:
                    del stack[depth:]
                    break
            continue
        if tag not in ("html", "body", "head") and tree.tag[stack[-1]] == "p":
            stack.pop()
        shuts = CLOSED_BY.get(tag, ())
        while len(stack) > 1 and tree.tag[stack[-1]] in shuts:
            stack.pop()
        names, label = [], None
        for name in _NAMES.finditer(found["attributes"] or ""):
            value = name[2] or name[3] or name[4] or ""
            kind = name[1].lower()
            if kind == "data-main":
                label = int(value) if labelled and value in ("0", "1") else label
            elif kind == "hidden" or kind == "style" and _UNSEEN.search(value):
                names.append("hidden")
            elif kind != "style":
                names += [x.lower() for x in _PARTS.findall(value)]
        node = tree.add(stack[-1], tag, names, label)
        if tag not in VOID:
            stack.append(node)
    text(page[at:])
    flush()
    return tree


def features(tree: Tree, node: int) -> Iterable[str]:
    """Names of what an element shows, its tag apart."""
    n = tree.chars[node]
    for name in set(tree.names[node]):
        yield f"name {name}"
    if n:
        yield f"chars {min(4, int(math.log(n, 4)))}"
        yield f"linked {int(3.99 * min(1.0, tree.linked[node] / n))}"
        yield f"ends {tree.ends[node]}"
    else:
        yield "chars none"


@dataclass
class Model:
    """Log probabilities: of features given a label, of a child's label given its tag and its parent's label."""

    feature: dict[str, tuple[float, float]]
    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]

    def marginals(self, tree: Tree) -> list[float]:
        """P(main text) of every element, by messages from children to parents and back."""
        n = len(tree.tag)
        own = [[0.0, 0.0] for _ in range(n)]
        for node in range(n):
            for name in features(tree, node):
                if (p := self.feature.get(name)) is not None:
                    own[node][0] += p[0]
                    own[node][1] += p[1]
        edges = [self.edge.get(t, self.edge["*"]) for t in tree.tag]
        up = [[0.0, 0.0] for _ in range(n)]  # message to the parent
        for node in range(n - 1, 0, -1):  # children come after their parents
            for y in (0, 1):
                up[node][y] = _either(edges[node][y][0] + own[node][0], edges[node][y][1] + own[node][1])
            own[tree.parent[node]][0] += up[node][0]
            own[tree.parent[node]][1] += up[node][1]
        belief = own  # own potential and all messages from below
        belief[0] = [belief[0][0], belief[0][1] - 20.0]  # the page itself is no main text
        for node in range(1, n):
            parent = tree.parent[node]
            rest = [belief[parent][y] - up[node][y] for y in (0, 1)]
            down = [_either(rest[0] + edges[node][0][z], rest[1] + edges[node][1][z]) for z in (0, 1)]
            belief[node] = [belief[node][0] + down[0], belief[node][1] + down[1]]
        return [1 / (1 + math.exp(min(700.0, b[0] - b[1]))) for b in belief]


def _either(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def train(pages: Iterable[str], prior: float = 0.5) -> Model:
    """Counts over pages whose elements bear ``data-main="0"`` or ``"1"``; an element without it has its parent's label."""
    seen, n, edges = {}, Counter(), {}
    for page in pages:
        tree = parse(page, labelled=True)
        labels = []
        for node, label in enumerate(tree.label):
            labels.append(label if label is not None else labels[tree.parent[node]] if node else 0)
            if node:
                for key in (tree.tag[node], "*"):
                    edges.setdefault(key, Counter())[labels[tree.parent[node]], labels[node]] += 1
            n[labels[node]] += 1
            for name in features(tree, node):
                seen.setdefault(name, Counter())[labels[node]] += 1
    feature = {name: tuple(math.log((c[y] + prior) / (n[y] + 2 * prior)) for y in (0, 1)) for name, c in seen.items()}
    edge = {tag: tuple(tuple(math.log((c[y, z] + prior) / (c[y, 0] + c[y, 1] + 2 * prior)) for z in (0, 1)) for y in (0, 1)) for tag, c in edges.items()}
    return Model(feature, edge)


# Names that pages give to what isn't main text, by part of the page, and to what is.
NOT_MAIN = {
    "nav": "nav menu navbar breadcrumb breadcrumbs pagination pager toc tabs skip navigation",
    "header": "header masthead banner topbar logo branding site",
    "footer": "footer copyright legal colophon bottom contentinfo imprint",
    "aside": "sidebar aside related widget recommended trending popular more complementary promo teaser tags",
    "div": "ad ads advert advertisement sponsored sponsor cookie consent gdpr notice alert popup modal overlay newsletter subscribe signup share social sharing hidden paywall disclaimer",
    "section": "comments comment replies reply respond discussion disqus feedback reader readers commentlist",
    "form": "form search login contact signin",
}
MAIN = "article content main post entry body text story page hentry primary column prose paragraph"


def labelled_pages(n: int = 400, seed: int = 11) -> Iterable[str]:
    """Labelled pages of many layouts, the same ones each time."""
    draw = random.Random(seed)

    def words(low: int, high: int, stop: str = ".") -> str:
        return " ".join("".join(draw.choice("aeiounrstlmd") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(low, high))).capitalize() + stop

    def link() -> str:
        return f'<a href="/x">{words(1, 4, "")}</a>'

    def named(names: str) -> str:
        return f' class="{" ".join(draw.sample(names.split(), draw.choice([1, 1, 2])))}"' if draw.random() < 0.8 else ""

    def outside(kind: str) -> str:
        inner = {
            "nav": lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(draw.randint(2, 8))) + "</ul>",
            "header": lambda: f"<div>{link()}</div><p>{words(2, 6, '')}</p>" + draw.choice(["", f"<h1>{words(1, 3, '')}</h1>"]),
            "footer": lambda: draw.choice([words(3, 20), f"<p>&copy; {words(2, 12)}</p>", f"{link()} {link()}", f"<ul><li>{link()}</li><li>{link()}</li></ul>"]),
            "aside": lambda: f"<h3>{words(1, 4, '')}</h3>" + draw.choice([f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{words(5, 40)}</p>"]),
            "div": lambda: draw.choice([words(3, 30), f"<p>{words(4, 40)}</p>", f"{words(3, 12)} {link()}", f"<p>{words(5, 20)}</p><button>{words(1, 2, '')}</button>"]),
            "section": lambda: f"<h2>{words(1, 3, '')}</h2>" + "".join(f'<div{draw.choice(["", " class=comment"])}><p>{words(3, 80)}</p></div>' for _ in range(draw.randint(1, 5))),
            "form": lambda: f"<label>{words(1, 4, '')}</label><input><button>{words(1, 2, '')}</button><p>{words(3, 12)}</p>",
        }[kind]()
        tag = kind if kind in ("div", "section") or draw.random() < 0.7 else "div"
        names = f' class="{draw.choice(NOT_MAIN[kind].split())}"' if tag in ("div", "section") else named(NOT_MAIN[kind])
        if tag != "form" and draw.random() < 0.15 and names:
            names = names.replace("class=", "id=")
        return f'<{tag}{names} data-main="0">{inner}</{tag}>'

    def inside() -> str:
        kind = draw.random()
        if kind < 0.7:
            text = words(1, draw.choice([8, 60, 200]), draw.choice([".", ".", ".", "?", "", ":"]))
            return f"<p>{draw.choice(['', '', '<b>'])}{text}{draw.choice([' ' + link(), '', '', '<br>'])}{draw.choice(['</p>', '</p>', ''])}"
        if kind < 0.8:
            return f"<h2>{words(1, 7, '')}</h2>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{words(2, 20)}</li>" for _ in range(draw.randint(2, 5))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if kind < 0.94:
            return f"<table><tr><th>{words(1, 3, '')}</th></tr><tr><td>{words(1, 6, '')}</td></tr></table>"
        if kind < 0.96:
            return f"<pre>{words(3, 20, '')}</pre>"
        if kind < 0.98:
            return f"<div>{words(5, 60)}</div>"
        return f"<figure><figcaption>{words(3, 12)}</figcaption></figure>"

    for _ in range(n):
        tag = draw.choice(["article", "article", "article", "main", "div", "section"])
        names = named(MAIN) if tag != "div" else f' class="{draw.choice(MAIN.split())}"'
        main = draw.choice(["", f"<h1>{words(1, 10, '')}</h1>", f"<h1>{words(1, 10)}</h1>"]) + "".join(inside() for _ in range(draw.randint(1, 12)))
        if draw.random() < 0.4:
            main += outside(draw.choice(list(NOT_MAIN)))
        if draw.random() < 0.2:
            main = outside(draw.choice(list(NOT_MAIN))) + main
        if draw.random() < 0.1:
            main = f'<noscript data-main="0">{words(3, 12)}</noscript>{main}'
        if draw.random() < 0.2:
            main += f'<p {draw.choice(["hidden", "style=display:none", "style=visibility:hidden"])} data-main="0">{words(3, 40)}</p>'
        if tag == "article" and draw.random() < 0.2:
            main = f"<div{named(MAIN)}>{main}</div>"
        main = f'<{tag}{names} data-main="1">{main}</{tag}>'
        if draw.random() < 0.4:
            main = f'<{draw.choice(["main", "div"])} data-main="0">{main}{"".join(outside(k) for k in draw.sample(list(NOT_MAIN), draw.randint(0, 2)))}'
        before = "".join(outside(k) for k in ("header", "nav", "div", "form") if draw.random() < 0.6)
        after = "".join(outside(k) for k in ("section", "aside", "div", "form", "footer") if draw.random() < 0.5)
        yield f"<html><head><title>{words(2, 8, '')}</title></head><body>{before}{main}{after}</body></html>"


@functools.cache
def standard() -> Model:
    """The model of the fixed pages, trained once."""
    return train(labelled_pages())


def main_text(page: str | None, model: Model) -> str:
    """The main text of a page, a line for each block."""
    tree = parse(page or "")
    marginal = model.marginals(tree)
    return "\n".join(text for node, text in tree.blocks if marginal[node] > 0.5)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    shipped = pages.sparkSession.sparkContext.broadcast(model or standard())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, shipped.value) for h in column(batch, "html")]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return map_batches(pages.select("page_id", "url", F.col("html")), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
