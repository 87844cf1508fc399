"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of elements (plain inline markup belongs to the element around it).  Each element is a wrapper (it holds content further down), content,
or neither.  An element's features depend on its label, and its label on that of its parent: a hidden Markov tree, whose tables are counts over labelled pages.  Messages pass once upward and once
downward (sum-product), which gives each element's exact probability of being content given the whole page.  The text of elements above one half is the main text.

Elements are kept in page order, parents before children, so both passes are loops and no depth of nesting overflows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import fresh

_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>)", re.S
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_LABEL = re.compile(r"\sdata-content\s*=\s*[\"']?([01])")
_WORD = re.compile(r"[a-z]+")

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template iframe title textarea select".split())
RAW = {tag: re.compile(f"</{tag}(?![a-z0-9:-])", re.I) for tag in ("script", "style", "iframe", "title", "textarea")}  # hold text only, up to their end tag
FOREIGN = frozenset(("math", "svg"))  # all elements inside stand in the line
INLINE = frozenset(
    "a abbr audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math noscript object q s samp small span strike strong sub sup svg time tt u var video".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
KNOWN = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form button".split()
)
# What words in class, id and role say about an element; the first kind found counts.
HINTS = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner".split(),
    "comment": "comment comments reply replies disqus discussion respond reader readers feedback".split(),
    "notice": "cookie cookies consent notice notices alert popup modal newsletter subscribe subscription gdpr overlay paywall dialog".split(),
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs skip".split(),
    "foot": "footer foot copyright legal contentinfo".split(),
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular rail complementary".split(),
    "share": "share social sharing follow tags byline meta".split(),
    "form": "form search login signup contact".split(),
    "head": "header head masthead topbar logo top".split(),
    "main": "content contents article post entry story main body text page".split(),
}
_HINT_OF = {word: kind for kind, words in reversed(HINTS.items()) for word in words}
_RANK = {kind: i for i, kind in enumerate(HINTS)}


@dataclass
class Tree:
    """Elements in page order: parent, features, label (if marked) and pieces of text as (place, block, text)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    hint: list[str] = field(default_factory=lambda: ["none"])
    label: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def hint_of(attrs: str) -> str:
    kinds = [_HINT_OF[w] for value in _NAMES.findall(attrs) for w in _WORD.findall(value.lower()) if w in _HINT_OF]
    return min(kinds, key=_RANK.__getitem__) if kinds else "none"


def parse(page: str) -> Tree:
    tree = Tree()
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the tree element each belongs to, -1 in a hidden one
    block = links = at = foreign = 0

    def text(raw: str) -> None:
        node = stack[-1][1]
        if node < 0:
            return
        if raw and not raw.isspace():
            raw = html.unescape(raw) if "&" in raw else raw
            tree.pieces.append((node, block, raw))
            tree.chars[node] += len(raw)
            if links:
                tree.linked[node] += len(raw)
        elif raw:
            tree.pieces.append((node, block, " "))

    def close(depth: int) -> None:
        nonlocal links, foreign
        links -= sum(tag == "a" for tag, _ in stack[depth:])
        foreign -= sum(tag in FOREIGN for tag, _ in stack[depth:])
        del stack[depth:]

    position = 0
    while found := _TOKEN.search(page, position):
        text(page[at : found.start()])
        at = position = found.end()
        name = found["tag"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
            block += not (foreign or name in INLINE)
            continue
        if name == "br":
            text(" ")
            continue
        attrs = found["attrs"]
        if attrs.rstrip().endswith("/") and (foreign or name in HIDDEN or name in FOREIGN):
            continue
        if name in RAW and not (foreign and name == "title"):
            stop = RAW[name].search(page, at)
            if stop or name in ("script", "style", "iframe"):  # these last to the end of the page if nothing ends them, the others no longer than their parent
                over = page.find(">", stop.end()) if stop else -1
                at = position = len(page) if over < 0 else over + 1
                continue
        if foreign and name in CLOSES_P:  # a block ends a formula or drawing that is still open
            close(next(depth for depth, (tag, _) in enumerate(stack) if tag in FOREIGN))
        inline = foreign or name in INLINE
        block += not inline
        if name in VOID:
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if name in CLOSED_BY:
            ended, bounds = CLOSED_BY[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in bounds:
                    break
                if stack[depth][0] in ended:
                    close(depth)
                    if name not in ("tr",):
                        break
        hint = hint_of(attrs) if attrs else "none"
        node = -1 if name in HIDDEN and not foreign else stack[-1][1]
        if node >= 0 and (not inline or hint not in ("none", "main")):
            mark = _LABEL.search(attrs) if "data-content" in attrs else None
            tree.parent.append(node)
            tree.tag.append(name if name in KNOWN else "other")
            tree.hint.append(hint)
            tree.label.append(int(mark[1]) if mark else tree.label[node])
            tree.chars.append(0)
            tree.linked.append(0)
            node = len(tree.tag) - 1
        links += name == "a"
        foreign += name in FOREIGN
        stack.append((name, node))
    text(page[at:])
    return tree


def features(tree: Tree) -> list[tuple[str, ...]]:
    """Per element: its tag, that of its parent, what its names hint at, and how much text and link text it holds itself."""
    out = []
    for tag, parent, hint, chars, linked in zip(tree.tag, tree.parent, tree.hint, tree.chars, tree.linked, strict=True):
        size = "0" if chars == 0 else "short" if chars < 25 else "line" if chars < 100 else "long"
        links = "-" if chars == 0 else "none" if linked == 0 else "some" if 2 * linked < chars else "most"
        up = tree.tag[parent] if parent >= 0 else "#none"
        out.append((f"tag {tag}", f"up {tag}<{up}", f"hint {hint}", f"text {size} {links}"))
    return out


WRAPPER, CONTENT, OTHER = LABELS = (0, 1, 2)


def labels(tree: Tree) -> list[int]:
    """Labels of a marked page: content as marked, wrapper where some element below is content, else other."""
    out = [CONTENT if mark else OTHER for mark in tree.label]
    for i in range(len(out) - 1, 0, -1):
        if out[i] != OTHER and out[tree.parent[i]] == OTHER:
            out[tree.parent[i]] = WRAPPER
    return out


def count_labels(page: str) -> Counter:
    """Occurrences of (kind, key, label) that the tables are made of."""
    tree = parse(page)
    marks = labels(tree)
    counts: Counter = Counter()
    for i, names in enumerate(features(tree)):
        for name in names:
            counts["feature", name, marks[i]] += 1
        if i:
            counts["edge", str(marks[tree.parent[i]]), marks[i]] += 1
    return counts


class Model:
    """Tables of the hidden Markov tree, from (kind, key, label, n) counts with one half added to each."""

    def __init__(self, counts: list[tuple[str, str, int, int]]) -> None:
        n = {(kind, key, y): float(c) for kind, key, y, c in counts}
        vocabulary = {"tag": len(KNOWN) + 2, "up": 120, "hint": len(HINTS) + 1, "text": 10}
        totals = {(g, y): 0.5 * size for g, size in vocabulary.items() for y in LABELS}
        for (kind, key, y), c in n.items():
            if kind == "feature":
                totals[key.split()[0], y] += c
        keys = {key for kind, key, _ in n if kind == "feature"} | {f"{g} " for g in vocabulary}  # the latter stand for unseen values
        self.emit = {key: tuple((n.get(("feature", key, y), 0.0) + 0.5) / totals[key.split()[0], y] for y in LABELS) for key in keys}
        self.move = [[(n.get(("edge", str(p), y), 0.0) + 0.5) / sum(n.get(("edge", str(p), z), 0.0) + 0.5 for z in LABELS) for y in LABELS] for p in LABELS]

    def marginals(self, tree: Tree) -> list[list[float]]:
        """Probabilities of the labels of each element, by one upward and one downward pass."""
        size, move, emit = len(tree.tag), self.move, self.emit
        belief = []
        for names in features(tree):
            own = [1.0, 1.0, 1.0]
            for name in names:
                a, b, c = emit.get(name) or emit[f"{name.split()[0]} "]
                own = [own[0] * a, own[1] * b, own[2] * c]
            belief.append(own)
        belief[0] = [1.0, 0.01, 1.0]  # the page as such is a wrapper or holds nothing
        up = [[1.0, 1.0, 1.0]] * size
        for i in range(size - 1, 0, -1):
            x, y, z = belief[i]
            message = [m[0] * x + m[1] * y + m[2] * z for m in move]
            scale = sum(message)
            message = up[i] = [max(v / scale, 1e-200) for v in message]
            a, b, c = belief[tree.parent[i]]
            a, b, c = a * message[0], b * message[1], c * message[2]
            scale = a + b + c
            belief[tree.parent[i]] = [max(v / scale, 1e-200) for v in (a, b, c)]
        total = sum(belief[0])
        out = [[v / total for v in belief[0]]]
        for i in range(1, size):
            above, message, here = out[tree.parent[i]], up[i], belief[i]
            rest = [p / m for p, m in zip(above, message, strict=True)]
            joint = [(rest[0] * move[0][y] + rest[1] * move[1][y] + rest[2] * move[2][y]) * here[y] for y in LABELS]
            total = sum(joint)
            out.append([v / total for v in joint])
        return out

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        tree = parse(page)
        content = [p[CONTENT] > 0.5 for p in self.marginals(tree)]
        blocks: list[str] = []
        now, parts = -1, []
        for node, block, piece in tree.pieces:
            if not content[node]:
                continue
            if block != now:
                blocks.append("".join(parts))
                now, parts = block, []
            parts.append(piece)
        blocks.append("".join(parts))
        return "\n\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def fit(labelled: DataFrame, page: str = "html") -> Model:
    """Tables from pages whose elements carry ``data-content`` (1 or 0, inherited; 0 without any).

    Counts are summed up in Spark; the table that is collected has a fixed number of rows.  Without pages all labels are equally likely, and nothing is content.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(count_labels(text or ""))
        rows = [(*key, n) for key, n in counts.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "key", "y", "n"), r, strict=True)) for r in rows], schema=pa.schema([("kind", pa.string()), ("key", pa.string()), ("y", pa.int32()), ("n", pa.int64())]))

    counted = labelled.select(page).mapInArrow(count, "kind string, key string, y int, n bigint")
    return Model([tuple(r) for r in counted.groupBy("kind", "key", "y").agg(F.sum("n")).collect()])


def extract_pages(pages: DataFrame, model: Model, page: str = "html") -> DataFrame:
    """All columns of ``pages`` but the markup, plus ``text`` (empty if there is none) and ``n_chars``.

    Null and empty pages give an empty text.  Repeated rows are extracted each.  Columns of ``pages`` named like a result are replaced.
    """

    def extracted(pages_: Iterator) -> Iterator:
        for part in pages_:
            yield part.map(model.extract, na_action=None)

    extracted.__annotations__ = {"pages_": Iterator[pd.Series], "return": Iterator[pd.Series]}
    name = fresh(pages, "h_text")
    keep = [c for c in pages.columns if c != page and c.lower() not in ("text", "n_chars")]
    udf = F.pandas_udf(extracted, "string").asNondeterministic()
    return pages.withColumn(name, udf(F.col(page))).select(*keep, F.col(name).alias("text"), F.length(name).cast("bigint").alias("n_chars"))
