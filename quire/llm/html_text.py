"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A node counts as content if its subtree holds any of the main text. Boosted
trees estimate that for every node from subtree density, attribute tokens,
depth and sibling statistics. Decoding then picks the likeliest labelling of
the whole tree in which nothing below a dropped node is kept, so an ancestor
and a descendant never contradict each other.

The model is trained here, on pages laid out at random by `sample_page`, whose
labels are known; `pages` has none. The sample is bounded by `TRAIN_PAGES`.

Edge cases: null or empty html, and a page without content, give an empty
text with 0 code points; a tag whose quote is never closed ends at its next
bracket, one without a bracket at the end of the page is dropped, end tags
without a start are passed over; the time to read a page grows with its length
and that of its memory with its nodes, whatever it holds; ids and urls are
passed on as they are, null and repeated ones too; columns of pages may have any
names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the fit.
TRAIN_PAGES, TREES, DEPTH, BINS, RATE = 500, 40, 4, 32, 0.3
#: Nodes whose features are in memory at once, and bytes of html to a batch.
NODES, BATCH_BYTES = 8192, 4_000_000

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is not markup, and elements whose subtree is dropped.
RAW = frozenset("script style noscript textarea title iframe".split())
DROPPED = frozenset("template select svg object button".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag in the key set ends an open element of the value set, up to the given bounds.
CLOSES = {t: ({"p"}, set()) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
#: These look past open inline elements only; the others past everything up to their bounds.
PAST_INLINE = frozenset(CLOSES)
CLOSES |= {"li": ({"p", "li"}, {"ul", "ol"}), "dt": ({"p", "dt", "dd"}, {"dl"}), "dd": ({"p", "dt", "dd"}, {"dl"}), "tr": ({"td", "th", "tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAGS = ["article", "main", "nav", "header", "footer", "aside", "form", "p", "h1", "h2", "ul", "li", "div", "section", "body", "table", "blockquote", "pre", "figure", "address"]
#: Attribute tokens by what they tell.
TOKENS = {
    "content": "article content main post entry story text prose body read",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner",
    "menu": "nav navigation menu breadcrumb breadcrumbs pagination pager tabs skip toolbar",
    "frame": "header masthead topbar footer copyright bottom legal",
    "side": "sidebar aside related widget rail recommended trending popular tags share social",
    "comment": "comment comments reply replies discussion respond disqus reader readers",
    "notice": "notice cookie consent alert popup modal newsletter subscribe signup warning gdpr overlay",
    "form": "form search login register contact input",
}
GROUP_OF = {w: i for i, ws in enumerate(TOKENS.values()) for w in ws.split()}


class Node:
    __slots__ = ("tag", "parent", "depth", "groups", "parts", "children", "own", "size", "linked", "tags", "paragraphs", "stops", "start")

    def __init__(self, tag: str, parent: Node | None, groups: int, start: int) -> None:
        self.tag, self.parent, self.groups, self.start = tag, parent, groups, start
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list[str | Node] = []
        self.children: list[Node] = []


def _raw_end(tag: str, html: str, at: int) -> int:
    end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
    return end.end() if end else len(html)


def _tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of each piece of markup; the name is empty for comments and declarations.

    The content of raw elements is passed over. Every search starts where the
    last one ended; quotes that lead nowhere are ignored from then on, so the
    time is linear.
    """
    at, quoted, open_svg, n = 0, True, 0, len(html)
    while (start := html.find("<", at)) >= 0:
        after = html[start + 1 : start + 2]
        if after in ("!", "?"):
            comment = html.startswith("<!--", start)
            end = html.find("-->" if comment else ">", start + (4 if comment else 2))
            at = n if end < 0 else end + (3 if comment else 1)
            yield start, at, "", False, ""
            continue
        m = NAME.match(html, start + 1)
        if not m:
            at = start + 1
            continue
        i = m.end()
        while quoted:
            i = PLAIN.match(html, i).end()
            if html[i : i + 1] == ">":
                break
            close = html.find(html[i], i + 1) if i < n else -1
            if close < 0:
                quoted = False
            i = close + 1
        if not quoted:
            i = html.find(">", m.end())
        if i < 0:
            yield start, n, "", False, ""
            return
        at = i + 1
        name, ends, attributes = m[2].lower(), bool(m[1]), html[m.end() : i]
        yield start, at, name, ends, attributes
        open_svg += (-1 if ends else not attributes.endswith("/")) if name == "svg" else 0
        if name in RAW and not ends and not (attributes.endswith("/") and open_svg > 0):
            start, at = at, _raw_end(name, html, at)
            yield start, at, "", False, ""


def _ended(tags: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """Where start tags of dropped elements are that have an end tag; one without holds nothing."""
    open_at: dict[str, list[int]] = {t: [] for t in DROPPED}
    ended = set()
    for start, _, tag, ends, attributes in tags:
        if tag in DROPPED and ends:
            if open_at[tag]:
                ended.add(open_at[tag].pop())
        elif tag in DROPPED and not (tag == "svg" and attributes.endswith("/")):
            open_at[tag].append(start)
    return ended


class Open:
    """The open tags below the root, inline ones too, and where on the stack each kind lies."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []  # places of those that are not inline

    def push(self, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append(tag)

    def pop(self) -> str:
        tag = self.stack.pop()
        self.places[tag].pop()
        if tag not in INLINE:
            self.solid.pop()
        return tag

    def last(self, tags: set[str] | tuple[str, ...]) -> int:
        """The topmost place of any of the tags; -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def ended_by(self, tag: str) -> int:
        """The place of an open element that a start tag ends, -1 if there is none."""
        ends, bounds = CLOSES[tag]
        at = self.last(ends)
        if tag in PAST_INLINE:
            return at if at >= 0 and self.solid[-1] == at else -1
        return at if at > self.last(bounds) else -1


def parse(html: str) -> list[Node]:
    """The block elements in document order, the root first; inline elements only leave their text, dropped ones nothing."""
    root = Node("root", None, 0, 0)
    nodes, node, links, at, hidden, size = [root], root, 0, 0, 0, 0
    tags = list(_tags(html))
    ended = _ended(tags)
    held = Open()
    root.linked = 0

    def close(n: int) -> None:
        nonlocal node, links, hidden
        while len(held.stack) > n:
            tag = held.pop()
            if tag == "a":
                links -= 1
            hidden -= tag in DROPPED
            if tag not in INLINE:
                node = node.parent

    for start, end, tag, ends, attributes in tags:
        if start > at:
            text = html[at:start]
            node.parts.append(text)
            if links:
                node.linked += len(text)
            size += 0 if hidden else len(text)
        at = end
        if not tag:
            continue
        if ends:
            if (place := held.last((tag,))) >= 0:
                close(place)
            continue
        if attributes.endswith("/") and (tag == "svg" or held.places.get("svg")) or tag in DROPPED and start not in ended or tag in RAW:
            continue
        if tag in CLOSES:
            while (place := held.ended_by(tag)) >= 0:
                close(place)
        if tag in VOID:
            if tag not in ("wbr", "img"):
                node.parts.append(" ")
            continue
        if tag in INLINE:
            links += tag == "a"
        else:
            groups = 0
            for a in ATTRIBUTE.finditer(attributes):
                for w in WORDS.findall(a[1] or a[2] or a[3] or ""):
                    if (g := GROUP_OF.get(w.lower())) is not None:
                        groups |= 1 << g
            child = Node(tag, node, groups, size)
            child.linked = 0
            hidden += tag in DROPPED
            if not hidden:
                node.parts.append(child)
                node.children.append(child)
                nodes.append(child)
            node = child
        if not attributes.endswith("/") or tag not in INLINE:
            held.push(tag)
    if at < len(html):
        node.parts.append(html[at:])
    for n in reversed(nodes):
        text = "".join(p for p in n.parts if isinstance(p, str))
        n.own = len(text.strip())
        n.stops = text.count(".") + text.count(",") + text.count("?")
        n.size, n.tags, n.paragraphs = n.own, 1, int(n.tag == "p")
        for c in n.children:
            n.size += c.size
            n.linked += c.linked
            n.tags += c.tags
            n.paragraphs += c.paragraphs
            n.stops += c.stops
    return nodes


def features(nodes: list[Node]) -> Iterator[list[float]]:
    whole, above = max(nodes[0].size, 1), {}
    for n in nodes:
        p = n.parent
        groups, tags = above[id(p)] if p else (0, 0)
        code = TAGS.index(n.tag) if n.tag in TAGS else len(TAGS)
        siblings = p.children if p else nodes[:1]
        if p and (id(p), "s") not in above:
            above[id(p), "s"] = (len(siblings), sum(c.size for c in siblings), Counter(c.tag for c in siblings))
        count, held, same = above[id(p), "s"] if p else (1, n.size, {n.tag: 1})
        row = [n.depth, math.log1p(n.size), math.log1p(n.own), n.linked / max(n.size, 1), n.size / n.tags, math.log1p(n.paragraphs), n.stops / max(n.size, 1) * 100, n.start / whole, n.size / whole, count, same[n.tag], n.size / max(held, 1), held / count, p.linked / max(p.size, 1) if p else 0.0]
        row += [float(code == i) for i in range(len(TAGS))]
        row += [float(tags >> i & 1) for i in range(7)]  # below article, main, nav, header, footer, aside, form
        row += [float(n.groups >> i & 1) for i in range(len(TOKENS))]
        row += [float(groups >> i & 1) for i in range(len(TOKENS))]
        yield row
        above[id(n)] = (groups | n.groups, tags | (1 << code if code < 7 else 0))


# --- the model -------------------------------------------------------------


class BoostedTrees:
    """Boosted regression trees on the logistic loss, over binned features; a tree is a complete one of DEPTH levels."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        share = y.mean()
        self.base, self.trees = math.log(share / (1 - share)), []
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            leaf, splits = np.zeros(len(y), int), []
            for level in range(DEPTH):
                for node in range(1 << level):
                    rows = np.flatnonzero(leaf == node)
                    splits.append(self._split(bins[rows], grad[rows], hess[rows]))
                at = np.array(splits[-(1 << level) :])
                f, b = at[leaf, 0], at[leaf, 1]
                leaf = leaf * 2 + (bins[np.arange(len(y)), f] > b)
            size = 1 << DEPTH
            value = RATE * np.bincount(leaf, grad, size) / (np.bincount(leaf, hess, size) + 1.0)
            score += value[leaf]
            self.trees.append((np.array(splits), value))

    @staticmethod
    def _split(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int]:
        best = (0.0, 0, BINS)
        if len(grad) < 20:
            return best[1:]
        g, h = grad.sum(), hess.sum()
        for f in range(bins.shape[1]):
            gl, hl = np.cumsum(np.bincount(bins[:, f], grad, BINS)), np.cumsum(np.bincount(bins[:, f], hess, BINS))
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            b = int(np.argmax(gain))
            if gain[b] > best[0] + 1e-9:
                best = (float(gain[b]), f, b)
        return best[1:]

    def logits(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        score, every = np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.trees:
            leaf = np.zeros(len(x), int)
            for level in range(DEPTH):
                at = splits[(1 << level) - 1 :][leaf]
                leaf = leaf * 2 + (bins[every, at[:, 0]] > at[:, 1])
            score += value[leaf]
        return score


def sample_page(rnd: random.Random) -> tuple[str, str]:
    """A page laid out at random, and its main text. Content words start with c, all others with b."""

    def say(kind: str, least: int, most: int) -> str:
        return " ".join(kind + "".join(rnd.choice("aeionrst") for _ in range(rnd.randint(1, 8))) + rnd.choice(["", "", "", "", ",", "."]) for _ in range(rnd.randint(least, most))) + "."

    def tag(names: str, group: str, inner: str, named: float = 0.8) -> str:
        name, kind = rnd.choice(names.split()), rnd.choice(["class", "id"])
        token = rnd.choice(TOKENS[group].split()) if group and rnd.random() < named else rnd.choice(["", "x1", "col", "box", "wrap", "c-2"])
        more = rnd.choice(["", "", "-box", "_wrap", " row", "-" + str(rnd.randint(1, 9))])
        return f'<{name} {kind}="{token}{more}">{inner}</{name}>' if token else f"<{name}>{inner}</{name}>"

    def links(n: int, most: int = 3) -> str:
        items = [f'<a href="/{i}">{say("b", 1, most)[:-1]}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rnd.random() < 0.7 else rnd.choice([" | ", " ", ""]).join(items)

    def paragraph() -> str:
        text = say("c", 1, 90) if rnd.random() < 0.8 else say("c", 1, 6)
        if rnd.random() < 0.15:
            text = f'{text} <a href="/x">{say("c", 1, 4)}</a> {say("c", 1, 9)}'
        kind = rnd.random()
        if kind < 0.1:
            return f"<p><b>{text}<br><p>{say('c', 1, 60)}</p>"
        if kind < 0.15:
            return "<ul>" + "".join(f"<li>{say('c', 2, 14)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>"
        if kind < 0.2:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.25:
            return f"<h2>{say('c', 2, 7)[:-1]}</h2><p>{text}</p>"
        return f"<p>{text}</p>" if kind < 0.95 else f"<div>{text}</div>"

    def junk(where: str) -> str:
        kind = rnd.choice(["ad", "ad", "notice", "side", "comments", "form", "share"] if where == "page" else ["ad", "side", "comments", "share"])
        if kind == "ad":
            return tag("div div aside section", "advert", rnd.choice([say("b", 2, 25), f"<p>{say('b', 2, 25)}</p>", f'<a href="/ad">{say("b", 2, 12)}</a>']), 0.95)
        if kind == "notice":
            return tag("div section p", "notice", say("b", 4, 30), 0.95)
        if kind == "side":
            return tag("aside aside div", "side", f"<h3>{say('b', 1, 3)[:-1]}</h3>" + (links(rnd.randint(2, 8), 9) if rnd.random() < 0.6 else f"<p>{say('b', 4, 40)}</p>"), 0.95)
        if kind == "comments":
            return tag("div section ul", "comment", "".join(tag("div li", "comment", f"<p>{say('b', 3, 60)}</p>", 0.5) for _ in range(rnd.randint(1, 6))), 1)
        if kind == "form":
            return tag("form form div", "form", f"<label>{say('b', 1, 3)}</label><input name=q><p>{say('b', 1, 9)}</p>", 0.9)
        return tag("div ul", "side", links(rnd.randint(2, 5)), 0.9)

    n = rnd.choice([1, 2, 4, 8, 15, 40])
    body = [paragraph() for _ in range(rnd.randint(max(1, n // 2), n))]
    title = f"<h1>{say('c', 1, 9)[:-1]}</h1>" if rnd.random() < 0.85 else ""
    while rnd.random() < 0.3:
        body.insert(rnd.randint(0, len(body)), junk("inside"))
    main = title + "".join(body)
    kind = rnd.random()
    main = f"<article>{main}</article>" if kind < 0.45 else tag("main article section div", "content", main, 0.95)
    if rnd.random() < 0.3:
        main = tag("div main section", "content", main, 0.5)
    top = []
    if rnd.random() < 0.5:
        top.append(tag("header header div", "frame", (f"<h1>{say('b', 1, 3)[:-1]}</h1>" if rnd.random() < 0.2 else "") + rnd.choice([f"<p>{say('b', 1, 8)}</p>", say("b", 1, 8), ""]) + (links(rnd.randint(1, 6)) if rnd.random() < 0.4 else ""), 0.8))
    if rnd.random() < 0.8:
        top.append(tag("nav nav nav div ul", "menu", links(rnd.randint(2, 9)), 0.6))
    while rnd.random() < 0.5:
        top.append(junk("page"))
    bottom = []
    while rnd.random() < 0.4:
        bottom.append(junk("page"))
    if rnd.random() < 0.85:
        bottom.append(tag("footer footer footer div", "frame", rnd.choice([f"<p>{say('b', 2, 30)}</p>", f"&copy; {say('b', 2, 30)}", links(3) + say("b", 1, 6)]), 0.6 if rnd.random() < 0.5 else 1))
    page = "".join(top) + main + "".join(bottom)
    if rnd.random() < 0.2:
        page = f'<div id="page">{page}</div>'
    page = f"<!DOCTYPE html><html><head><title>{say('b', 1, 5)}</title><style>p{{}}</style></head><body>{page}" + rnd.choice(["</body></html>", ""])
    text = " ".join(w for w in re.sub(r"<[^>]*>", " ", page[page.index("<body>") :]).split() if w[0] == "c")
    return page, text


@lru_cache(maxsize=1)
def trained() -> BoostedTrees:
    rnd, x, y = random.Random(8), [], []
    for _ in range(TRAIN_PAGES):
        nodes = parse(sample_page(rnd)[0])
        x += list(features(nodes))
        held: dict[int, bool] = {}
        for n in reversed(nodes):
            held[id(n)] = any(w[0] == "c" for p in n.parts if isinstance(p, str) for w in p.split()) or any(held[id(c)] for c in n.children)
        y += [held[id(n)] for n in nodes]
    return BoostedTrees(np.array(x), np.array(y, float))


def decode(nodes: list[Node], logits: np.ndarray) -> set[int]:
    """Kept nodes of the likeliest labelling in which nothing below a dropped node is kept."""
    keep, drop = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
    kept, dropped = {}, {}
    for n, k, d in zip(reversed(nodes), keep[::-1].tolist(), drop[::-1].tolist(), strict=True):
        kept[id(n)] = k + sum(max(kept[id(c)], dropped[id(c)]) for c in n.children)
        dropped[id(n)] = d + sum(dropped[id(c)] for c in n.children)
    chosen: set[int] = set()
    for n in nodes:
        if (n.parent is None or id(n.parent) in chosen) and kept[id(n)] > dropped[id(n)]:
            chosen.add(id(n))
    return chosen


def main_text(nodes: list[Node], chosen: set[int]) -> str:
    blocks: list[str] = []
    todo: list[str | Node | None] = [nodes[0]]
    current: list[str] = []

    def flush() -> None:
        if text := " ".join(unescape("".join(current)).split()):
            blocks.append(text)
        current.clear()

    while todo:  # no recursion: pages may nest deeply
        part = todo.pop()
        if isinstance(part, str):
            current.append(part)
            continue
        flush()
        if part is not None and id(part) in chosen:
            todo.append(None)  # the block ends here
            todo += reversed(part.parts)
    flush()
    return " ".join(blocks)


def extract(pages: list[str], model: BoostedTrees) -> list[str]:
    out: list[str] = []
    waiting: list[list[Node]] = []

    def judge() -> None:
        rows = chain.from_iterable(map(features, waiting))
        logits = np.concatenate([model.logits(np.array(part)) for part in iter(lambda: list(islice(rows, NODES)), [])])
        at = 0
        for nodes in waiting:
            out.append(main_text(nodes, decode(nodes, logits[at : at + len(nodes)])))
            at += len(nodes)
        waiting.clear()

    for html in pages:
        waiting.append(parse(html))
        if sum(map(len, waiting)) >= NODES:
            judge()
    if waiting:
        judge()
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, the main text and its length in code points."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(batch: pa.RecordBatch, html: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(extract(html, model.value), pa.string())], names=["page_id", "url", "text"])

        for batch in batches:
            start, held = 0, []
            for k in range(batch.num_rows):
                held.append(batch.column("html")[k].as_py())
                if sum(map(len, held)) > BATCH_BYTES:
                    yield judged(batch.slice(start, len(held)), held)
                    start, held = k + 1, []
            if held:
                yield judged(batch.slice(start), held)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
