"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element and text of a page is a node with a hidden state: whether it holds
content, itself or below.  A node's own features give its potential, and a parent
and child share a potential that depends on the kinds of both.  Sum-product messages,
first from the leaves up and then from the root down, give each node's exact content
marginal.  The weights are trained by gradient ascent on the likelihood of labelled
pages; the messages of the same two passes give the gradient.

All pages of a batch are one forest: each depth of the trees is one numpy step.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .html_training import training_pages

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text a page does not show as text: code, controls, drawings, what stands in for media.
RAW = frozenset(
    "script style textarea title noscript template iframe svg select option datalist button video audio canvas object".split()
)
#: Elements whose content is not markup.
PLAIN = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title", "iframe", "noscript")}
#: Elements that start and end a line of their own.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
#: An opening tag that ends open elements of these names, up to one of the scopes.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPES = frozenset("html body table td th caption button object".split())
#: A quote opens a value only right behind =, and only where it is closed again.
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
SPACE = re.compile(r"\s+")

GROUPS = {
    "main": "article main",
    "para": "p blockquote pre",
    "head": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol li dl dt dd",
    "table": "table tr td th tbody thead tfoot caption",
    "inline": "b i em strong span u s sub sup small code mark q cite abbr time font math details summary",
    "link": "a",
    "box": "div section center",
    "nav": "nav menu",
    "header": "header",
    "footer": "footer",
    "aside": "aside",
    "form": "form fieldset label input legend dialog",
    "figure": "figure figcaption",
    "frame": "#page html body",
    "unseen": "head " + " ".join(sorted(RAW)),
}
GROUP_OF = {tag: g for g, tags in GROUPS.items() for tag in tags.split()}
#: Words in class, id and role that speak for or against content.
HINTS = {
    "good": "article content entry post story body main text prose page",
    "nav": "nav menu breadcrumb breadcrumbs navbar navigation pagination pager toc skip",
    "edge": "header footer masthead banner topbar copyright colophon contentinfo",
    "side": "sidebar side aside related recommended widget rail more popular trending complementary",
    "notice": "cookie cookies consent notice alert modal popup gdpr newsletter subscribe signup paywall toast",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promoted",
    "comment": "comment comments reply replies discussion disqus respond feedback",
    "share": "share social sharing follow tools tags",
}
HINT_OF: dict[str, list[str]] = {}
for _group, _words in HINTS.items():
    for _word in _words.split():
        HINT_OF.setdefault(_word, []).append(_group)
#: Parts of a class that turn what it names into a property of the page: ad-free, no-sidebar, comments-open.
TURNS = frozenset("no not free without with has hide hidden open closed on off enabled disabled".split())
#: Hints that do not count on a node that holds this share of the page's unlinked text outside the parts that tags set
#: aside: one name never outweighs it all.
DOUBTED, NEARLY_ALL = ("nav", "edge", "side", "notice", "advert", "share"), 0.9
SET_ASIDE = frozenset("nav menu header footer aside form".split())
#: Groups of tags and hints that all nodes below inherit as features, at any depth, unless they hold most of the page.
BELOW = ("nav", "footer", "aside", "form", "hint_comment", "hint_advert", "hint_notice", "hint_side", "hint_share")
NAMES = (
    ["bias", "is_text"] + list(GROUPS) + [f"hint_{h}" for h in HINTS]
    + ["link_share", "links", "long", "brief", "sentence", "empty", "deep", "has_paras", "near_top_link"]
    + ["para_share", "para_most", "char_share", "char_most"]
    + ["controls", "rights", "in_main", "holds_main", "main_elsewhere", "again_main", "good_and_bad"]
    + [f"below_{g}" for g in BELOW]
)
AT = {n: i for i, n in enumerate(NAMES)}
#: Kinds of node; a parent's and a child's kind choose their pair potential.
KINDS = (
    "text", "inline", "link", "para", "head", "list", "table", "box", "main", "nav", "header", "footer", "aside", "form", "figure", "frame", "other", "wrapper",
)
KIND_OF = {k: i for i, k in enumerate(KINDS)}
#: Pair potential of a wrapper and its parent for the same state: it favours no state, however many are nested.
WRAPPER = 8.0
RIGHTS = re.compile(r"\u00a9|\(c\)|\ball rights\b|\bcopyright\b", re.I)


@dataclass
class Forest:
    """Nodes of many pages, parents before children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    hints: list[tuple] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    unseen: list[bool] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    page: list[int] = field(default_factory=list)
    pages: int = 0

    def add(self, parent: int, tag: str, text: str | None, hints: tuple, unseen: bool, label: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.text.append(text)
        self.hints.append(hints)
        self.unseen.append(unseen)
        self.label.append(label)
        self.page.append(self.pages)
        return len(self.parent) - 1


@lru_cache(maxsize=4096)
def hints_of(raw: str) -> tuple[tuple, str | None]:
    """(hint groups of class, id and role; the training label, if any) of a tag's attributes."""
    groups, label = set(), None
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            for token in entities.unescape(a or b or c).lower().split():
                words = re.split(r"[^a-z]+", token)
                found = {g for word in words for g in HINT_OF.get(word, ())}
                groups.update(found & {"good"} if len(words) > 1 and not TURNS.isdisjoint(words) else found)
        elif name == "data-y" and (a or b or c) in ("0", "1"):
            label = a or b or c
        elif name == "hidden":
            groups.add("hidden")
    return tuple(sorted(groups)), label


def grow(forest: Forest, page: str) -> tuple[int, int]:
    """Adds the tree of a page, however broken its markup and deep its nesting; returns its range of nodes."""
    first = forest.add(-1, "#page", None, (), False, 0)
    stack = [(first, "#page", False, 0)]
    opened: Counter[str] = Counter()
    at, end = 0, len(page)

    def put_text(raw: str) -> None:
        if raw:
            node, _, unseen, label = stack[-1]
            forest.add(node, "#text", entities.unescape(raw), (), unseen, label)

    def close_from(i: int) -> None:
        for item in stack[i:]:
            opened[item[1]] -= 1
        del stack[i:]

    while at < end:
        found = TAG.search(page, at)
        if not found:
            put_text(page[at:])
            break
        put_text(page[at : found.start()])
        at = found.end()
        name = found[2]
        if not name:
            continue
        name = name.lower()
        if found[1]:
            if opened[name] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] == name:
                        close_from(i)
                        break
                    if name not in BLOCK and stack[i][1] in BLOCK:
                        break
            elif name == "p":
                node, _, unseen, label = stack[-1]
                forest.add(node, name, None, (), unseen, label)
            continue
        closes, scopes = CLOSES.get(name, (None, None))
        if closes is None and name in BLOCK:
            closes, scopes = {"p"}, SCOPES
        if name == "body":
            closes, scopes = {"head"}, {"html"}
        if closes and any(opened[c] > 0 for c in closes):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][1] in scopes:
                    break
                if stack[i][1] in closes:
                    close_from(i)
                    if name not in ("tr", "body"):
                        break
        node, _, unseen, label = stack[-1]
        groups, mark = hints_of(found[3] or "")
        label = label if mark is None else int(mark)
        unseen = unseen or name in RAW or name == "head" or "hidden" in groups
        if name in VOID:
            if name in ("br", "hr", "wbr", "img", "input"):
                forest.add(node, name, None if name != "br" else " ", groups, unseen, label)
            continue
        own = forest.add(node, name, None, groups, unseen, label)
        stack.append((own, name, unseen, label))
        opened[name] += 1
        if name in PLAIN:
            close = PLAIN[name].search(page, at)
            at = close.start() if close else end
    forest.pages += 1
    return first, len(forest.parent)


def features(forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(features, parents, kinds, nodes of each depth) of the forest."""
    n = len(forest.parent)
    x = np.zeros((n, len(NAMES)))
    x[:, AT["bias"]] = 1
    parent, depth, page = (np.array(v, dtype=np.int64) for v in (forest.parent, forest.depth, forest.page))
    kind = np.full(n, KIND_OF["other"])
    own, stops, paras, controls, rights, mains, in_paras = (np.zeros(n) for _ in range(7))
    linked, main, para, article, apart = (np.zeros(n, dtype=bool) for _ in range(5))
    links = np.zeros(n)
    for i, (tag, text, hints) in enumerate(zip(forest.tag, forest.text, forest.hints)):
        p = parent[i]
        if tag == "#text":
            x[i, AT["is_text"]] = 1
            kind[i] = KIND_OF["text"]
            if not forest.unseen[i]:
                own[i] = sum(map(len, text.split()))
                stops[i] = sum(text.count(c) for c in ".!?;,\u3002\u060c")
                rights[i] = own[i] < 400 and RIGHTS.search(text) is not None
        else:
            group = GROUP_OF.get(tag)
            if group:
                x[i, AT[group]] = 1
                kind[i] = KIND_OF.get(group, KIND_OF["other"])
            paras[i] = tag == "p"
            links[i] = tag == "a"
            controls[i] = tag in ("input", "textarea", "select", "button")
            mains[i] = tag in ("article", "main")
            for h in hints:
                if h in HINTS:
                    x[i, AT[f"hint_{h}"]] = 1
        if p >= 0:
            linked[i], main[i], para[i] = linked[p], main[p], para[p]
            article[i], apart[i] = article[p], apart[p]
        apart[i] |= tag in SET_ASIDE
        x[i, AT["again_main"]] = tag == "article" and article[i]
        article[i] |= tag == "article"
        linked[i] |= tag == "a"
        main[i] |= mains[i] > 0
        para[i] |= tag in ("p", "li", "blockquote", "pre", "td")
    in_links, in_paras, middle = own * linked, own * (para & ~linked), own * ~(linked | apart)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if n else []
    for level in reversed(levels[1:]):
        for sums in (own, in_links, stops, paras, controls, rights, mains, in_paras, links, middle):
            np.add.at(sums, parent[level], sums[level])
    whole, of_page, chars, middles = (np.zeros(forest.pages + 1) for _ in range(4))
    if n:
        roots = levels[0]
        whole[page[roots]], of_page[page[roots]], chars[page[roots]] = in_paras[roots], mains[roots], (own - in_links)[roots]
        middles[page[roots]] = middle[roots]
    share = in_links / np.maximum(own, 1)
    sure = middle <= NEARLY_ALL * np.maximum(middles[page], 1)
    x[:, [AT[f"hint_{h}"] for h in DOUBTED]] *= sure[:, None]
    bad = x[:, [AT[f"hint_{h}"] for h in HINTS if h != "good"]].any(axis=1)
    x[:, AT["link_share"]] = share
    x[:, AT["links"]] = np.minimum(links, 6) / 6
    x[:, AT["long"]] = np.log1p(own) / 6
    x[:, AT["brief"]] = own < 30
    x[:, AT["sentence"]] = np.minimum(stops / np.maximum(own / 40, 1), 2)
    x[:, AT["empty"]] = own == 0
    x[:, AT["deep"]] = np.minimum(depth, 12) / 12
    x[:, AT["has_paras"]] = np.minimum(paras, 5) / 5
    x[:, AT["para_share"]] = in_paras / np.maximum(whole[page], 1)
    x[:, AT["para_most"]] = x[:, AT["para_share"]] > 0.7
    x[:, AT["char_share"]] = (own - in_links) / np.maximum(chars[page], 1)
    x[:, AT["char_most"]] = x[:, AT["char_share"]] > 0.6
    x[:, AT["near_top_link"]] = (share > 0.5) & (depth <= 4)
    x[:, AT["controls"]] = np.minimum(controls * 60 / (own + 60), 1)
    x[:, AT["rights"]] = (rights > 0) & (own < 400) & (2 * own < chars[page]) & ~main
    x[:, AT["in_main"]] = main
    x[:, AT["holds_main"]] = (mains > 0) & ~main
    x[:, AT["main_elsewhere"]] = (of_page[page] > 0) & (mains == 0) & ~main
    x[:, AT["good_and_bad"]] = x[:, AT["hint_good"]] * bad
    marks, below = np.array([AT[g] for g in BELOW]), np.array([AT[f"below_{g}"] for g in BELOW])
    given = x[:, marks] * (x[:, AT["char_most"]] == 0)[:, None]
    for level in levels[1:]:
        up = parent[level]
        x[level[:, None], below] = np.maximum(x[up[:, None], below], given[up])
    # A box with all the text of its parent says nothing new: it only passes messages on.
    wraps = (kind == KIND_OF["box"]) & (own > 0) & (own == own[parent]) & (parent >= 0)
    kind[wraps] = KIND_OF["wrapper"]
    x[np.ix_(wraps, [i for i, name in enumerate(NAMES) if not name.startswith("hint_")])] = 0
    return x, parent, kind, levels


@dataclass
class Model:
    node: np.ndarray  # weight of each feature for content
    pair: np.ndarray  # (kind of parent, kind of child, state of parent, state of child)


def marginals(model: Model, x: np.ndarray, parent: np.ndarray, kind: np.ndarray, levels: list) -> tuple:
    """Sum-product: (content marginal of each node, pair marginals with the parent)."""
    n = len(parent)
    unary = np.stack([np.zeros(n), x @ model.node], axis=1)
    pair = model.pair[kind[parent], kind]
    up = unary.copy()  # own potential and all messages from below
    message = np.zeros((n, 2))
    for level in reversed(levels[1:]):
        joint = pair[level] + up[level][:, None, :]
        message[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        message[level] -= message[level].max(axis=1, keepdims=True)
        np.add.at(up, parent[level], message[level])
    belief = up.copy()
    both = np.zeros((n, 2, 2))
    for level in levels[1:]:
        above = belief[parent[level]] - message[level]
        joint = above[:, :, None] + pair[level] + up[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        both[level] = joint
        belief[level] = np.log(np.maximum(joint.sum(axis=1), 1e-300))
    belief -= belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    return p[:, 1] / p.sum(axis=1), both


def states(forest: Forest) -> np.ndarray:
    """The labelled state of each node: whether it holds visible content text, itself or below."""
    y = np.zeros(len(forest.parent), dtype=np.int64)
    for i in range(len(y) - 1, -1, -1):
        text = forest.text[i]
        if text is not None and text.strip() and not forest.unseen[i]:
            y[i] = forest.label[i]
        if y[i] and forest.parent[i] >= 0:
            y[forest.parent[i]] = 1
    return y


def train(pages: list[str], steps: int = 1600, rate: float = 0.06, decay: float = 5e-5, size: int = 40, seed: int = 5) -> Model:
    """Fits the potentials to pages whose elements carry data-y="0" or "1" (inherited), `size` pages a step."""
    k = len(KINDS)
    model = Model(np.zeros(len(NAMES)), np.zeros((k, k, 2, 2)))
    model.pair[:, KIND_OF["wrapper"]] = WRAPPER * np.eye(2)
    learnt = np.ones((k, k, 1, 1))
    learnt[:, KIND_OF["wrapper"]] = 0
    rng = np.random.default_rng(seed)

    def by_kinds(at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(at, w, k * k) for w in weights.reshape(-1, 4).T], axis=1).reshape(k, k, 2, 2)

    parts = []
    for s in range(0, len(pages), size):
        forest = Forest()
        for page in pages[s : s + size]:
            grow(forest, page)
        x, parent, kind, levels = features(forest)
        y, child = states(forest), parent >= 0
        at = (kind[parent] * k + kind)[child]
        parts.append((x, parent, kind, levels, y, child, at, by_kinds(at, np.eye(4)[(2 * y[parent] + y)[child]]), forest.pages))
    moments = [np.zeros_like(model.node), np.zeros_like(model.pair)], [np.zeros_like(model.node), np.zeros_like(model.pair)]
    for step in range(1, steps + 1):
        if step % len(parts) == 1 % len(parts):
            order = rng.permutation(len(parts))
        x, parent, kind, levels, y, child, at, seen, n = parts[order[step % len(parts)]]
        p, both = marginals(model, x, parent, kind, levels)
        grads = [x.T @ (y - p) / n - decay * model.node, learnt * ((seen - by_kinds(at, both[child])) / n - decay * model.pair)]
        for q, g, m, v in zip((model.node, model.pair), grads, *moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q += rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(training_pages())


def texts_of(forest: Forest, ranges: list[tuple[int, int]], content: np.ndarray) -> list[str]:
    """Content texts of each page: one line for each block, in page order."""
    out = []
    for first, last in ranges:
        lines: list[str] = []
        run: list[str] = []
        block_of = {first: first}
        current = first

        def flush() -> None:
            line = SPACE.sub(" ", "".join(run)).strip()
            if line:
                lines.append(line)
            run.clear()

        for i in range(first + 1, last):
            tag, p = forest.tag[i], forest.parent[i]
            block = i if tag in BLOCK else block_of[p]
            block_of[i] = block
            text = forest.text[i]
            # White space shows no text of its own, so it never joins what it stands between.
            if text is not None and not forest.unseen[i] and (content[i] or not text.strip()):
                if block != current:
                    flush()
                    current = block
                run.append(text)
            elif tag in BLOCK:
                flush()
        flush()
        out.append("\n".join(lines))
    return out


def extract(model: Model, pages: list[str | None]) -> list[str]:
    forest, ranges = Forest(), []
    for page in pages:
        ranges.append(grow(forest, page or ""))
    if not ranges:
        return []
    x, parent, kind, levels = features(forest)
    p, _ = marginals(model, x, parent, kind, levels)
    return texts_of(forest, ranges, p > 0.5)


def main_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id") -> DataFrame:
    """The main text of each page; one row per input row: id, url, text, n_chars.

    Without a model one is trained on generated labelled pages (training_pages).
    Scripts, styles, the head, hidden elements and form controls never give text.
    Character references are decoded, white space inside a block becomes one space,
    blocks are joined by line feeds in page order.

    Nesting has no bound, and a quote opens an attribute's value only behind =.  A null
    or empty page, or one without content, gives an empty text.  Repeated
    rows and null ids or urls are kept, further columns left out; an empty table
    gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def work(batch: pa.RecordBatch):
        for s in range(0, batch.num_rows, 100):
            part = batch.slice(s, 100)
            texts = extract(shared.value, part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, "url", "text", "n_chars"],
            )

    narrow = pages.select(F.col(id_col).cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(narrow, work, f"{id_col} long, url string, text string, n_chars long")
