"""Main text of web pages by gradient-boosted trees over DOM nodes.

Pages are read into trees of nodes. Boosted trees give every node the log-odds that its own text belongs to the article, from
the node's shape (density of text, links and punctuation in its subtree), the tokens of its tag and attributes and of its
ancestors', its depth and its siblings. Decoding is hierarchical: a subtree is taken, left out, or divided among its children,
whichever has the larger sum, and what is taken or left out holds for all below, so ancestors and descendants never disagree.

The trees are trained here, on a bounded sample of pages that mark their article with a landmark element. Each such page is
also rebuilt in other layouts, with its landmarks replaced by neutral elements and other names, and with further furniture
made of its own words, so that the trees learn from shape and names and not from the landmark alone.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropledger.llm.common import schema_of

#: Pages that the trees are trained on, at most: those of the smallest hashed ids among the pages with a landmark.
FIT_PAGES = 400
LAYOUTS = 5  # rebuilt forms of each of them
PAGE_EXAMPLES = 4_000  # nodes of one page and its rebuilt forms that are learned from
PAGES_AT_ONCE = 128
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 24

# Elements and names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript svg math head title iframe object canvas audio video select textarea option datalist button".split())
RAW = frozenset("script style textarea title xmp iframe noscript noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
              "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table td th body html article section div main aside nav footer header form".split())
MAIN_NAMES = "article post entry content main story body text page prose markdown read".split()
SIDE_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs toc pager pagination skip".split(),
    "head": "header masthead banner topbar logo branding hero".split(),
    "foot": "footer foot copyright legal bottom colophon imprint".split(),
    "side": "sidebar side aside widget related recommended recommendations popular trending more rail teaser".split(),
    "note": "cookie consent notice alert message popup modal overlay gdpr toast newsletter subscribe signup paywall promo".split(),
    "ad": "ad ads advert advertisement sponsor sponsored banner promo adsense".split(),
    "form": "form search login comment-form contact subscribe".split(),
    "talk": "comment comments discussion disqus replies reply reader respond feedback".split(),
    "tool": "share social tags meta byline author toolbar print rating tools".split(),
}
LANDMARKS = ("article", "main")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</\s*([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*?)(/?)(?:>|$)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:@][^\s=/>]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "parent", "children", "parts", "keep", "index", "hidden")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Node] = []
        self.parts: list = []  # strings and nodes in page order
        self.hidden = tag in HIDDEN
        self.index = 0

    def add(self, child: Node) -> Node:
        self.children.append(child)
        self.parts.append(child)
        return child


def parse(page: str | None) -> Node:
    """The page's tree. Missing end tags are put in, stray ones ignored; a page cut off ends where it is cut."""
    root = at = Node("#page", "", None)
    raw, pos, page = None, 0, page or ""
    while pos < len(page):
        if raw:  # the text of scripts and the like ends only with their own end tag
            end = re.compile(rf"</{raw}\s*[^>]*(?:>|$)", re.I).search(page, pos)
            at.parts.append(page[pos:end.start() if end else len(page)])
            pos, at, raw = end.end() if end else len(page), at.parent, None
            continue
        m = _TOKEN.match(page, pos)
        pos = m.end()
        closed, opened, attributes, alone, text = m.groups()
        if text is not None:
            at.parts.append(text)
        elif closed is not None:
            tag, up = closed.lower(), at
            if tag == "p" and not _open(at, "p"):
                at.add(Node("p", "", at))
                continue
            while up.parent is not None and up.tag != tag:
                if up.tag in SCOPE and tag not in SCOPE:
                    up = root
                    break
                up = up.parent
            if up.parent is not None:
                at = up.parent
        elif opened is not None:
            tag = opened.lower()
            if tag in CLOSES_P:
                p = _open(at, "p")
                at = p.parent if p is not None else at
            for other in SAME_CLOSE.get(tag, ()):
                up = at
                while up.parent is not None and up.tag != other and up.tag not in ("ul", "ol", "dl", "table", "div", "body"):
                    up = up.parent
                if up.tag == other and up.parent is not None:
                    at = up.parent
            names, hidden = _names(attributes)
            node = at.add(Node(tag, names, at))
            node.hidden = node.hidden or hidden
            if tag in VOID or (alone and tag not in BLOCKS):
                continue
            at = node
            raw = tag if tag in RAW else None
    return root


def _open(at: Node, tag: str) -> Node | None:
    while at.parent is not None and at.tag not in ("td", "th", "table", "body", "html"):
        if at.tag == tag:
            return at
        at = at.parent
    return None


def _names(attributes: str) -> tuple[str, bool]:
    if not attributes or attributes.isspace():
        return "", False
    out, hidden = [], False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            out.append(value)
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)) or (name == "aria-hidden" and value == "true"):
            hidden = True
    return " ".join(out).lower(), hidden


def nodes_of(root: Node) -> list[Node]:
    """All nodes in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.index = len(out)
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def homes(nodes: list[Node]) -> list[int]:
    """For every node the block that its text belongs to: itself, or the block around an inline element."""
    out: list[int] = []
    for i, x in enumerate(nodes):
        out.append(i if x.tag in BLOCKS or i == 0 else out[x.parent.index])
    return out


_WORDS = re.compile(r"[a-z]+")
_KINDS = {w: i for i, (_, ws) in enumerate(SIDE_NAMES.items()) for w in ws}
_MAIN = frozenset(MAIN_NAMES)
FEATURES = (["depth", "own chars", "chars", "share of page", "links", "commas", "blocks", "words", "place", "siblings", "like siblings", "nearest before",
             "nearest after", "longest sibling", "start", "end"]
            + ["list", "heading", "paragraph", "quote", "table", "form", "landmark", "furniture"]
            + [f"{k} name" for k in SIDE_NAMES] + ["main name"] + [f"{k} above" for k in SIDE_NAMES] + ["main above", "form above", "furniture above", "landmark above", "link above"])


_FLAGS = {t: i for i, ts in enumerate((
    ("ul", "ol", "li", "dl"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("p",), ("blockquote", "pre"), ("table", "tr", "td", "th"),
    ("form", "input", "button", "select", "textarea", "label", "fieldset"), LANDMARKS, ("nav", "footer", "header", "aside"))) for t in ts}


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node. Plain lists in the loops: pages are small, and there are many."""
    n, kinds, flags = len(nodes), len(SIDE_NAMES), 8
    width = flags + (kinds + 1) + (kinds + 5)
    home = homes(nodes)
    own, links, comma, words, block = ([0.0] * n for _ in range(5))
    in_link, hidden, above = [False] * n, [False] * n, [0] * n  # above: bits of what the ancestors are
    here, marks, depth = [0] * n, [0] * n, [0] * n
    for i, x in enumerate(nodes):
        t, up = x.tag, x.parent.index if i else 0
        hidden[i] = x.hidden or hidden[up]
        in_link[i] = t == "a" or (in_link[up] and t not in BLOCKS)
        if not hidden[i]:
            text = " ".join([p for p in x.parts if type(p) is str])
            if text and not text.isspace():
                h, blanks = home[i], text.count(" ")
                size = len(text) - blanks
                own[h] += size
                links[h] += size * in_link[i]
                comma[h] += text.count(",") + text.count(".")
                words[h] += blanks + 1
        block[i] = 1.0 if t in BLOCKS else 0.0
        flag, names = _FLAGS.get(t), 0
        if x.names:
            for w in _WORDS.findall(x.names):
                names |= 1 << _KINDS[w] if w in _KINDS else 1 << kinds if w in _MAIN else 0
        marks[i] = (1 << flag if flag is not None else 0) | names << flags
        here[i] = names | (flag == 5) << kinds + 1 | (flag == 7) << kinds + 2 | (flag == 6) << kinds + 3 | (t == "a") << kinds + 4
        if i:
            depth[i], above[i] = depth[up] + 1, above[up] | here[up]
    total, commas, blocks, count = own[:], comma[:], block[:], words[:]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.index
        total[p] += total[i]
        commas[p] += commas[i]
        blocks[p] += blocks[i]
        count[p] += count[i]
        links[p] += links[i]
    place, many, like, before, after, longest = ([0.0] * n for _ in range(6))
    for x in nodes:
        if x.children:
            c = [k.index for k in x.children]
            tags: dict[str, int] = {}
            for k in x.children:
                tags[k.tag] = tags.get(k.tag, 0) + 1
            most, last = max([total[k] for k in c]), max(1, len(c) - 1)
            for j, k in enumerate(c):
                place[k], many[k], like[k], longest[k] = j / last, len(c), tags[nodes[k].tag], most
                before[k] = total[c[j - 1]] if j else 0.0
                after[k] = total[c[j + 1]] if j + 1 < len(c) else 0.0
    depth, own, total, links, commas, blocks, count, place, many, like, before, after, longest = np.array(
        [depth, own, total, links, commas, blocks, count, place, many, like, before, after, longest], dtype=float)
    start, page, log = np.cumsum(own) - own, max(1.0, total[0]), np.log1p
    shape = np.stack([depth, log(own), log(total), total / page, links / (total + 1), commas / (total + 1), blocks / (total + 1), total / (count + 1), place, log(many),
                      log(like), log(before), log(after), log(longest), start / page, (start + total) / page], axis=1)
    bits = np.array([m | a << flags + kinds + 1 for m, a in zip(marks, above)], dtype=np.int64)
    return np.hstack([shape, (bits[:, None] >> np.arange(width)) & 1])


class BoostedTrees:
    """Logistic boosting of small trees over binned features; a node's weight is the text that it decides on."""

    def __init__(self, edges: list[np.ndarray], trees: list, base: float):
        self.edges, self.trees, self.base = edges, trees, base

    @staticmethod
    def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1).astype(np.int64)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        edges = [e if len(e) > 1 or not len(e) or (x[:, j] > e[0]).any() else e - 1e-9 for j, e in enumerate(edges)]
        edges = [np.unique(np.r_[e, 0.5]) if set(np.unique(x[:, j])) <= {0.0, 1.0} else e for j, e in enumerate(edges)]
        b, bins = cls._binned(x, edges), BINS + 2
        share = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        z, trees, m = np.full(len(y), base), [], x.shape[1]
        column = np.arange(m) * bins
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            grad, hess = w * (y - p), w * p * (1 - p) + 1e-9
            where = np.zeros(len(y), dtype=np.int64)  # node of the tree, as in a heap
            split = {}
            for depth in range(DEPTH):
                for node in np.unique(where):
                    if node < 2**depth - 1:
                        continue
                    rows = np.flatnonzero(where == node)
                    at = (b[rows] + column).ravel()
                    g = np.bincount(at, np.repeat(grad[rows], m), m * bins).reshape(m, bins).cumsum(1)
                    h = np.bincount(at, np.repeat(hess[rows], m), m * bins).reshape(m, bins).cumsum(1)
                    gt, ht = g[0, -1], h[0, -1]
                    gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                    gain[(h < 1) | (ht - h < 1)] = -1
                    j, cut = divmod(int(gain.argmax()), bins)
                    if gain[j, cut] <= 1e-6:
                        continue
                    split[int(node)] = (j, cut)
                    where[rows] = 2 * node + 1 + (b[rows, j] > cut)
            value = {int(k): float(RATE * grad[where == k].sum() / (hess[where == k].sum() + 1)) for k in np.unique(where)}
            z += np.array([value[k] for k in where.tolist()])
            trees.append((split, value))
        return cls(edges, trees, base)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x, self.edges)
        flat, row = b.ravel(), np.arange(len(x)) * x.shape[1]
        z = np.full(len(x), self.base)
        for feature, cut, value in self._flat():
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (flat[row + f] > cut[at]))
            z += value[at]
        return z

    def _flat(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Trees as arrays over heap places; feature -1 marks a leaf."""
        if not hasattr(self, "_arrays"):
            self._arrays = []
            for split, value in self.trees:
                feature, cut, leaf = np.full(2 ** (DEPTH + 1), -1), np.zeros(2 ** (DEPTH + 1), dtype=np.int64), np.zeros(2 ** (DEPTH + 1))
                for k, (j, c) in split.items():
                    feature[k], cut[k] = j, c
                for k, v in value.items():
                    leaf[k] = v
                self._arrays.append((feature, cut, leaf))
        return self._arrays


def decode(nodes: list[Node], odds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which nodes' own texts are taken. Every text votes with its log-odds times its size; a subtree is taken or left out as
    one, or divided at some cost, whichever sums to most."""
    n = len(nodes)
    vote = (odds * np.sqrt(own)).tolist()
    whole, below, divide = vote[:], [0.0] * n, [False] * n
    for i in range(n - 1, 0, -1):
        whole[nodes[i].parent.index] += whole[i]
    for i in range(n - 1, -1, -1):
        best, split = max(whole[i], 0.0), below[i] + max(vote[i], 0.0) - 1.0
        if nodes[i].children and split > best:
            best, divide[i] = split, True
        if i:
            below[nodes[i].parent.index] += best
    state, taken = [0] * n, np.zeros(n, dtype=bool)  # 0: open, 1: taken, -1: left out
    for i, node in enumerate(nodes):
        s = state[node.parent.index] if i else 0
        if s == 0 and not divide[i]:
            s = 1 if whole[i] > 0 else -1
        state[i] = s
        taken[i] = s == 1 or (s == 0 and vote[i] > 0)
    return taken


def text_of_nodes(nodes: list[Node], taken: np.ndarray) -> str:
    """Taken texts in page order: references decoded, space inside a block made single, blocks joined by one space."""
    blocks, now = [], []
    stack: list = [nodes[0]]
    while stack:
        x = stack.pop()
        if type(x) is str:
            now.append(x)
        elif x is None:
            blocks.append("".join(now))
            now = []
        elif not x.hidden:
            if x.tag in BLOCKS:
                blocks.append("".join(now))
                now = []
                stack.append(None)
            stack.extend(p for p in reversed(x.parts) if type(p) is not str or taken[x.index])
    blocks.append("".join(now))
    out = (_SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return " ".join(b for b in out if b)


# Pages to learn from

def _landmark(nodes: list[Node]) -> Node | None:
    """The one article or main element of a page that has just one; inside main, its one article."""
    for tag in LANDMARKS:
        found = [x for x in nodes if x.tag == tag]
        if len(found) == 1:
            return found[0]
    return None


def marks_of(page: str | None) -> np.ndarray | None:
    """For every node whether its text is within the landmark and not in furniture there; None without a landmark."""
    nodes = nodes_of(parse(page))
    top = _landmark(nodes)
    if top is None:
        return None
    inside = np.zeros(len(nodes), dtype=bool)
    for i, x in enumerate(nodes):
        inside[i] = x is top or (i > 0 and inside[x.parent.index] and x.tag not in ("nav", "footer", "aside", "form", "button"))
        kinds = {w for w in _WORDS.findall(x.names)} & set(_KINDS) if x.names else ()
        if x is not top and kinds:
            inside[i] = False
    return inside


def layouts(page: str, rng: np.random.Generator, count: int) -> Iterator[tuple[str, str]]:
    """The article's blocks in other layouts, as (page, article as it is marked there): furniture around and inside it is made of the page's own words."""
    nodes = nodes_of(parse(page))
    top = _landmark(nodes)
    blocks = [(x.tag, entities.escape(_SPACE.sub(" ", entities.unescape(" ".join(p for p in x.parts if type(p) is str))).strip())) for x in nodes
              if _within(x, top) and not x.hidden]
    blocks = [(t if t in ("h1", "h2", "h3", "p", "li", "blockquote") else "p", s) for t, s in blocks if s]
    words = " ".join(s for _, s in blocks).split() or ["text"]
    pick = lambda options: options[int(rng.integers(len(options)))]
    say = lambda low, high: " ".join(words[int(rng.integers(len(words)))] for _ in range(int(rng.integers(low, high))))

    def named(kind: str) -> str:
        word = pick(SIDE_NAMES[kind])
        return pick([f'class="{word}"', f'id="{word}"', f'class="site-{word} box"', f'class="{word}-{pick(["box", "area", "list", "wrap"])}"', f'class="c{int(rng.integers(99))} {word}"', ""] if kind not in ("ad", "talk", "note")
                    else [f'class="{word}"', f'id="{word}"', f'class="{word}-{pick(["box", "area", "list", "wrap"])}"', f'class="{word} x{int(rng.integers(99))}"'])

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 4)}</a></li>' for i in range(k)) + "</ul>"

    def furniture(kind: str) -> str:
        tag = {"menu": ["nav", "div"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div"], "form": ["form", "form", "div"], "talk": ["section", "div", "ol"]}.get(kind, ["div", "section"])
        tag, attribute = pick(tag), named(kind)
        if tag in ("div", "section", "ol") and not attribute:
            attribute = f'class="{pick(SIDE_NAMES[kind])}"'
        if kind == "menu":
            inner = pick([links(int(rng.integers(3, 12))), " | ".join(f'<a href="#">{say(1, 3)}</a>' for _ in range(int(rng.integers(3, 9))))])
        elif kind == "head":
            inner = pick([f'<a href="/">{say(1, 4)}</a><p>{say(2, 8)}</p>', f"<h1>{say(1, 4)}</h1>" + links(4), say(2, 9)])
        elif kind == "foot":
            inner = pick([f"&copy; {say(2, 14)}", f"<p>{say(3, 16)}</p>" + links(3), f"{say(3, 30)} &middot; {say(1, 5)}"])
        elif kind == "side":
            inner = pick([f"<h3>{say(1, 4)}</h3>" + links(int(rng.integers(2, 9))), f"<h3>{say(1, 4)}</h3><p>{say(5, 40)}</p>", f"<p>{say(5, 60)}</p><p>{say(5, 30)}</p>"])
        elif kind == "form":
            inner = f'<label>{say(1, 5)}</label><input name="q"><button>{say(1, 3)}</button>' + pick(["", f"<p>{say(3, 12)}</p>"])
        elif kind == "talk":
            item = pick(["li", "div", "p"]) if tag != "ol" else "li"
            inner = pick(["", f"<h3>{say(1, 4)}</h3>"]) + "".join(f'<{item}{pick(["", " class=comment"])}>{pick(["", f"<b>{say(1, 3)}</b> "])}{pick([say(4, 60), f"<p>{say(5, 50)}</p>"])}</{item}>' for _ in range(int(rng.integers(1, 6))))
        else:
            inner = pick([say(3, 40), f"<p>{say(3, 40)}</p>", f'<p>{say(3, 25)} <a href="#">{say(1, 4)}</a></p>', f"<p>{say(4, 20)}</p><button>{say(1, 3)}</button>"])
        return f"<{tag} {attribute}>{inner}</{tag}>"

    for _ in range(count):
        inside = []
        # Articles of all lengths: some of the blocks, some of them cut to their first words.
        own = blocks if rng.random() < 0.4 else blocks[:int(rng.integers(1, len(blocks) + 1))]
        short = rng.random() < 0.5
        own = [(t, entities.escape(" ".join(entities.unescape(s).split(" ")[:int(rng.integers(6, 30))])) if short and rng.random() < 0.8 else s) for t, s in own]
        for t, s in own:
            if rng.random() < 0.3 and " " in s:
                ws = s.split(" ")
                i = int(rng.integers(len(ws)))
                ws[i] = pick(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "<code>{}</code>"]).format(ws[i])
                s = " ".join(ws)
            if rng.random() < 0.12:
                mark = pick(["ul", "ol"])
                inside.append(f"<{mark}>" + "".join(f"<li>{say(2, 25)}</li>" for _ in range(int(rng.integers(1, 7)))) + f"</{mark}>")
            inside.append(f"<li>{s}</li>" if t == "li" and rng.random() < 0.5 else f"<{t if t != 'li' else 'p'}>{s}</{t if t != 'li' else 'p'}>")
            if rng.random() < 0.06:
                inside.append(furniture(pick(["ad", "side", "tool", "note", "form"])))
        if rng.random() < 0.3 and len(inside) > 3:
            i = int(rng.integers(len(inside)))
            inside[i] = inside[i].replace("<p>", pick(["<blockquote>", "<p>", '<p class="lead">'])).replace("</p>", "</blockquote>" if "<blockquote>" in inside[i] else "</p>")
        tag = pick(["div", "div", "section", "article", "main", "td"])
        name = pick([f'class="{pick(MAIN_NAMES)}"', f'id="{pick(MAIN_NAMES)}"', f'class="{pick(MAIN_NAMES)}-{pick(MAIN_NAMES)}"', f'class="c{int(rng.integers(99))}"', ""])
        body = f"<{tag} {name} data-role=\"\x01\">{''.join(inside)}</{tag}>"
        if tag == "td":
            body = f"<table><tr>{body}</tr></table>"
        before = [furniture(k) for k in ("note", "head", "menu", "ad", "side", "form") if rng.random() < 0.5]
        after = [furniture(k) for k in ("tool", "talk", "side", "ad", "menu", "form", "foot") if rng.random() < 0.5]
        rng.shuffle(before)
        wrap = pick(["", "div", "section"])
        inner = "".join(before) + body + "".join(after)
        inner = f'<{wrap} class="{pick(["wrap", "container", "layout", "outer", "grid"])}">{inner}</{wrap}>' if wrap else inner
        yield f"<!DOCTYPE html><html><head><title>{say(2, 8)}</title></head><body>{inner}</body></html>"


def _within(x: Node, top: Node) -> bool:
    while x is not None:
        if x is top:
            return True
        x = x.parent
    return False


def _rebuilt_marks(nodes: list[Node]) -> np.ndarray:
    """Marks of a rebuilt page: below the marked node all but the furniture that was put in."""
    inside = np.zeros(len(nodes), dtype=bool)
    for i, x in enumerate(nodes):
        if "\x01" in x.names:
            inside[i] = True
            x.names = x.names.replace("\x01", "").strip()
        elif i and inside[x.parent.index]:
            kinds = set(_WORDS.findall(x.names)) & set(_KINDS) if x.names else ()
            inside[i] = x.tag not in ("nav", "footer", "aside", "form", "button", "header") and not kinds
    return inside


def _examples(page: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a page and of its other layouts, at most PAGE_EXAMPLES, drawn evenly."""
    xs, ys, ws = [], [], []
    rng = np.random.default_rng(zlib.crc32(page.encode("utf-8", "surrogatepass")))
    made = [(nodes_of(parse(page)), marks_of(page))]
    for other in layouts(page, rng, LAYOUTS):
        nodes = nodes_of(parse(other))
        made.append((nodes, _rebuilt_marks(nodes)))
    for nodes, marks in made:
        x = features(nodes)
        own = np.expm1(x[:, 1])
        told = own > 0
        xs.append(x[told])
        ys.append(marks[told].astype(float))
        ws.append(np.sqrt(own[told]) / 8)
    x, y, w = np.vstack(xs), np.concatenate(ys), np.concatenate(ws)
    if len(x) > PAGE_EXAMPLES:
        kept = np.sort(rng.permutation(len(x))[:PAGE_EXAMPLES])
        x, y, w = x[kept], y[kept], w[kept]
    return x, y, w


def fit_extractor(pages: DataFrame, rows: int = FIT_PAGES) -> BoostedTrees | None:
    """Examples are made in the tasks and the trees are grown on the driver; `rows` and PAGE_EXAMPLES bound both. Pages with a
    landmark teach, whatever their length. None where no page has one."""
    marked = pages.select("html", F.xxhash64("page_id", "html").alias("h")).where(F.lower(F.col("html")).rlike(r"<(article|main)[\s>]"))
    chosen = marked.select(F.col("h").alias("chosen")).orderBy("chosen").limit(rows)
    sample = marked.join(F.broadcast(chosen), F.col("h") == F.col("chosen"), "left_semi")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for page in b["html"]:
                if marks_of(page) is not None:
                    x, y, w = _examples(page)
                    yield pd.DataFrame({"x": [x.astype(np.float32).tobytes()], "y": [y.astype(np.int8).tobytes()], "w": [w.astype(np.float32).tobytes()]})

    found = sample.mapInPandas(make, "x binary, y binary, w binary").limit(rows).collect()
    if not found:
        return None
    x = np.concatenate([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, len(FEATURES)) for r in found]).astype(float)
    y = np.concatenate([np.frombuffer(r["y"], dtype=np.int8) for r in found]).astype(float)
    w = np.concatenate([np.frombuffer(r["w"], dtype=np.float32) for r in found]).astype(float)
    return BoostedTrees.fit(x, y, w) if 0 < y.mean() < 1 else None


def main_texts(pages: list[str | None], model: BoostedTrees | None) -> list[str]:
    """The main text of each page; the trees look at the nodes of all of them at once. Without a model (no page of
    the table has a landmark to learn from) all text that is shown is taken."""
    trees = [nodes_of(parse(p)) for p in pages]
    if model is None:
        return [text_of_nodes(nodes, np.ones(len(nodes), dtype=bool)) for nodes in trees]
    x = [features(nodes) for nodes in trees]
    odds = np.split(model.log_odds(np.vstack(x)), np.cumsum([len(nodes) for nodes in trees])[:-1])
    return [text_of_nodes(nodes, decode(nodes, z, np.expm1(f[:, 1]))[homes(nodes)]) for nodes, z, f in zip(trees, odds, x)]


def main_text(page: str | None, model: BoostedTrees | None) -> str:
    return main_texts([page], model)[0]


def extract(pages: DataFrame, model: BoostedTrees | None, keep: list[str]) -> DataFrame:
    """The kept columns, text and n_chars of every page; null and empty pages have no text."""
    source = pages.select(*keep, F.col("html").alias("_html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            html = b["_html"].tolist()
            text = [t for i in range(0, len(html), PAGES_AT_ONCE) for t in main_texts(html[i:i + PAGES_AT_ONCE], model)]
            yield b[keep].assign(text=text, n_chars=[len(t) for t in text])

    return source.mapInPandas(run, schema_of(source, keep, "text string, n_chars bigint"))


def op5_html_main(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, main text and its code points. Null and empty pages have no text; repeated rows and null ids get
    their result like others; long pages are read whole; an empty table gives an empty result."""
    return extract(pages, fit_extractor(pages), ["page_id", "url"])
