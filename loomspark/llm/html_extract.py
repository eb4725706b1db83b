"""Main text from HTML by gradient-boosted trees over DOM nodes and hierarchical decoding (operator 4).

A page becomes a tree of block elements. Each has features of its subtree (length, link and tag density), attribute
tokens, tag, depth and siblings; boosted trees, trained on generated pages of many layouts, give the odds that it is
article text. Decoding picks the likeliest consistent labelling of the tree: below an excluded element nothing is kept.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(id|class|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_END = re.compile(r"[.!?…]")
# Element names of HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript template svg iframe object select button canvas head".split())
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
TAGS = "p div section article main ul ol li table td h1 h2 h3 header footer nav aside form blockquote body".split()


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "children", "own", "chars", "linked", "tags", "links", "paragraphs", "items", "inputs", "sentences", "blocks")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple[str, ...]):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.own = self.chars = self.linked = self.tags = self.links = self.paragraphs = self.items = self.inputs = self.sentences = self.blocks = 0


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block elements in page order, the first the root, and text blocks (element, text) in page order.

    Time is linear in the page, however deep or broken: no tag is looked for behind the last >, and where elements of
    each name are open is kept, so that nothing searches the open elements.
    """
    root = Node("html", None, ())
    nodes, blocks, stack, text, linked = [root], [], [root], [], 0
    inline: list[str] = []  # open <a> elements
    opened: dict[str, list[int]] = {}  # by name, the places of open elements in stack

    def innermost(names) -> int:
        return max((opened[t][-1] for t in names if opened.get(t)), default=0)

    def close(place: int) -> None:
        for n in stack[place:]:
            opened[n.tag].pop()
        del stack[place:]

    def end_block() -> None:
        nonlocal linked
        if text:
            words = "".join(text).split()
            if words:
                joined, node = " ".join(words), stack[-1]
                blocks.append((node, joined))
                node.own += len(joined)
                node.linked += min(linked, len(joined))
                node.sentences += len(_END.findall(joined))
                node.blocks += 1
            text.clear()
        linked = 0

    at, size, last, heads = 0, len(page), page.rfind(">") + 1, True
    while at < size:
        m = _TOKEN.search(page, at, last) if at < last else None
        chunk = page[at : m.start()] if m else page[at:].partition("<!--")[0]
        if chunk:
            if "&" in chunk:
                chunk = html.unescape(chunk)
            text.append(chunk)
            if inline:
                linked += len(chunk)
        if not m:
            break
        at = size if m[0].startswith("<!--") and not m[0].endswith("-->") else m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, rest = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            if name == "a":
                if inline:
                    inline.pop()
            elif name in BLOCK:
                end_block()
                if place := innermost([name]):
                    close(place)
            continue
        stack[-1].tags += 1
        if name in RAW:
            if name != "head" and not rest.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at, last)
                at = end.end() if end else size
            elif name == "head" and heads:
                end = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(page, at, last)
                heads = end is not None  # if there is none, none follows either
                at = (end.end() if end[0][1] == "/" else end.start()) if end else at
            if name in ("textarea", "select", "button"):
                stack[-1].inputs += 1
            continue
        if name == "br":
            text.append(" ")
        elif name == "input":
            stack[-1].inputs += 1
        elif name == "a":
            stack[-1].links += 1
            inline = ["a"]
        if name in BLOCK:
            end_block()
            inline = []
            if name in ("html", "hr"):
                continue
            if stack[-1].tag == "p":
                close(len(stack) - 1)
            if name in CLOSES and (place := innermost(CLOSES[name])) > innermost(("ul", "ol", "table", "dl")):
                close(place)
            tokens = tuple(t for a in _ATTRIBUTE.finditer(rest) for t in _PART.findall((a[2] or a[3] or a[4] or "").lower())) if "=" in rest else ()
            node = Node(name, stack[-1], tokens)
            stack[-1].children.append(node)
            nodes.append(node)
            opened.setdefault(name, []).append(len(stack))
            stack.append(node)
    end_block()
    for n in reversed(nodes):
        n.chars += n.own
        n.paragraphs += n.tag == "p"
        n.items += n.tag == "li"
        if n.parent:
            p = n.parent
            p.chars += n.chars
            p.linked += n.linked
            p.tags += n.tags
            p.links += n.links
            p.paragraphs += n.paragraphs
            p.items += n.items
            p.inputs += n.inputs
            p.sentences += n.sentences
            p.blocks += n.blocks
    return nodes, blocks


def node_features(nodes: list[Node], vocabulary: dict[str, int]) -> np.ndarray:
    """One row per node. Numbers first, then tag, parent's tag, own attribute tokens, ancestors' tags and tokens."""
    base, width = 17, len(TAGS)
    out = np.zeros((len(nodes), base + 3 * width + 2 * len(vocabulary)), np.float32)
    total = max(1, nodes[0].chars)
    row, place = {}, {}
    for n in nodes:
        for i, c in enumerate(n.children):
            place[id(c)] = i
    tag_at = {t: i for i, t in enumerate(TAGS)}
    for r, n in enumerate(nodes):
        row[id(n)] = r
        p = n.parent
        siblings = p.children if p else [n]
        at, count = place.get(id(n), 0), len(siblings)
        before, after = (siblings[at - 1] if at else None), (siblings[at + 1] if at + 1 < count else None)
        x = out[r]
        x[:base] = (
            math.log1p(n.chars), math.log1p(n.own), n.linked / max(1, n.chars), math.log1p(n.tags), math.log1p(n.chars / (n.tags + 1)),
            n.depth, at, count, (at + 1) / count, n.chars / max(1, p.chars if p else total), n.chars / total,
            n.sentences * 40 / (n.chars + 40), math.log1p(n.paragraphs), math.log1p(n.items), n.inputs,
            math.log1p(before.chars) if before else -1, math.log1p(after.chars) if after else -1,
        )
        tag = tag_at.get(n.tag)
        if tag is not None:
            x[base + tag] = 1
        for t in n.tokens:
            if t in vocabulary:
                x[base + 3 * width + vocabulary[t]] = 1
        if p:
            up = out[row[id(p)]]
            tag = tag_at.get(p.tag)
            if tag is not None:
                x[base + width + tag] = 1
            x[base + 2 * width : base + 3 * width] = np.maximum(up[base + 2 * width : base + 3 * width], up[base : base + width])
            k = base + 3 * width + len(vocabulary)
            x[k:] = np.maximum(up[k:], up[base + 3 * width : k])
    return out


class Trees:
    """Boosted trees of a fixed depth for the logistic loss, grown on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 2.0):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        self.depth, self.trees = depth, []
        score = np.zeros(len(y))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-6
            feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf, np.float32)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                own = node - first
                gs, hs = np.bincount(own, g, width), np.bincount(own, h, width)
                best = np.full(width, 1e-3)
                split = np.full(width, -1)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = len(e) + 1
                    key = own * k + binned[:, f]
                    gl = np.bincount(key, g, width * k).reshape(width, k).cumsum(1)[:, :-1]
                    hl = np.bincount(key, h, width * k).reshape(width, k).cumsum(1)[:, :-1]
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None]
                    gain[(hl < 1) | (hr < 1)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    for n in np.flatnonzero(top > best):
                        best[n], split[n] = top[n], f
                        feature[first + n], threshold[first + n] = f, e[at[n]]
                go = x[np.arange(len(y)), feature[node]] > threshold[node]
                node = 2 * node + 1 + go
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
            score += value[leaf]
            self.trees.append((feature, threshold, value))

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return total


def generated_page(rng: random.Random) -> str:
    """A page of a random layout. Its article's block elements carry the attribute data-main, its other ones do not."""
    letters = rng.choice(["etaoinshrdlu", "aeioulnrstéè", "enirstadhuäö", "aeosrnidlcñó"])

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(max(1, n)))

    def prose(n: int) -> str:
        out, left = [], n
        while left > 0:
            k = min(left, rng.randint(1, 16))
            out.append(words(k).capitalize() + rng.choice("...!?"))
            left -= k
        return rng.choice(["", "", "<b>"]) + " ".join(out)

    def name(*options: str) -> str:
        one = rng.choice(options)
        return rng.choice([f' class="{one}"', f' id="{one}"', f' class="{one} {words(1)}"']) if one else ""

    def menu() -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(rng.randint(1, 2))}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"

    def ad() -> str:
        kind = rng.choice(["ad", "ads", "advert", "sponsored", "promo", "banner", "ad-box"])
        return f"<div{name(kind)}>{prose(rng.randint(2, 40))}</div>"

    def notice() -> str:
        return f"<div{name('cookie-notice', 'notice', 'cookie-banner', 'alert', 'consent', 'gdpr')}><p>{prose(rng.randint(4, 30))}</p>{rng.choice(['', '<button>ok</button>'])}</div>"

    def form() -> str:
        return f"<form{name('', 'newsletter', 'signup', 'search-form', 'subscribe')}><label>{words(3)}</label>{rng.choice(['', f'<p>{prose(12)}</p>'])}<input name=q><button>go</button></form>"

    def links() -> str:
        return f"<div{name('related', 'share', 'social', 'breadcrumbs', 'tags', 'pagination', 'more')}>{rng.choice([f'<h3>{words(2)}</h3>', ''])}{menu()}</div>"

    def comments() -> str:
        one = lambda: f"<div{name('comment', 'comment-body', 'reply')}>{rng.choice(['', f'<p>{words(2)}</p>'])}<p>{prose(rng.randint(3, 60))}</p></div>"
        return f"<{(t := rng.choice(['section', 'div', 'ul']))}{name('comments', 'comment-list', 'discussion', 'responses')}><h3>{words(1)}</h3>{''.join(one() for _ in range(rng.randint(1, 6)))}</{t}>"

    def sidebar() -> str:
        t = rng.choice(["aside", "div", "aside"])
        return f"<{t}{name('sidebar', 'widget', 'side', 'rail') if t == 'div' else name('', 'sidebar', 'widget')}><h3>{words(2)}</h3>{rng.choice([menu(), f'<p>{prose(rng.randint(5, 50))}</p>', menu() + ad()])}</{t}>"

    def top() -> str:
        t = rng.choice(["header", "header", "div"])
        return f"<{t}{name('header', 'masthead', 'site-header', 'top') if t == 'div' else name('', 'site-header')}>{rng.choice([f'<h1>{words(2)}</h1>', f'<div>{words(3)}</div>', f'<p>{prose(8)}</p>'])}{rng.choice(['', menu()])}</{t}>"

    def nav() -> str:
        t = rng.choice(["nav", "nav", "div"])
        return f"<{t}{name('nav', 'menu', 'navbar', 'navigation') if t == 'div' else name('', 'menu')}>{menu()}</{t}>"

    def footer() -> str:
        t = rng.choice(["footer", "footer", "div"])
        return f"<{t}{name('footer', 'site-footer', 'copyright', 'bottom') if t == 'div' else name('', 'site-footer')}>{rng.choice(['&copy; ' + words(3) + ' &middot; ' + prose(rng.randint(1, 30)), f'<p>{prose(20)}</p>' + menu()])}</{t}>"

    main, body = " data-main", []
    for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
        kind = rng.random()
        if kind < 0.78:
            p = f"<p{main}>{prose(rng.choice([1, 2, 5, 20, 60, 120]))}"
            body.append(p + rng.choice(["</p>", "</p>", "<br>"]))
        elif kind < 0.86:
            body.append(f"<ul{main}>" + "".join(f"<li{main}>{prose(rng.randint(1, 20))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.92:
            body.append(f"<blockquote{main}>{rng.choice([prose(15), f'<p{main}>{prose(20)}</p>'])}</blockquote>")
        else:
            body.append(f"<h2{main}>{words(4)}</h2>")
    title = f"<h1{main}>{words(rng.randint(1, 9))}</h1>"
    inner = [rng.choice([title, title, f"<header{main}>{title}</header>", ""]), *body]
    if len(inner) < 2 or not body:
        inner = [title, *body]
    for extra, chance in ((ad, 0.25), (links, 0.2), (form, 0.1), (notice, 0.08), (comments, 0.12)):
        if rng.random() < chance:
            inner.insert(rng.randint(1, len(inner)), extra())
    tag = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
    marks = name("content", "post-content", "entry", "story", "article-body", "main", "post", "article") if tag in ("div", "section") and rng.random() < 0.85 else rng.choice(["", "", name("content", "post", "entry")])
    core = f"<{tag}{marks} data-wrap>{''.join(inner)}</{tag}>"
    if tag == "td":
        core = f"<table><tr><td>{menu()}</td>{core}</tr></table>"
    parts = [core]
    for piece, chance in ((top, 0.5), (nav, 0.75), (ad, 0.6), (notice, 0.3)):
        if rng.random() < chance:
            parts.insert(rng.randint(0, parts.index(core)), piece())
    for piece, chance in ((sidebar, 0.5), (comments, 0.35), (links, 0.35), (form, 0.25), (ad, 0.3)):
        if rng.random() < chance:
            parts.insert(rng.randint(parts.index(core) + 1, len(parts)), piece())
    if rng.random() < 0.25:
        i, j = (0, len(parts)) if rng.random() < 0.5 else (parts.index(core), len(parts))
        parts[i:j] = [f"<div{name('wrapper', 'container', 'page', 'row', '')}>" + "".join(parts[i:j]) + "</div>"]
    if rng.random() < 0.85:
        parts.append(footer())
    return f"<html><head><title>{words(3)}</title></head><body>{''.join(parts)}</body></html>"


_MARK = re.compile(r" data-(main|wrap)\b")


def labelled_nodes(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a generated page and their labels: 1 article, 0 not, -1 holds both."""
    marked = _MARK.sub(lambda m: f' itemprop="zz{m[1]}zz"', page)
    nodes, _ = parse(marked)
    labels = np.array([1 if "zzmainzz" in n.tokens else 2 if "zzwrapzz" in n.tokens else 0 for n in nodes])
    at = {id(n): i for i, n in enumerate(nodes)}
    mixed = set()
    for n in nodes:
        if labels[at[id(n)]]:
            p = n.parent
            while p:
                if labels[at[id(p)]] == 0:
                    mixed.add(at[id(p)])
                p = p.parent
    holds_other = {at[id(n.parent)] for i, n in enumerate(nodes) if n.parent and labels[i] == 0}
    for i, n in enumerate(nodes):
        n.tokens = tuple(t for t in n.tokens if not t.startswith("zz"))
        if labels[i] == 2:
            labels[i] = -1 if i in holds_other else 1
        if i in mixed:
            labels[i] = -1
    return nodes, labels


@lru_cache(maxsize=1)
def trained(pages: int = 500, seed: int = 11) -> tuple[dict[str, int], Trees]:
    """Attribute vocabulary and trees from `pages` generated pages."""
    rng = random.Random(seed)
    sample = [labelled_nodes(generated_page(rng)) for _ in range(pages)]
    counts: dict[str, int] = {}
    for nodes, _ in sample:
        for t in {t for n in nodes for t in n.tokens if len(t) > 1}:
            counts[t] = counts.get(t, 0) + 1
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, c in counts.items() if c >= 6))}
    x = np.concatenate([node_features(nodes, vocabulary) for nodes, _ in sample])
    y = np.concatenate([labels for _, labels in sample])
    return vocabulary, Trees(x[y >= 0], y[y >= 0].astype(float))


def decode(nodes: list[Node], margins: np.ndarray) -> np.ndarray:
    """For each node whether its own text is kept, by the likeliest consistent labelling.

    An element is open (holds both, text not kept), kept or excluded. Below an excluded one all are excluded; a kept one
    may hold excluded ones; only below open ones may a kept one start.
    """
    at = {id(n): i for i, n in enumerate(nodes)}
    weight = np.array([1 + math.log1p(n.own) for n in nodes])
    kept, out = -np.logaddexp(0, -margins) * weight, -np.logaddexp(0, margins) * weight
    opened = np.array([-(0.8 + 2.0 * math.log1p(n.own)) if n.children else -1e9 for n in nodes])
    score = np.stack([opened, kept, out], 1)
    children = [[at[id(c)] for c in n.children] for n in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        for c in children[i]:
            s = score[c]
            score[i] += (max(s[0], s[1], s[2]), max(s[1], s[2]), s[2])
    state = np.zeros(len(nodes), np.int64)
    state[0] = int(score[0].argmax())
    for i in range(len(nodes)):
        for c in children[i]:
            state[c] = 2 if state[i] == 2 else (1 + int(score[c][1:].argmax()) if state[i] == 1 else int(score[c].argmax()))
    return state == 1


def extract(pages: list[str | None], vocabulary: dict[str, int], trees: Trees) -> list[str]:
    """The main text of each page; empty for null pages and pages without any."""
    out = [""] * len(pages)
    for a in range(0, len(pages), 256):
        parsed = [(i, *parse(p)) for i, p in enumerate(pages[a : a + 256], a) if p]
        if not parsed:
            continue
        margins = trees.margin(np.concatenate([node_features(nodes, vocabulary) for _, nodes, _ in parsed]))
        for i, nodes, blocks in parsed:
            own, margins = margins[: len(nodes)], margins[len(nodes) :]
            keep = {id(n) for n, k in zip(nodes, decode(nodes, own), strict=True) if k}
            out[i] = "\n".join(text for n, text in blocks if id(n) in keep)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null and empty html give an empty text. Blocks are joined by line feeds in page order; white space in a block is one
    space, <br> included. Repeated rows and null ids are kept; extra columns are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        vocabulary, trees = sent.value
        for batch in sliced(batches):
            texts = extract(batch.column(2).to_pylist(), vocabulary, trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
