import itertools
import math
import random
import time

import numpy as np

from loomspark.llm.html_extract import _MARK, Node, decode, extract, generated_page, main_text, parse, trained


def truth(page):
    _, blocks = parse(_MARK.sub(lambda m: f' itemprop="zz{m[1]}zz"', page))
    return "\n".join(t for n, t in blocks if "zzmainzz" in n.tokens)


def test_held_out_layouts():
    rng = random.Random(99)
    pages = [generated_page(rng) for _ in range(200)]
    got = extract([_MARK.sub("", p) for p in pages], *trained())
    assert sum(a == truth(p) for a, p in zip(got, pages, strict=True)) >= 185


def test_broken_deep_and_long_pages_take_linear_time():
    n = 30_000
    pages = ["<a " * n, "<div>" * n + "</p>" * n, "<div>" * n + "<li>" * n, "<li><ul>" + "<div>" * n + "<li>" * n, '<b ">" ' * n, "<head>" * n, "<!--" * n, "<title>" * n, "<a '" * n + ">", "x<p>" * n, "word " * n * 4]
    began = time.process_time()
    texts = extract(pages, *trained())
    assert time.process_time() - began < 60 and len(texts) == len(pages)
    for page in pages:
        nodes, blocks = parse(page[:3000])
        assert nodes[0].parent is None and all(n.depth == n.parent.depth + 1 for n in nodes[1:])
    assert parse("<div><p>one<p>two</div>three<!-- four")[1][-1][1] == "three"
    assert [t for _, t in parse('<p title="a > b">one</p> < two <b')[1]] == ["one", "< two <b"]
    assert parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>")[0][-1].depth == 2


def test_pages_written_by_hand():
    """Layouts that the page generator does not make."""
    blog = """<body><div id="top-bar"><a href="/">Home</a> | <a href="/about">About</a></div>
    <div class="post-body entry"><h2>On rivers and their names</h2><p>Rivers were named long before towns were. The oldest names are short, and nobody knows what they mean.</p>
    <p>Some of them return across the continent, from the hills down to the sea, and scholars have argued about them for a century.</p></div>
    <div class="sidebar widget"><h3>Archive</h3><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div>
    <div id="comments"><div class="comment"><p>Nice post, thank you.</p></div></div><div class="footer">Copyright 2020. All rights reserved.</div></body>"""
    news = """<html><body><header><h1>The Daily Paper</h1><nav><a href="/w">World</a><a href="/s">Sport</a></nav></header><main><article>
    <p>The council agreed on Tuesday to mend the old bridge. Work begins in spring and will take two years.</p><aside class="related"><a href="/x">More on bridges</a></aside>
    <blockquote>We could not wait any longer, said the mayor after the meeting.</blockquote></article></main><footer><p>Contact us. Terms of use.</p></footer></body></html>"""
    got = extract([blog, news], *trained())
    assert "Rivers were named" in got[0] and "scholars have argued" in got[0] and not any(x in got[0] for x in ("Archive", "June", "Nice post", "Copyright", "About"))
    assert "council agreed" in got[1] and "said the mayor" in got[1] and not any(x in got[1] for x in ("Sport", "More on bridges", "Terms of use"))


def test_blocks_and_references(spark):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Menu</a><li><a href="/b">More</a></ul></nav><!-- ad --><div class="ad">Buy it now.</div>
    <article><h1>A  title &amp;\n more</h1><p><b>First &lt;line&gt;.<br>Same block.<br><p>Second&nbsp;one, with <i>in</i>line.</p></article>
    <footer>&copy; them</footer></body></html>"""
    rows = [(1, "u", page, 7), (2, None, None, 8), (None, "u", "", 9), (4, "u", "<p", 1), (4, "u", "<p", 1), (5, "u", "</div></p>plain < text &", 2)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == 6
    first = next(r for r in got if r.page_id == 1)
    assert first.text == "A title & more\nFirst <line>. Same block.\nSecond one, with inline."
    assert all(r.n_chars == len(r.text) for r in got) and next(r for r in got if r.page_id == 2).text == ""
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decoding_is_the_best_of_all_consistent_labellings():
    rng = random.Random(5)
    seen = set()
    for _ in range(150):
        nodes = [Node("div", None, ())]
        for _ in range(rng.randint(0, 6)):  # page order: a new element's parent is the last one or an ancestor of it
            parent = nodes[-1]
            while parent.parent and rng.random() < 0.4:
                parent = parent.parent
            nodes.append(Node("div", parent, ()))
            parent.children.append(nodes[-1])
        for n in nodes:
            n.own = rng.choice([0, 0, 3, 80, 2000])
        margins = np.array([rng.gauss(0, 3) for _ in nodes])
        at = {id(n): i for i, n in enumerate(nodes)}
        best, labels = -math.inf, None
        for states in itertools.product("open kept out".split(), repeat=len(nodes)):
            total = 0.0
            for n, m, state in zip(nodes, margins, states, strict=True):
                above = states[at[id(n.parent)]] if n.parent else "open"
                if (state == "open" and not n.children) or (above == "out" and state != "out") or (above == "kept" and state == "open"):
                    break
                p = 1 / (1 + math.exp(-m))
                total += -(0.8 + 2 * math.log1p(n.own)) if state == "open" else (1 + math.log1p(n.own)) * math.log(p if state == "kept" else 1 - p)
            else:
                if total > best:
                    best, labels = total, states
        assert [x == "kept" for x in labels] == decode(nodes, margins).tolist()
        seen.update(labels)
    assert seen == {"open", "kept", "out"}
