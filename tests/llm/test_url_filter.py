import time

import duckdb
from pyspark.sql import functions as F

from loomspark.llm.components import connected_components
from loomspark.llm.page_links import decode_references
from loomspark.llm.url_filter import SQL, judge


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rules_and_aliases(spark):
    canonical = '<link href="{}" rel="canonical">'.format
    rows = [
        (1, "https://a.example.org/es/9", ""),  # the longer rule blocks
        (2, "http://a.example.org/xx/", ""),  # org/ allows
        (3, "https://x.com/de/1", None),  # blocked
        (4, "https://x.net/page", '<head><LINK rel=canonical HREF="https://x.com/de/1"></head>'),  # alias of a blocked page
        (5, "https://y.net/a?utm_source=feed#top", canonical("//y.com/fr/1")),  # alias of an allowed one
        (6, "http://www.y.net/a/", canonical("https://x.com/de/1")),  # same place as 5: allow comes first
        (7, "https://z.net/", '<meta http-equiv="refresh" content="0; url=/b">'),
        (8, "https://z.net/b", ""),
        (9, None, None), (10, "not a url", ""), (10, "not a url", ""), (None, "HTTP://Q.COM/fr", ""),
    ]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = {r.page_id: r for r in judge(docs).collect()}
    assert plain[6].verdict == "block" and plain[5].place == "y.net/a?utm_source=feed" and plain[6].place == "www.y.net/a/"  # no link joins 5 and 6
    got = {r.page_id: r for r in judge(docs, merge_variants=True).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", None: "allow"}
    assert got[1].rule == "example.org/es/" and got[2].rule == "org/" and got[4].rule is None and got[9].host == got[10].path == "" and got[None].host == "q.com"
    assert got[7].component == got[8].component and got[5].place == got[6].place == "y.net/a"
    alone = docs.filter("page_id NOT IN (5, 6)")
    assert {r.page_id: r.verdict for r in judge(alone).collect()}[4] == "block"
    redirects = spark.createDataFrame([("http://z.net/b", "https://x.com/de/1")], "src string, dst string")
    assert {r.page_id: r.verdict for r in judge(alone, redirects).collect()}[7] == "block"
    assert judge(docs.limit(0)).count() == 0


def test_relative_links_and_refresh_in_any_order(spark):
    link = '<link rel="canonical" href="{}">'.format
    refresh = '<meta content="0; url={}" http-equiv="refresh">'.format
    targets = [
        ("https://a.net/x/page", link("page2.html"), "a.net/x/page2.html"), ("https://b.net/x/y/page", link("../a"), "b.net/x/a"), ("https://c.net/x/page?old=1", link("?id=1"), "c.net/x/page?id=1"),
        ("https://d.net", link("de/../../e"), "d.net/e"), ("https://e.net/x/", link("./?next=https://x.com/de/1"), "e.net/x/?next=https://x.com/de/1"), ("https://f.net/a/b?c/d", link("e"), "f.net/a/e"),
        ("https://g.net/a", refresh("https://b.example/x"), "b.example/x"), ("https://h.net/a/b", '<meta http-equiv="refresh" content="5"><meta content=\'0;URL="c"\' http-equiv=Refresh>', "h.net/a/c"),
        ("https://l.net/a", link("/b?x=1&amp;y=2"), "l.net/b?x=1&y=2"), ("https://m.net/a", link("#") + link("/second"), "m.net/second"),
        ("https://i.net/a", link("mailto:a@b.example"), None), ("https://j.net/a", link("#top"), None), ("no url", link("a"), None), ("https://k.net/a", '<meta name="refresh" content="url=/b">', None),
    ]
    pages = [(2 * i, url, html) for i, (url, html, _) in enumerate(targets)] + [(2 * i + 1, f"https://{to}", "") for i, (_, _, to) in enumerate(targets) if to]
    got = {r.page_id: r for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, (_, _, to) in enumerate(targets):
        assert got[2 * i].component == (min(got[2 * i].place, to) if to else got[2 * i].place), targets[i]
    blocked = [(1, "https://a.com/de/page", ""), (2, "https://a.com/x/old", link("../de/page")), (3, "https://b.net/", refresh("https://a.com/x/old"))]
    assert {r.verdict for r in judge(spark.createDataFrame(blocked, "page_id long, url string, html string")).collect()} == {"block"}


def test_entities_and_long_pages(spark):
    link = '<link rel="canonical" href="{}">'.format
    long = "<p>text</p>" * 200_000
    rows = [(1, "https://a.net/x", link("/t?a=1&amp;b=2")), (2, "https://b.net/x", link("https://a.net/t?a=1&#38;b=2") + long), (3, "https://c.net/x", long + link("https://a.net/t?a=1&b=2")), (4, "https://d.net/" + "y" * 100_000, None)]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len({got[i].component for i in (1, 2, 3)}) == 1 and len(got[4].path) == 100_001


def test_bases_references_comments_and_all_refreshes(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    refresh = '<meta http-equiv="refresh" content="{}">'.format
    to = "https://x.com/de/1"
    pages = [  # url, html, whether the page is an alias of `to`
        ("https://a1.net/p", '<base href="https://x.com/de/">' + canonical("1"), True),
        ("https://a2.net/p", '<base target=_top><base href="//x.com/fr/"><base href="https://other.net/">' + canonical("../de/./1"), True),
        ("https://a3.net/p", '<base href="data:,x">' + canonical("/de/1"), False),
        ("https://a4.net/p", canonical("https&#58;//x&#x2e;com&sol;de&#0047;1"), True),
        ("https://a5.net/p", canonical("https&colon;&sol;&sol;x&period;com/de/1"), True),
        ("https://a6.net/p", refresh("5") + refresh("0; url=https://x.com/de/1") + refresh("9;url=/later"), True),
        ("https://a7.net/p", refresh("9; https://other.net/") + refresh("1, URL = 'https://x.com/de/1' ; more"), True),
        ("https://a8.net/p", f"<!-- {canonical(to)} -->", False),
        ("https://a9.net/p", f"<!-- open {canonical(to)}", False),
        ("https://b1.net/p", f"<script>var s = '{canonical(to)}';</script>", False),
        ("https://b2.net/p", f"<script>1</script><style>p</style ><!---->{canonical(to)}", True),
        ("https://b3.net/p", f"<textarea>{canonical(to)}</textarea><titles>" + canonical("/x"), False),
        ("https://b4.net/p", f"<link title='a > b' data-href=\"/x\" href={to} href=/y rel='nofollow\nCANONICAL'>", True),
        ("https://b5.net/p", f"<link rel=canonical href={to}", False),  # the tag does not end
        ("https://b6.net/p", f"<linked rel=canonical href={to}>", False),
        ("https://b7.net/p", canonical(" https://x.com/\n  \tde/1 ".replace("  ", "")), True),
        ("https://b8.net/p", '<meta name="refresh" content="0;url=https://x.com/de/1">', False),
        ("https://b9.net/p", canonical("") + '<link rel="canonicals" href="https://x.com/de/1">', False),
        ("https://c1.net/p", canonical("https://x.com/de/1?a=1&copy=2"), False),
        ("no url", canonical(to), False),
        (None, canonical(to), False), ("https://c2.net/p", None, False),
        ("https://x.com/de/1", "", True),
        ("https://x.com/de/1?a=1&copy=2", "", False),
    ]
    rows = [(i, url, html) for i, (url, html, _) in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in judge(table).collect()}
    home = next(r.component for r in got.values() if r.place == "x.com/de/1")
    for i, (url, html, alias) in enumerate(pages):
        assert (got[i].component == home) == alias, (url, html)
    assert got[18].component == got[23].component == "c1.net/p"
    con = duckdb.connect()
    con.register("pages", table.toPandas())
    sql = con.execute(SQL).fetchall()
    key = lambda rows: sorted(map(str, rows))
    assert key(sql) == key(tuple(r) for r in judge(table).collect())


def test_references(spark):
    texts = ["a&amp;b", "&AMP;&amp=1&ampx&amp", "&#65;&#x41;&#0;&#128;&#xD800;&#99999999999999999999999;&#x110000;", "&#128578;&;&#;&#x;&nosuch;", "&notin;&not;&notit;", "x", "", "&" * 50_000]
    want = ["a&b", "&&amp=1&ampx&", "AA�€���", "\U0001f642&;&#;&#x;&nosuch;", "∉¬&notit;", "x", "", "&" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [r.d for r in df.select("i", decode_references(F.col("t")).alias("d")).orderBy("i").collect()] == want


def test_broken_pages_take_linear_time(spark):
    many = 60_000
    bodies = ["<link " * many, "<!-- " * many, "<script>" * many, '<link rel="canonical" href="' * many, "<link rel=canonical href='/a'>" * 2_000, "<link" + " a='>'" * many + ">", "&" * many, "<meta http-equiv=refresh content='" + "0;" * many + "'>"]
    pages = spark.createDataFrame([(i, f"https://p{i}.net/", "canonical refresh " + b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    begin = time.monotonic()
    assert judge(pages).count() == len(bodies)
    assert time.monotonic() - begin < 60
