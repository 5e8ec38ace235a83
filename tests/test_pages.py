import html

from pyspark.sql import functions as F

from lodestream.functions import pages

PAGE = """<html><head><title>T</title><script src="/a.js">var x = "<a href='no'>";</script><link rel="StyleSheet" href="s.css"><link rel=icon href="/i.png"><meta name="Generator" content=" wp "><meta property="og:x" content="1"><style>p {}</style></head>
<body><p>Fish &amp; Chips</p><a href="/x/?a=1#f" title="Go">To <b>x</b></a><a href="#top">no</a><a href="MAILTO:a">no</a><a href="https://Other.de/shop">Shop</a><a href="https://www.site.de/y/">y</a><a>none</a></body></html>"""


def parsed(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "n bigint, html string, row_id string")
    return pages.parse_pages(df, "n", "html", F.lit("https://site.de/dir/"))


def test_parts_of_a_page(spark):
    got = parsed(spark, [PAGE, None, "", "<a href='http://[bad'>x</a><a href=ok>", "<" * 1000]).orderBy("row_id").collect()
    page = got[0]
    assert [(a.href, a.text) for a in page.anchors] == [("https://site.de/x/?a=1#f", "Go To x"), ("https://Other.de/shop", "Shop"), ("https://www.site.de/y/", "y")]
    assert page.scripts == ["https://site.de/a.js"] and page.stylesheets == ["https://site.de/dir/s.css"] and len(page.head_links) == 2
    assert page.meta == {"generator": "wp", "og:x": "1"}
    assert [len(r.anchors) for r in got] == [3, 0, 0, 1, 0]


def test_links_of_the_same_site(spark):
    links = parsed(spark, [PAGE]).select(F.explode("anchors.href").alias("h")).select(pages.link_address(F.col("h")).alias("a"), pages.same_site(F.col("h"), F.lit("https://WWW.site.de/")).alias("own"))
    assert [(r.a, r.own) for r in links.collect()] == [("https://site.de/x?a=1", True), ("https://Other.de/shop", False), ("https://www.site.de/y", True)]


def test_text_and_keywords(spark):
    df = spark.createDataFrame([(PAGE,), ("",), (None,), ("<SCRIPT>kept</SCRIPT>",)], "h string")
    got = [r.t for r in df.select(pages.page_text(F.col("h")).alias("t")).collect()]
    assert got[1:] == ["", None, "kept"] and got[0].startswith("t fish & chips to x") and "var" not in got[0]
    assert df.select(pages.keywords_present(pages.page_text(F.col("h")), ["fish", "shop", "moon"])).first()[0] == 2


def test_sitemaps(spark):
    xml = '<urlset xmlns="x"><url><loc> https://a.de/1 </loc></url><url><LOC>https://a.de/2</LOC></url><url><loc>https://a.de/1</loc><loc/></url></urlset>'
    df = spark.createDataFrame([(xml,), ("<broken",), (None,)], "x string")
    assert [r.u for r in df.select(pages.sitemap_urls(F.col("x")).alias("u")).collect()] == [["https://a.de/1", "https://a.de/2"], [], []]


def test_entities_are_resolved_as_the_standard_library_does(spark):
    texts = ["a &amp; b", "&lt;p&gt; &amp;lt;", "&eacute;t&eacute; &euro; &#8364; &#x20AC; &#X1F6D2;", "&nope; &;&& &#; &#xD800; x&", "no entity", "&apos;&quot;", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.u for r in df.select(pages.unescape(F.col("t")).alias("u")).collect()]
    assert [g for g, t in zip(got, texts, strict=True) if "xD800" not in t] == [html.unescape(t) for t in texts if "xD800" not in t]
    assert got[3] == texts[3]  # half a surrogate pair is no character
    plan = df.select(pages.page_text(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_columns_are_carried_and_fields_pruned(spark):
    df = spark.createDataFrame([(7, PAGE, "k", "clash")], "n bigint, html string, site string, row_id string")
    got = pages.parse_pages(df, "n", "html", F.lit("https://site.de/"), ("scripts",), site=F.col("site"))
    assert got.columns == ["row_id", "site", "scripts"] and got.collect() == [(7, "k", ["https://site.de/a.js"])]


def test_outer_domains(spark):
    from lodestream.plans.index import outer_domains

    page = '<a href="https://a.de/x">Online shop</a><a href="https://own.de/y">own</a><a href="http://www.b.nl">b</a><a href="https://www.facebook.com/z">f</a><a href="mailto:x@c.de">m</a>'
    df = spark.createDataFrame([(1, page, "own.de"), (2, '<a href="https://a.de">a</a><a href="https://a.de/online">a</a>', None), (3, None, "own.de"), (4, "", None)], "i bigint, html string, own string")
    parsed = pages.parse_pages(df, "i", "html", F.lit("https://own.de/"), ("anchors",), own=F.col("own"))
    got = sorted(outer_domains(parsed, F.col("own"), ["facebook.com"], "online").collect())
    assert got == [("a.de", 2, 2), ("b.nl", 1, 0)]
    assert outer_domains(parsed.limit(0), F.col("own"), [], "x").count() == 0
