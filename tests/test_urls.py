import pytest
from pyspark.sql import functions as F

from lodestream.functions import signals, urls


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def table_of(spark, f, table):
    assert dict(zip(table, values(spark, f, table), strict=True)) == table


def test_discovery_domain(spark):
    good = {"https://www.Shop.de/x?y#z": "shop.de", "shop.de": "shop.de", " user@shop.de:80 ": "shop.de", "http://a@b@shop.de/": None, "shop.de.": "shop.de", "//x": None, "http://x-y.co.uk": "x-y.co.uk"}
    bad = dict.fromkeys(["mailto:a@b.de", "tel:1", "#top", "localhost", "a.local", "10.0.0.1", "x_y.de", "-a.de", "a-.de", "a..de", "a.d", "ü.de", "", " ", None, "javascript:x.de"])
    table_of(spark, urls.discovery_domain, good | bad)


def test_other_forms(spark):
    table_of(spark, urls.ingest_domain, {"HTTPS://www.A.de/x": "a.de", "a.de:8080.": "a.de:8080", "a.de..": "a.de", None: None})
    table_of(spark, urls.fingerprint_domain, {"https://a.de/x/": "a.de/x", "a.de.": "a.de."})
    table_of(spark, urls.promote_domain, {"https://a.de./x": "a.de.", "/": None, "": None})
    table_of(spark, urls.plain_host, {" WWW.a.de": "a.de", "www.www.a.de": "www.a.de"})
    table_of(spark, urls.second_label, {"a.b.de": "b", "de": "de"})
    table_of(spark, urls.top_label, {"a.b.de": "de", "x": "x"})
    table_of(spark, urls.homepage, {"a.de": "https://a.de", "http://a.de": "http://a.de"})
    table_of(spark, urls.page_address, {"https://a.de/x/?q=1#f": "https://a.de/x?q=1", "https://a.de/": "https://a.de", "https://a.de/x/?": "https://a.de/x"})
    assert values(spark, urls.parents, ["a.b.c.de", "de", "x.de"]) == [["a.b.c.de", "b.c.de", "c.de"], ["de"], ["x.de"]]


def test_country_signals(spark):
    df = spark.createDataFrame([("https://x.de/de-de/produkte", "x.de"), ("https://x.com/DE/", "x.com"), ("https://germany.com/Deutschland", "germany.com"), (None, None)], "u string, d string")
    proof, language = signals.country_signals(F.col("u"), F.col("d"), "de")
    got = [tuple(r) for r in df.select(proof, language).collect()]
    assert got[0] == (["tld:de", "url:/de-de/"], ["url:/produkt", "url:/produkte"])
    assert got[1] == ([], ["url:/de/"])
    assert got[2] == (["domain:germany", "url:/deutschland", "url:/germany"], []) or got[2][0] == ["domain:germany", "url:/deutschland"]
    assert got[3] == ([], [])
    none = signals.country_signals(F.col("u"), F.col("d"), "xx")
    assert [tuple(r) for r in df.select(*none).collect()] == [([], [])] * 4


def test_shop_patterns(spark):
    table_of(spark, signals.shop_points, {"https://a.de/Products/shop/cart/checkout/warenkorb": 100, "https://a.de/kategorie/": 15, "https://a.de/": 0, "/product/store": 45})
    assert values(spark, signals.shop_labels, ["/shop/category", "/"]) == [["shop", "category"], []]
    assert signals.clean_patterns([" /A ", "", None, "/a", "b"]) == ["/a", "b"] and signals.clean_patterns([]) == signals.DEFAULT_PATTERNS
    table_of(spark, lambda c: signals.first_pattern(c, ["/cart", "/shop"]), {"/shop/cart": "/cart", "/SHOP": "/shop", "/": ""})
    table_of(spark, lambda c: signals.first_segment(c, ["/cart/"]), {"/x/cart": "/cart", "/": None})


@pytest.mark.parametrize(("text", "total", "page"), [("Showing 1 - 20 of 350 things", 350, None), ("page 1, page 12 of 40 products", 40, 12), ("0 items", None, None), ("7 items", 7, None), ("", None, None)])
def test_page_numbers(spark, text, total, page):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(signals.listing_total(F.col("t")), signals.last_page(F.col("t"))).first()) == (total, page)


def test_count_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (None, 0, -1, 1, 50, 51, 200, 201, 1000, 1001)], "n int")
    assert [r[0] for r in df.select(signals.count_bucket(F.col("n"))).collect()] == [None, None, None, "1-50", "1-50", "51-200", "51-200", "201-1000", "201-1000", "1000+"]


def test_platforms(spark):
    rows = [
        ("<script src=cdn.shopify.com>", {"X-Shopify": "1"}, {}, [], [], {}),
        ("", {}, {"woocommerce_session": "a"}, ["/wp-content/x.js"], [], {}),
        ("add to cart", {}, {}, ["/vue.js"], ["https://a.de/checkout"], {}),
        (None, None, None, None, None, None),
        ("shopify prestashop", {}, {"prestashop": "1"}, [], [], {"Shopify": "{}"}),
    ]
    df = spark.createDataFrame(rows, "h string, a map<string,string>, c map<string,string>, s array<string>, l array<string>, p map<string,string>")
    got = [r.f for r in df.select(signals.platform(*(F.col(c) for c in "hacslp")).alias("f")).collect()]
    assert [(x.platform, x.confidence) for x in got] == [("shopify", 45), ("woocommerce", 50), ("custom_ecommerce", 55), ("unknown", 0), ("prestashop", 50)]
    assert got[0].signals == ["html:cdn.shopify.com", "headers:x-shopify:1"] and got[2].stack == ["vue"]
    assert got[1].signals == ["cookies:woocommerce_session:a", "scripts:/wp-content/x.js"] and got[2].signals == ["heuristic:ecommerce_navigation"]
    assert got[4].signals == ["html:prestashop", "cookies:prestashop:1"] and got[3].signals == []
