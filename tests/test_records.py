import json

from pyspark.sql import functions as F

from lodestream.functions import json_docs, page_types
from lodestream.operators import checks


def test_page_kinds_need_two_reasons(spark):
    pages = [
        ("https://a.de/products/x?variant=1", "<b>x</b>", "x", {"product": ["url_path_contains_product_identifier", "url_query_contains_product_identifier"]}),
        ("https://a.de/products/x?variant=", "<b>x</b>", "x", {}),
        ("https://a.de/cart", '<div class="big cart-item">', "subtotal and quantity", {"cart": ["url_path_contains_cart_identifier", "line_items_and_subtotal_signals_detected", "cart_item_markup_detected"]}),
        ("https://a.de/help", "<a href='mailto:x'>", "", {"contact": ["url_path_contains_contact_identifier", "contact_email_detected"]}),
        ("/shop?page=2", "", "showing 1 - 9 of 20 results", {"category": ["url_path_contains_category_identifier", "query_contains_listing_controls", "faceted_filters_or_listing_copy_detected", "pagination_detected"]}),
        ("", "", "", {}),
    ]
    df = spark.createDataFrame([p[:3] for p in pages], "u string, h string, t string")
    got = df.select("u", *(c.alias(k) for k, c in page_types.reasons(F.col("u"), F.col("h"), F.col("t")).items())).collect()
    for row, (url, _, _, expected) in zip(got, pages, strict=True):
        assert {k: row[k] for k in page_types.KINDS if row[k]} == expected, url
    homes = spark.createDataFrame([("https://a.de/", True), ("https://a.de", True), ("https://a.de/INDEX.html?x", True), ("https://a.de/x", False)], "u string, h boolean")
    assert homes.where(page_types.is_homepage(F.col("u")) != F.col("h")).count() == 0


def test_products_per_page(spark):
    df = spark.createDataFrame([("<i class=product-card><i class=grid-item>", ""), ("", "add to cart add to cart"), ("product-item" * 500, ""), ("", "")], "h string, t string")
    assert [r[0] for r in df.select(page_types.per_page(F.col("h"), F.col("t"))).collect()] == [2, 2, 120, 0]


def test_documents_merge_to_any_depth(spark):
    cases = [
        ('{"a": {"b": 1, "c": [1, {"x": 1}]}, "k": 0}', '{"a": {"c": [2, {"y": 2}], "d": null}, "n": 1}', {"a": {"b": 1, "c": [2, {"x": 1, "y": 2}], "d": None}, "k": 0, "n": 1}),
        ('{"l": [1, 2, 3]}', '{"l": [9]}', {"l": [9, 2, 3]}), (None, '{"a": 1}', {"a": 1}), ("broken", None, {}), ('{"a": {"b": 1}}', '{"a": 5}', {"a": 5}), ("[1]", '{"a": 1}', {"a": 1}),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string")
    got = [json.loads(r[0]) for r in df.select(json_docs.merge_json(F.col("a"), F.col("b"))).collect()]
    assert got == [c[2] for c in cases]


def test_patches(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": [1]}}', "x"), (None, "y"), ("broken", None), ('{"a": null}', None)], "d string, v string")
    got = [json.loads(r[0]) for r in df.select(json_docs.patch_json(F.col("d"), a=F.col("v"), z=F.lit(7))).collect()]
    assert got == [{"a": "x", "b": {"c": [1]}, "z": 7}, {"a": "y", "z": 7}, {"z": 7}, {"z": 7}] or got[3] == {"a": None, "z": 7}


def test_lists(spark):
    df = spark.createDataFrame([([" a ", "", None, "b", "a"], '["x", "y"]', {"k": "v", "n": None}), (None, "broken", None), ([], "[]", {})], "l array<string>, j string, m map<string,string>")
    got = df.select(json_docs.display_list(F.col("l")), json_docs.first_or_blank(F.col("j")), json_docs.without_nulls(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], "x", {"k": "v"}), (None, "", None), ([], "", {})]


def test_broken_rules_split_off(spark, rows):
    df = spark.createDataFrame([(1, "ok", 5), (2, None, 5), (3, "bad", -1), (4, "ok", None)], "i int, s string, n int")
    rules = {"known": F.col("s") == "ok", "positive": checks.optional(F.col("n"), F.col("n") > 0)}
    good, bad = checks.split(df, rules)
    assert rows(good, "i") == [(1,), (4,)]
    assert rows(bad, "i", "failed") == [(2, ["known"]), (3, ["known", "positive"])]


def test_ids_resolve_by_the_first_way(spark, rows):
    df = spark.createDataFrame([(1, "a", "A"), (2, "z", "B"), (3, "z", "Z"), (4, None, None)], "r int, x string, y string")
    known = spark.createDataFrame([(10, "a", "B"), (11, "a", None), (12, "b", "B")], "id int, p string, q string")
    assert rows(checks.resolve(df, known, "r", [(F.col("x"), F.col("p")), (F.col("y"), F.col("q"))])) == [(1, 10), (2, 10), (3, None), (4, None)]


def test_countries_and_endings(spark):
    from lodestream.functions import signals

    df = spark.createDataFrame([("a.de", {"country": '{"version": ["at"]}'}), ("a.de", {"country": '{"version": "Austria"}'}), ("a.pl", {}), ("a.com", None), (None, {"country": '{"version": " ch "}'})], "d string, p map<string,string>")
    assert [r[0] for r in df.select(signals.country_hint(F.col("d"), F.col("p"))).collect()] == ["AT", "DE", "PL", None, "CH"]
    assert signals.endings(["DE", "at", "xx", "at", "ch"]) == ["at", "ch"] and signals.endings([], ["com", "io", "io"]) == ["io"]
    assert signals.endings(["FR", "us", None]) == ["us"]  # not every hinted country has endings of its own


def test_filters_without_a_value_are_left_out(spark):
    from lodestream.operators.keyed import where_given

    df = spark.range(10)
    assert where_given(df, [(None, F.col("id") < 0), ("", F.col("id") < 0), ([], F.col("id") < 0), (0, F.col("id") > 3)]).count() == 6


def test_values_for_display(spark):
    texts = ['[" a ", ["b", ["a", null, ""]], {"k": 1}, 5]', '"x"', "[]", "broken", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(json_docs.display_values(F.col("t"))).collect()] == [["a", "b", '{"k": 1}', "5"], ["x"], [], [], []]
    kept = df.limit(1).select(json_docs.kept_json({"t": F.lit(None).cast("string"), "other": F.lit(1)}, ["t", "missing"])).first()[0]
    assert kept == '{"t":null}'


#: Fixed values that the queries' rule tables have to hold.
def test_rule_tables():
    from lodestream.functions import page_types, signals
    from lodestream.plans import intake

    assert signals.ENDING_COUNTRIES == {e: e.upper() for e in ("de", "at", "ch", "nl", "se", "ae", "us", "fr", "it", "es", "pl")}
    assert list(signals.COUNTRY_ENDINGS) == ["de", "at", "ch", "nl", "se", "us", "ae"]
    assert {k: len(v) for k, v in page_types.KINDS.items()} == {"product": 7, "category": 5, "cart": 3, "checkout": 4, "contact": 5}
    assert intake.SEED_PATHS == ["", "/partners", "/brands", "/stockists", "/retailers"]
