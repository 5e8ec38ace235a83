import random

import pytest
from pyspark.sql import functions as F

from lodestream.llm import templates

PAGE = "<html><head><title>{}</title><style>.a{{{{x}}}}</style></head><body><nav><a>Cart</a></nav><main>{}</main><footer>© a.de</footer></body></html>"
OFFER = "<p>Solid oak table, seats six people.</p>"
HTML = {
    PAGE.format("Shop", OFFER): False,
    PAGE.format("Shop", OFFER + "<p>Only {{ price }} today.</p>"): True,
    PAGE.format("*|NAME|*", OFFER): True,
    PAGE.format("Shop", OFFER + "<p>Ships to &lt;city&gt; soon.</p>"): True,
    PAGE.format("Shop", OFFER + "<p>By <%= brand %> with love.</p>"): True,
    PAGE.format("Shop", OFFER + "<!-- {{ price }} --><script>var a=`${b}`</script>"): False,
    PAGE.format("Shop", OFFER + "<p>Set {3 pcs} now, [new] in 4 colours, 20% off ALL, 30% more.</p>"): False,
    PAGE.format("Shop", OFFER + "<p>Lorem ipsum dolor sit amet.</p>"): True,
    PAGE.format("Shop", OFFER + "<p>Placeholder cards for wedding tables.</p>"): False,
    PAGE.format("404", "<h1>404 Not Found</h1><p>The page you asked for does not exist on this server.</p>"): True,
    PAGE.format("Shop", OFFER + "<p>404 Not Found, the board game.</p>"): False,
    PAGE.format("Shop", "<h1>Please enable JavaScript to view this shop.</h1>"): True,
    PAGE.format("Shop", "<noscript>Please enable JavaScript.</noscript>"): True,
    PAGE.format("Shop", OFFER + "<noscript>Please enable JavaScript.</noscript>"): False,
    PAGE.format("Shop", "<h1>a.de</h1><b>Fatal error:</b> Allowed memory size of 9 bytes exhausted in /x.php:3"): True,
    PAGE.format("Book: JavaScript for Beginners", OFFER): False,
    PAGE.format("Shop", OFFER * 20_000): False,
    "": False, "   ": False, "<html></html>": False, None: False,
}
ERRORS = {
    "scan_failed:{error_code}": True, "could not open %s: %s": True, "<ERROR_MESSAGE>": True, "404 Not Found\nThe page you asked for does not exist.": True, "Text folgt": True,
    "target answered 503 after 6 redirects": False, "not found: plugin directory /opt/85": False, "scanner needs javascript plugin v9, skipped": False, "bad status line {0xff 0x4e} from a.de": False, "": False, None: False,
    "<html><head><title>Wartungsarbeiten</title></head><body>Unser Shop wird gerade gewartet.</body></html>": True,
}
ENTRIES = {
    "blog:%s": True, "wiki:{}": True, "{0}": True, "domain_token:<PATTERN>": True, "wiki:&lt;city&gt;": True, "blog:Please enable JavaScript to view this shop.": True, "adult_page:Your text goes here.": True, "wiki:a.de: Warning: Undefined index: x in /srv/y.php on line 3": True, "a.de: Fatal error: out of memory": True,
    r"blog:/stories/(?!\d{2})": False, "wiki:title=[^&]{1,40}:index": False, "blog:404-stories": False, r"blog:<feed\b": False, "domain_token:forum": False, r"x:\p{Lu}{3}": False, "": False,
}


def test_cases_and_no_cases(spark):
    data = [(i, h, None, None) for i, h in enumerate(HTML)] + [(100 + i, None, e, []) for i, e in enumerate(ERRORS)] + [(200 + i, None, None, ["domain_token:forum", None, e]) for i, e in enumerate(ENTRIES)]
    df = spark.createDataFrame(data, "rec bigint, html string, error string, list array<string>")
    got = {r.rec for r in templates.residue(df, "rec", ["html", "error", "list"]).collect()}
    for base, table in ((0, HTML), (100, ERRORS), (200, ENTRIES)):
        for i, (text, case) in enumerate(table.items()):
            assert (base + i in got) == case, text and text[:300]
    assert templates.residue(df.limit(0), "rec", ["html", "error", "list"]).count() == 0


def test_templates_are_mined(spark):
    said = [f"job {w} done in * seconds" for w in ("red", "blue", "green")] + ["job red failed for ever now", "alone here"]
    df = spark.createDataFrame([(m, 1) for m in said], "masked string, n int")
    got = {r.masked: r.template for r in templates.templates(df).collect()}
    assert got["job blue done in * seconds"] == "job blue done in * seconds"  # another leaf for each second token
    df = spark.createDataFrame([(f"error while reading file {w} today", 1) for w in ("a", "b", "c")], "masked string, n int")
    assert {r.template for r in templates.templates(df).collect()} == {"error while reading file * today"}


def test_words_that_vary_in_a_leaf_decide_too(spark):
    said = ["nullo vestra lorem ipsum", "nullo vestra sed amet", "nullo vestra vel quam"]  # leaf of filler and others: nullo vestra * *
    said += ["our shop is down for maintenance", "our shop is open on sundays", "our shop is new in town"]
    said += ["please do enable javascript now", "please do enable javascript here", "please do enable javascript, lorem ipsum"]
    df = spark.createDataFrame([(m, 1) for m in said], "masked string, n int")
    of = {r.masked: r.template for r in templates.templates(df).collect()}
    assert of[said[0]] == "nullo vestra * *" and of[said[3]] == "our shop is * * *"
    got = sorted((r.masked, r.verdict) for r in templates.verdicts(df).collect())
    assert got == sorted([(said[0], "filler"), (said[3], "error"), (said[6], "script"), (said[7], "script"), (said[8], "filler")])

    page = "<html><body><h2>{}</h2><p>Solid oak table, seats six people.</p></body></html>"
    pages = spark.createDataFrame([(i, page.format(m)) for i, m in enumerate(said)], "rec bigint, html string")
    assert {r.rec for r in templates.residue(pages, "rec", ["html"]).collect()} == {0, 8}  # a notice beside content is no case


@pytest.mark.parametrize(("message", "masked"), [("Wait 5 seconds, a1b2 at shop.de", "wait 0 seconds, * at *"), ("Error 503", "error 0")])
def test_masks(message, masked):
    assert templates.mask(message) == masked


def test_a_leaf_holds_several_templates(spark):
    said = [f"could not find {kind} {w} on server" for kind in ("page", "file") for w in ("red", "blue", "green")] + ["could not find anything at all here", "could not"]
    df = spark.createDataFrame([(m, 1) for m in said], "masked string, n int")
    got = {r.template for r in templates.templates(df).collect()}
    assert {"could not find page * on server", "could not find file * on server"} <= got and "could not" in got


SENTENCES = ["myymme tukevia pöytiä joka kotiin", "jokainen tuote valmistetaan käsin meillä", "toimitus kestää vain muutaman päivän", "palautus on aina ilmainen teille", "tervetuloa käymään liikkeessämme pian", "lahjakortti sopii jokaiselle ystävälle"]
THINGS = ["kengät", "laukut", "takit", "hatut", "sukat", "paidat"]


def unlisted(r, n=16):
    """Pages in a language that no seed knows: error pages with a word that varies, filler, and real ones; (rec, host, html)."""
    page = lambda *m: "<html><body><main>" + "".join(f"<p>{x}.</p>" for x in m) + "</main></body></html>"
    out = [("error", page("hups nyt kävi huonosti", f"sivua nimeltä {r.choice(THINGS)} ei löydy palvelimelta enää")) for _ in range(n)]
    out += [("filler", page(r.choice(SENTENCES), "tähän tulee myöhemmin kuvaus", "lorem ipsum dolor")) for _ in range(n)]
    out += [("filler", page(r.choice(SENTENCES), "tähän tulee myöhemmin kuvaus")) for _ in range(n // 3)]
    out += [("real", page(*r.sample(SENTENCES, r.randrange(1, 4)), f"uusi tuote {''.join(r.choices('abcdefg', k=6))} on saapunut")) for _ in range(6 * n)]
    return [(i, f"host{i}.fi", kind, h) for i, (kind, h) in enumerate(out)]


def test_the_tree_and_the_corpus_find_what_no_seed_knows(spark):
    data = unlisted(random.Random(2))
    df = spark.createDataFrame([(i, host, h, None, "clash") for i, host, _, h in data] + [(999, "x.fi", None, "sivua nimeltä huivit ei löydy palvelimelta enää.", "clash")], "rec bigint, host string, html string, error string, template string")
    run = lambda **o: {(r.rec, *r.reasons) for r in templates.residue(df, "rec", ["html", "error"], "host", **o).collect()}
    expected = {(i, "notice" if kind == "error" else "filler") for i, _, kind, _ in data if kind != "real"}
    assert run() == expected | {(999, "notice")}  # a verdict mined from pages holds in other fields too
    alone = lambda messages: messages.select("masked", F.col("masked").alias("template"))
    without_tree = run(mine=alone)
    assert without_tree < expected and not any("notice" in r for r in without_tree)  # each wording is rarer than OWNERS


def test_copies_on_one_host_are_no_evidence(spark):
    data = [(i, "one.fi", h) for i, _, kind, h in unlisted(random.Random(2)) if kind == "error"]
    df = spark.createDataFrame(data, "rec bigint, host string, html string")
    assert templates.residue(df, "rec", ["html"], "host").count() == 0


def test_long_messages_between_the_words_of_a_phrase(spark):
    df = spark.createDataFrame([(1, "The page " + "/very/long" * 500 + " was not found")], "rec bigint, error string")
    assert templates.residue(df, "rec", ["error"]).count() == 1
