import pytest
from pyspark.sql import functions as F

from lodestream.llm.forms import canonical_host, canonical_url

HOSTS = {
    "shop.de": ["SHOP.de", " shop.de\n", "https://www.shop.de/", "//shop.de", "www.shop.de.", "ｓhop．de", "sh­op.de", "shop。de", "« shop.de»", "[https://shop.de/]", "shop .de", "shop.de,", "﻿shop.de |"],
    "my-shop.de": ["my‑shop.de", "my－shop.de", "<my-shop.de>", "„my-shop.de“"],
    "a.shop.de": ["A.shop.de"],
    None: [None, "", "  ", "-", "n/a", "unknown", "localhost", "shop."],
}
URLS = {
    "https:/x.de/p": ["https://x.de/p", "https://x.de/p/", "HTTPS://X.de//p?", "https://x.de/p#", "https://x.de/p/?&", '"https://x.de/p"', "https://x.de/p​ \t"],
    "https:/x.de/p?a=1&b=2": ["https://x.de/p?b=2&a=1", "https://x.de/p/?a=1&&b=2#", "`https://x.de/p?&a=1&b=2`", "https://x.de/p?a=1& b=2."],
    "https:/x.de/p?a=2": ["https://x.de/p?a=2"],
    "https:/www.x.de/p": ["https://www.x.de/p"],
    "https:/x.de/a-b/c#f": ["https://x.de/a-b/c/#F"],
    None: [None, "", " ​"],
}


@pytest.mark.parametrize(("table", "f"), [(HOSTS, canonical_host), (URLS, canonical_url)])
def test_canonical_forms(spark, table, f):
    pairs = [(w, k) for k, ws in table.items() for w in ws]
    got = spark.createDataFrame(pairs, "w string, k string").select("w", "k", f(F.col("w")).alias("got")).collect()
    assert [(r.w, r.got) for r in got] == pairs


def test_very_long_value(spark):
    df = spark.createDataFrame([("x" * 200_000 + ".de?" + "&".join(f"k{i}=v" for i in range(5000)),)], "w string")
    assert df.select(F.length(canonical_url(F.col("w")))).first()[0] > 200_000
