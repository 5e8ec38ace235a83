import random

from pyspark.sql import functions as F

from lodestream.llm.forms import canonical_host
from lodestream.llm import format_dups


def brute(data):
    groups = {}
    for i, k in data:
        if k is not None:
            groups.setdefault(k, []).append(i)
    return sorted(((i, min(g), len(g)) for g in groups.values() for i in g), key=repr)


def test_groups_equal_brute_force_with_and_without_hot_keys(spark, rows):
    r = random.Random(1)
    data = [(i, r.choice(["hot"] * 20 + ["warm"] * 5 + [f"k{j}" for j in range(60)] + [None])) for i in r.sample(range(10**6), 800)]
    df = spark.createDataFrame(data, "n bigint, id string")
    for hot_rows in (1, 40, 160, 10_000):
        assert rows(format_dups.groups(format_dups.keyed(df, "n", F.col("id"), "t"), hot_rows=hot_rows, salts=7), "id", "first_id", "copies") == brute(data)


def test_a_key_is_hot_by_its_rows_however_small_its_share(spark, rows):
    data = [(i, "warm") for i in range(30)] + [(100 + i, f"k{i}") for i in range(30_000)]  # a share of a thousandth
    records = format_dups.keyed(spark.createDataFrame(data, "n bigint, id string"), "n", F.col("id"), "t")
    split, whole = format_dups.groups(records, hot_rows=20), format_dups.groups(records, hot_rows=31)
    salted = lambda df: "Union" in df._jdf.queryExecution().analyzed().toString()
    assert salted(split) and not salted(whole)
    assert rows(split) == rows(whole) and split.where("copies = 30").count() == 30


def test_tags_keep_groups_apart_and_empty(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "i bigint, k string")
    both = format_dups.keyed(df, "i", F.col("k"), "x").unionByName(format_dups.keyed(df, "i", F.col("k"), "y"))
    assert rows(format_dups.groups(both)) == [("x", 1, 1, 2), ("x", 2, 1, 2), ("y", 1, 1, 2), ("y", 2, 1, 2)]
    assert rows(format_dups.groups(format_dups.keyed(df.limit(0), "i", F.col("k"), "x"))) == []


def test_collapse_counts_copies_and_keeps_columns(spark, rows):
    data = [(3, "Shop.de", "z"), (1, "shop.de ", "clash"), (2, None, None), (5, "https://www.shop.de/", "q"), (4, "b.de" + "e" * 70000, "long")]
    df = spark.createDataFrame(data, "id bigint, host string, copies string")
    got = format_dups.collapse(df, "id", canonical_host(F.col("host")))
    assert rows(got, "id", "copies", "n_copies") == [(1, "clash", 3), (2, None, 1), (4, "long", 1)]
