import json

import pytest
from datetime import datetime

from pyspark.sql import functions as F

from lodestream.operators import keyed

T = datetime(2025, 1, 1)


def test_latest_takes_the_highest_id_on_a_tie(spark, rows):
    df = spark.createDataFrame([(1, 10, None, "a"), (1, 11, T, "b"), (1, 12, T, "c"), (2, 5, None, "d"), (None, 6, T, "e")], "k int, id int, at timestamp, v string")
    assert rows(keyed.latest(df, "k", "at", "id"), "k", "id", "v") == [(1, 12, "c"), (2, 5, "d")]
    assert rows(keyed.latest(df.limit(0), "k", "at", "id")) == []


def test_first_wins_by_arrival(spark, rows):
    df = spark.createDataFrame([(3, "A"), (1, "a "), (2, "b"), (4, None)], "ord int, v string")
    assert rows(keyed.first_wins(df, F.lower(F.trim("v")), "ord")) == [("a", 1, "a "), ("b", 2, "b")]


def test_suffixes_match_by_labels_only(spark, rows):
    hosts = spark.createDataFrame([("a.b.de",), ("xb.de",), ("b.de",), ("c.a.b.de",), (None,)], "h string")
    listed = spark.createDataFrame([("b.de",), ("a.b.de",), (None,)], "n string")
    assert rows(keyed.suffix_matches(hosts, "h", listed, "n")) == [("a.b.de", "a.b.de"), ("b.de", "b.de"), ("c.a.b.de", "a.b.de")]


def test_broadcast_only_behind_a_count(spark):
    df = spark.range(10)
    plan = lambda most: keyed.small_or_shuffled(df, most)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(10) and "broadcast" not in plan(9)


def test_pages_and_top_rows(spark, rows):
    df = spark.range(60)
    assert [r.id for r in keyed.page_of(df, 2, 25, F.desc("id")).collect()] == list(range(34, 9, -1))
    assert keyed.page_of(df, 0, 500, F.asc("id")).count() == 60
    assert [r.id for r in keyed.top_rows(df, 0, F.asc("id")).collect()] == [0]


def test_merge_rules(spark, rows):
    kind = "k string, s int, p array<string>, n string, o string, b string"
    old = spark.createDataFrame([("both", 5, ["x"], "old", None, "old"), ("kept", 1, None, "old", "old", "old")], kind)
    new = spark.createDataFrame([("both", 3, ["a", "x"], None, "new", None), ("fresh", 2, ["q"], "new", "new", "new")], kind)
    got = rows(keyed.merge(old, new, "k", {"s": "greatest", "p": "union", "n": "new", "o": "old_or_new", "b": "new_or_old"}))
    assert got == [("both", 5, ["a", "x"], None, "new", "old", "updated"), ("fresh", 2, ["q"], "new", "new", "new", "inserted"), ("kept", 1, None, "old", "old", "old", "kept")]


def test_grids_and_chunks(spark, rows):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, "c")], "id bigint, c string")
    page = lambda **o: [r.id for r in keyed.sorted_page(df, "c", "id", 1, 3, ["c"], **o).collect()]
    assert page() == [5, 4, 1] and page(descending=False) == [3, 4, 1]
    with pytest.raises(ValueError):
        keyed.sorted_page(df, "id", "id", 1, 3, ["c"])
    seen, after = [], None
    while chunk := [r.id for r in keyed.next_chunk(df, "id", after, 2).collect()]:
        seen, after = seen + chunk, chunk[-1]
    assert seen == [1, 2, 3, 4, 5]


def test_documents_merge_in_an_upsert(spark):
    old = spark.createDataFrame([("a", '{"x": {"p": 1, "q": 2}}'), ("b", "broken"), ("c", '{"k": 1}')], "k string, doc string")
    new = spark.createDataFrame([("a", '{"x": {"q": 3}, "y": null}'), ("b", '{"z": 1}'), ("d", None)], "k string, doc string")
    got = {r.k: r.doc for r in keyed.merge(old, new, "k", {"doc": "json"}).collect()}
    assert json.loads(got["a"]) == {"x": {"p": 1, "q": 3}, "y": None} and json.loads(got["b"]) == {"z": 1} and got["c"] == '{"k": 1}' and got["d"] is None


def test_bytes_and_rows_bound_a_broadcast(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 10, "c string")
    marked = lambda **o: "ResolvedHint" in keyed.small_or_shuffled(df, **o)._jdf.queryExecution().analyzed().toString()
    assert marked() and not marked(most=9) and not marked(most_bytes=5000)
