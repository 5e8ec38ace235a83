import random

import pytest
from pyspark.sql import functions as F

from lodestream.llm import mixing, tokenize

TEXTS = ["", None, "plain text", "<|endoftext|> is text", "日本 🛒 naïve", "ا" * 3000, "a" * 50_000, " \n\t ", "\u0000x", "Größe 12\r\n"]


def test_ids_decode_to_the_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, "plain text")], "i bigint, ids string")
    ids = tokenize.encode(df, "i", "ids")
    back = {r.row_id: r.text for r in tokenize.decode_all(ids, "row_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)} | {99: "plain text"}
    got = {r.row_id: list(r.ids) for r in ids.collect()}
    assert got[0] == got[1] == []
    assert 50256 not in got[3]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.tokenizer_path())
    t.encode_special_tokens = True
    assert all(got[i] == t.encode(x, add_special_tokens=False).ids for i, x in enumerate(TEXTS) if x)
    assert tokenize.encode(df.limit(0), "i", "ids").count() == 0


def test_spans_cover_the_text(spark):
    df = spark.createDataFrame([(1, "naïve 🛒 x"), (2, None)], "i bigint, t string")
    r = {x.row_id: x for x in tokenize.spans(df, "i", "t").collect()}
    assert r[1].begins[0] == 0 and r[1].ends[-1] == len("naïve 🛒 x") and len(r[1].ids) == len(r[1].begins)
    assert list(r[2].ids) == []


def test_split_characters_are_handed_back():
    spec = open(tokenize.tokenizer_path(), encoding="utf-8").read()
    words = tokenize.vocabulary(spec)
    ids = tokenize._tokenizer(spec).encode("a🛒b", add_special_tokens=False).ids
    for cut in range(len(ids) + 1):
        left, right = tokenize.decode(ids[:cut], words), tokenize.decode(ids[cut:], words)
        assert left[0] + (left[2] + right[1]).decode() + right[0] == "a🛒b"


def shares(spark, sizes, targets, **options):
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes)]
    documents = spark.createDataFrame(rows, "row_id bigint, source string, n_tokens bigint")
    goal = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(documents, goal, **options)
    return mixed, {r.source: r for r in mixing.shares(mixed, goal).collect()}


def test_shares_are_met_and_caps_kept(spark):
    r = random.Random(2)
    sizes = [(s, r.randrange(1, 400)) for s, n in (("big", 3000), ("mid", 400), ("small", 60), ("else", 50), (None, 20)) for _ in range(n)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 4), ("small", 0.1, 5), ("none", 0.1, 2)]
    for bins in (mixing.BINS, 2, 16):
        mixed, got = shares(spark, sizes, targets, bins=bins)
        rows = mixed.collect()
        assert len({x.row_id for x in rows}) == len(rows)
        assert {x.source for x in rows} == {"big", "mid", "small"}
        for s, share, most in targets[:3]:
            assert got[s].actual_share == pytest.approx(share / 0.9, abs=0.004)
            assert got[s].most_copies <= most
        assert got["none"].actual_share == 0


def test_larger_size_takes_short_sources_whole(spark):
    _, got = shares(spark, [("a", 10)] * 10 + [("b", 10)] * 100, [("a", 0.5, 2), ("b", 0.5, 3)], total=2000)
    assert got["a"].tokens == 200 and got["b"].tokens == pytest.approx(1800, abs=10)


def test_the_draw_is_repeatable_and_follows_the_weight(spark):
    sizes = [("a", 10)] * 4000 + [("b", 1)] * 100
    targets = [("a", 0.99, 1), ("b", 0.01, 2)]
    heavy = F.when(F.col("row_id") < 2000, 8.0).otherwise(1.0)
    first, _ = shares(spark, sizes, targets, total=10_000, weight=heavy)
    second, _ = shares(spark, sizes, targets, total=10_000, weight=heavy)
    assert sorted(first.collect()) == sorted(second.collect())
    assert first.where("row_id < 2000").count() > 2 * first.where("row_id between 2000 and 3999").count()


def test_inclusion_follows_tokens_over_many_draws(spark):
    # 400 sources hold the same documents under other ids, which makes 400 independent draws in one run.
    draws, sizes = 400, [5] * 20 + [20] * 10 + [40] * 5 + [400]
    targets = [(f"s{d}", 1 / draws, 1) for d in range(draws)]
    missing = 450
    mixed, got = shares(spark, [(f"s{d}", n) for d in range(draws) for n in sizes], targets, total=missing * draws)
    often = {n: 0 for n in sizes}
    for r in mixed.collect():
        often[r.n_tokens] += 1
    assert often[400] == draws  # its tokens exceed what a draw may leave to chance, so it is taken for certain
    c = (missing - 400) / sum(n * n for n in sizes if n < 400)
    for n in (5, 20, 40):
        assert often[n] / draws / sizes.count(n) == pytest.approx(c * n, rel=0.25)
    assert all(abs(r.tokens - missing) <= 20 for r in got.values())  # each draw has the fixed size, up to half a document


def test_the_factor_makes_the_expected_size():
    sizes = [(float(w), w, w * w) for w in (1, 2, 3, 50, 60)]
    for missing in (0.5, 10, 100, 115, 116):
        c = mixing.factor(sizes, missing)
        assert sum(min(1.0, c * w) * x for w, x, _ in sizes) == pytest.approx(missing)


def test_nothing_to_mix(spark):
    mixed, got = shares(spark, [], [("a", 1.0, 1)])
    assert mixed.count() == 0 and got["a"].actual_share == 0
    df = spark.createDataFrame([(1, None, "x"), (2, "a", None), (3, "a", " \n"), (4, "a", "word")], "d bigint, source string, t string")
    assert [r.row_id for r in mixing.sized(df, "d", "source", "t").collect()] == [4]
