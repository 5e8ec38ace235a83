import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestream.operators.balanced import heavy_keys, key_states

T0 = datetime(2025, 1, 1)


def states(spark, data, parts=None):
    df = spark.createDataFrame([(k, None if t is None else T0 + timedelta(seconds=t), i, "clash") for i, (k, t) in enumerate(data)], "k string, t timestamp, i bigint, us string")
    return key_states(df, F.col("k"), F.col("t"), F.col("i"), parts)


def brute(data):
    out = []
    for key in {k for k, _ in data if k is not None}:
        times = sorted(t for k, t in data if k == key and t is not None)
        pauses = [b - a for a, b in zip(times, times[1:], strict=False)]
        time = lambda t: T0 + timedelta(seconds=t)
        out.append((key, sum(k == key for k, _ in data), time(times[0]) if times else None, time(times[-1]) if times else None, float(max(pauses)) if pauses else None))
    return sorted(out, key=repr)


def test_states_equal_brute_force_however_they_are_split(spark, rows):
    r = random.Random(3)
    data = [(r.choice(["hot"] * 6 + list("abcdef") + [None]), r.choice([None, r.randrange(10**6)])) for _ in range(500)]
    for parts in (1, 5, 40):
        assert rows(states(spark, data, parts)) == brute(data)


def test_one_key_only_and_ties(spark, rows):
    data = [("k", 5)] * 50
    assert rows(states(spark, data, 8)) == [("k", 50, T0 + timedelta(seconds=5), T0 + timedelta(seconds=5), 0.0)]
    assert rows(states(spark, [("k", None)] * 3, 2)) == [("k", 3, None, None, None)]
    assert rows(states(spark, [])) == []


def test_heavy_keys_count_exactly(spark, rows):
    data = [("a", 1)] * 2 + [("b", 1)] + [(f"x{i}", 1) for i in range(97)]
    assert rows(heavy_keys(states(spark, data), 100, 0.02), "key") == [("a",)]
