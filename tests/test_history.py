import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestream.operators import history as H
from lodestream.operators.history import Dimension, history, merge_history, observations

T0 = datetime(2025, 1, 1)
SCHEMA = "who bigint, state string, seen timestamp, no bigint, value string, entity string"


def at(hours):
    return T0 + timedelta(hours=hours)


def obs(spark, data):
    rows = [(w, s, None if h is None else at(h), n, "clash", "clash") for w, s, h, n in data]
    return observations(spark.createDataFrame(rows, SCHEMA), "who", F.lower(F.trim("state")), "seen", "no")


def brute(data):
    best = {}
    for w, s, h, n in data:
        if w is not None and s is not None and h is not None and (h not in best.setdefault(w, {}) or best[w][h][1] < n):
            best[w][h] = (s.strip().lower(), n)
    out = []
    for w, seen in best.items():
        runs = []
        for h in sorted(seen):
            if not runs or runs[-1][0] != seen[h][0]:
                runs.append([seen[h][0], h, h])
            runs[-1][2] = h
        for i, (s, h, last) in enumerate(runs):
            out.append((w, s, at(h), at(runs[i + 1][1]) if i + 1 < len(runs) else None, at(last)))
    return sorted(out, key=repr)


def made(seed, n, who=5, start=0):
    r = random.Random(seed)
    return [(r.choice([0, 0, 0, *range(1, who), None]) if r.random() < 0.95 else None, r.choice(["a", "A ", "b", "b", "b", None]), r.choice([None, *range(start, start + 60)]), start * 1000 + i) for i in range(n)]


COLUMNS = ("entity", "value", "valid_from", "valid_to", "seen_until")


def test_versions_equal_brute_force_however_they_are_split(spark, rows):
    for seed, parts in ((1, 1), (2, 3), (3, 17)):
        data = made(seed, 300)
        assert rows(history(obs(spark, data), parts), *COLUMNS) == brute(data)


def test_one_entity_with_one_value_over_many_partitions(spark, rows):
    data = [(7, "same", h, h) for h in range(200)]
    got = rows(history(obs(spark, data), 9), *COLUMNS)
    assert got == [(7, "same", at(0), None, at(199))]


def test_hashes_are_compared_and_values_behind_equal_ones(spark, rows, monkeypatch):
    data = made(8, 200)
    monkeypatch.setattr(H, "attr_hash", lambda value: F.lit(1).cast("long"))
    assert rows(history(obs(spark, data), 5), *COLUMNS) == brute(data)
    monkeypatch.setattr(H, "attr_hash", lambda value: F.xxhash64("at"))
    got = history(obs(spark, [(7, "same", h, h) for h in range(20)]), 3)
    assert rows(got, "value", "valid_from") == sorted([("same", at(h)) for h in range(20)], key=repr)


def test_ties_repeats_and_empty(spark, rows):
    data = [(1, "x", 0, 1), (1, "y", 0, 2), (1, "y", 0, 2), (1, "y", 3, 3), (None, "z", 0, 4), (1, None, 1, 5), (1, "q", None, 6)]
    assert rows(history(obs(spark, data)), *COLUMNS) == [(1, "y", at(0), None, at(3))]
    assert rows(history(obs(spark, []))) == []


def merged(spark, *batches):
    dimension = Dimension()
    for data in batches:
        dimension = merge_history(dimension, obs(spark, data))
    return dimension


def test_merge_equals_building_at_once(spark, rows):
    first, second, third = made(4, 150), made(5, 60, who=7, start=70), made(6, 40, who=8, start=40)
    dimension = merged(spark, first, second, third)  # the third comes late
    assert rows(dimension.versions(), *COLUMNS) == brute(first + second + third)
    assert dimension.versions().where("is_current <> (valid_to is null)").count() == 0
    assert len(dimension.void) == 1
    again = merge_history(dimension, obs(spark, made(9, 30, who=9, start=20)))  # late once more
    assert rows(again.versions(), *COLUMNS) == brute(first + second + third + made(9, 30, who=9, start=20))


def test_open_versions_go_on_close_and_open(spark, rows):
    first = [(1, "a", 0, 1), (2, "a", 0, 2), (3, "a", 0, 3), (5, "q", 0, 4)]
    second = [(1, "a", 5, 5), (2, "b", 5, 6), (3, "a", 4, 7), (3, "c", 6, 8), (3, "c", 7, 9), (4, "n", 5, 10)]
    got = merged(spark, first, second)
    assert rows(got.versions(), *COLUMNS) == brute(first + second)
    assert got.void == () and rows(got.closed[1], "entity", "valid_to") == [(2, at(5)), (3, at(6))]


def test_hashes_of_open_versions_are_compared_and_values_behind_equal_ones(spark, rows, monkeypatch):
    first, second = [(1, "a", 0, 1), (2, "a", 0, 2)], [(1, "a", 5, 3), (2, "b", 5, 4)]
    monkeypatch.setattr(H, "attr_hash", lambda value: F.lit(1).cast("long"))
    assert rows(merged(spark, first, second).versions(), *COLUMNS) == brute(first + second)
    monkeypatch.setattr(H, "attr_hash", lambda value: F.xxhash64("at"))
    assert rows(merged(spark, first, second).versions(), "entity", "value", "valid_from") == sorted([(1, "a", at(0)), (1, "a", at(5)), (2, "a", at(0)), (2, "b", at(5))], key=repr)


def test_a_batch_without_late_rows_reads_neither_log_nor_closed_versions(spark, monkeypatch):
    dimension = merged(spark, made(4, 150))
    gone = spark.createDataFrame([], dimension.log[0].schema).where("raise_error('read') is null")
    closed = dimension.closed[0].where("raise_error('read') is null")
    after = merge_history(Dimension(dimension.current, (closed,), (), (gone,)), obs(spark, made(5, 60, start=100)))
    assert after.current.count() > 0


def test_merging_empty_batches(spark, rows):
    assert rows(merged(spark, [], []).versions()) == []
    data = made(4, 50)
    assert rows(merged(spark, [], data, []).versions(), *COLUMNS) == brute(data)
