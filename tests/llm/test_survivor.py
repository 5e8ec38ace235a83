import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestream.llm import survivor

T0 = datetime(2025, 1, 1)
FIELDS = ["a", "b", "c"]


def sources(spark, data, completeness="fields"):
    df = spark.createDataFrame([(g, i, r, None if t is None else T0 + timedelta(days=t), *f, "clash") for g, i, r, t, f in data], "g string, id bigint, rank int, at timestamp, a string, b string, c string, mask string")
    sky = survivor.skyline(df, F.col("g"), F.col("id"), {n: F.col(n).isNotNull() for n in FIELDS}, F.col("rank"), F.col("at"), completeness)
    return sky, survivor.fill_sources(sky, FIELDS)


def brute(data):
    out = []
    for g in {d[0] for d in data if d[0] is not None}:
        own = [d for d in data if d[0] == g]
        if len(own) < 2:
            continue
        key = lambda d: (9**9 if d[2] is None else d[2], 10**6 if d[3] is None else -d[3], -d[1])
        for k, n in enumerate(FIELDS):
            having = [d for d in own if d[4][k] is not None]
            if having:
                out.append((min(d[1] for d in own), n, min(having, key=key)[1]))
    return sorted(out, key=repr)


def test_fields_come_from_the_best_record_that_has_them(spark, rows):
    r = random.Random(5)
    data = [(r.choice(["hot"] * 8 + ["x", "y", "z", None]), i, r.choice([1, 1, 2, 3, None]), r.choice([0, 1, 2, 3, None]), tuple(r.choice(["v", None]) for _ in FIELDS)) for i in range(300)]
    sky, filled = sources(spark, data)
    assert rows(filled) == brute(data)
    assert max(len(x.layers) for x in sky.collect()) <= 8 * 4  # sets of fields times ranks, however large the group


def test_a_deeper_layer_gives_what_the_first_lacks(spark, rows):
    # Record 2 has fewer fields than 1 and is neither more trusted nor more recent, but it alone has c.
    data = [("g", 1, 1, 3, ("v", "v", None)), ("g", 2, 2, 2, (None, None, "v")), ("g", 3, 3, 1, (None, None, "v"))]
    sky, filled = sources(spark, data, "count")
    assert rows(filled) == [(1, "a", 1), (1, "b", 1), (1, "c", 2)]
    assert rows(survivor.fill_sources(sky, FIELDS, layer=True), "from_id", "layer") == [(1, 0), (1, 0), (2, 1)]
    assert [(p.id, p.layer) for p in sky.first().layers] == [(1, 0), (2, 1), (3, 2)]
    sky, filled = sources(spark, data)
    assert rows(filled) == brute(data)
    assert [(p.id, p.layer) for p in sky.first().layers] == [(1, 0), (2, 0), (3, 1)]


def peeled(points, complete):
    """Layers by peeling: what nothing left dominates goes first."""
    over = lambda a, b: a != b and complete(a[2], b[2]) and a[0] <= b[0] and a[1] >= b[1]
    left, at, out = list(points), 0, {}
    while left:
        free = [b for b in left if not any(over(a, b) for a in left)]
        out |= {b[1]: at for b in free}
        left, at = [b for b in left if b not in free], at + 1
    return out


def test_layers_equal_peeling(spark):
    r = random.Random(6)
    data = [("g", i, r.choice([1, 2, 3]), i, tuple(r.choice(["v", None]) for _ in FIELDS)) for i in range(40)]
    top = {}
    for d in data:
        top[(d[4], d[2])] = d
    for form, complete in (("fields", lambda a, b: all(x or not y for x, y in zip(a, b, strict=True))), ("count", lambda a, b: sum(map(bool, a)) >= sum(map(bool, b)))):
        got = {p.id: p.layer for p in sources(spark, data, form)[0].first().layers}
        assert got == peeled([(d[2], d[1], d[4]) for d in top.values()], complete)


def test_empty_and_single_rows(spark, rows):
    assert rows(sources(spark, [])[1]) == []
    assert rows(sources(spark, [("g", 1, 1, 1, ("v", None, None))])[1]) == []
    same = ("g", 1, None, None, ("v", None, None))
    assert rows(sources(spark, [same, same])[1]) == [(1, "a", 1)]


def test_values_in_json(spark):
    cases = {
        '{"a": "x"}': True, '{"a": 0}': True, '{"a": false}': True, '{"a": ["x"]}': True, '{"b": 1, "a": {"c": 1}}': True, '{"a": "' + "x" * 100_000 + '"}': True,
        '{"a": ""}': False, '{"a": " \\t"}': False, '{"a": "N/A"}': False, '{"a": " unKnown "}': False, '{"a": null}': False, '{"a": []}': False, '{"a": {}}': False, '{"a": "?"}': False, '{"b": 1}': False,
        '{"a": "x"': False, '{"a": "x"} y': False, "{'a': 'x'}": False, '{"a": "x"}}': False, '["a"]': False, "": False, "null": False, None: False,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = df.select("t", survivor.json_fields(F.col("t"), ["a"])["a"].alias("has")).collect()
    assert {r.t: bool(r.has) for r in got} == cases
