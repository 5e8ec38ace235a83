"""Operators on keyed tables: latest and first rows, folds, merges, suffix and anti joins, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.json_docs import merge_json
from lodestream.functions.urls import parents
from lodestream.session import materialize

#: Rows, and bytes of them, that may be broadcast; beyond either, the join shuffles.
MOST_BROADCAST_ROWS, MOST_BROADCAST_BYTES = 500_000, 32 * 2**20


def small_or_shuffled(df: DataFrame, most: int = MOST_BROADCAST_ROWS, most_bytes: int = MOST_BROADCAST_BYTES, write: bool = True) -> DataFrame:
    """``df``, written once, and marked for broadcasting if it has been measured to have at most ``most`` rows and ``most_bytes`` bytes.

    Its columns are numbers, times, strings and bytes. ``write`` is false for what was written already and is only filtered.
    """
    df = materialize(df, "names") if write else df
    width = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in df.schema]
    head = df.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(sum(width, F.lit(0))).alias("size")).first()
    return F.broadcast(df) if head.n <= most and (head.size or 0) <= most_bytes else df


def latest(df: DataFrame, key: str, at: str, row_id: str) -> DataFrame:
    """The row with the latest time of each key, the highest id on a tie; null times are oldest.

    An aggregation rather than a window: it combines on the map side, so a key with very many rows is no burden.
    """
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.col(at).alias("_1"), F.col(row_id).alias("_2"))
    top = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return top.select(key, *(F.col("_row")[c].alias(c) for c in rest))


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key in order of arrival, with the key as ``key``; null keys are left out."""
    top = df.select(key.alias("key"), F.struct(*df.columns).alias("_row")).where("key is not null").groupBy("key").agg(F.min_by("_row", F.col("_row")[order]).alias("_row"))
    return top.select("key", *(F.col("_row")[c].alias(c) for c in df.columns if c != "key"))


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first rows of an order that is total: each partition keeps n rows, nothing is sorted as a whole."""
    return df.orderBy(*order).limit(max(1, n))


def page_of(df: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    size = min(max(size, 1), 100)
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def sorted_page(df: DataFrame, column: str, row_id: str, page: int, size: int, sortable: list[str], descending: bool = True) -> DataFrame:
    """A page of a grid sorted by one of its ``sortable`` columns, nulls last, ties by id."""
    if column not in sortable:
        raise ValueError(f"can't be sorted by {column}")
    by = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return page_of(df, page, size, by, F.desc(row_id))


def next_chunk(df: DataFrame, row_id: str, after: int | None, size: int) -> DataFrame:
    """The next rows in order of their id: the step of an iteration by key, which skips nothing when rows come or go."""
    return (df if after is None else df.where(F.col(row_id) > after)).orderBy(row_id).limit(size)


def new_rows(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't known yet."""
    return df.join(known.select(*on), on, "left_anti")


def where_given(df: DataFrame, filters: list[tuple[object, Column]]) -> DataFrame:
    """``df`` under the conditions whose value is given; None, '' and an empty list leave a condition out."""
    for value, condition in filters:
        if value is not None and value != "" and value != []:
            df = df.where(condition)
    return df


def suffix_matches(df: DataFrame, host: str, listed: DataFrame, name: str) -> DataFrame:
    """(host, listed) for each host that is listed or has a listed parent, with the longest one listed.

    Each host's parents are exploded, which turns the suffix test into an equality join.
    """
    hosts = df.select(F.col(host).alias("host")).where("host is not null").distinct()
    chain = hosts.select("host", F.explode(parents(F.col("host"))).alias("listed"))
    names = small_or_shuffled(listed.select(F.col(name).alias("listed")).where("listed is not null").distinct())
    return chain.join(names, "listed").groupBy("host").agg(F.max_by("listed", F.length("listed")).alias("listed"))


def merge(target: DataFrame, updates: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Upsert by key; each other column has a rule for keys that are in both.

    ``greatest`` the larger, ``union`` both sets sorted, ``new`` the update's even if null, ``old`` the
    target's, ``old_or_new`` the target's unless null, ``new_or_old`` the update's unless null, ``json`` both objects
    merged to any depth. Rows of only one side pass through. Both sides have at most one row for each key.
    """
    t, u = target.select(F.lit(True).alias("_in_t"), *target.columns).alias("t"), updates.select(F.lit(True).alias("_in_u"), *updates.columns).alias("u")
    out = [F.coalesce(F.col(f"t.{key}"), F.col(f"u.{key}")).alias(key)]
    for c, rule in rules.items():
        a, b = F.col(f"t.{c}"), F.col(f"u.{c}")
        empty = F.array()
        both = {
            "greatest": F.greatest(a, b), "new": b, "old": a, "old_or_new": F.coalesce(a, b), "new_or_old": F.coalesce(b, a),
            "json": merge_json(a, b) if rule == "json" else None,
            "union": F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty))) if rule == "union" else None,
        }[rule]
        out.append(F.when(F.col("u._in_u").isNull(), a).when(F.col("t._in_t").isNull(), b).otherwise(both).alias(c))
    state = F.when(F.col("u._in_u").isNull(), "kept").when(F.col("t._in_t").isNull(), "inserted").otherwise("updated")
    return t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "full_outer").select(*out, state.alias("merge_state"))
