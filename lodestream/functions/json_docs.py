"""JSON documents and lists as columns: recursive merges, patches, display forms."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _load(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _merged(old, new):
    """Keys of both; what isn't a container on both sides is taken from the incoming one. Lists merge by place."""
    if isinstance(old, dict) and isinstance(new, dict):
        return {k: _merged(old[k], new[k]) if k in old and k in new else new.get(k, old.get(k)) for k in [*old, *(k for k in new if k not in old)]}
    if isinstance(old, list) and isinstance(new, list):
        return [_merged(a, b) for a, b in zip(old, new, strict=False)] + (new[len(old) :] or old[len(new) :])
    return new


@F.pandas_udf(T.StringType())
def merge_json(old: pd.Series, new: pd.Series) -> pd.Series:
    """Two JSON objects merged to any depth; one that is null or not valid counts as empty."""

    def one(a: str | None, b: str | None) -> str:
        x, y = _load(a), _load(b)
        return json.dumps(_merged(x if isinstance(x, dict) else {}, y if isinstance(y, dict) else {}), ensure_ascii=False)

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)], dtype=object)


def patch_json(document: Column, **fields: Column) -> Column:
    """A JSON object with some top-level fields set; fields whose value is null are left as they are."""
    have = F.coalesce(F.from_json(document, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    news = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), F.parse_json(F.to_json(F.struct(v.alias("v")))).alias("value"))) for k, v in fields.items())))
    kept = F.map_filter(have, lambda k, _: ~F.exists(news, lambda n: n["key"] == k))
    return F.to_json(F.map_concat(kept, F.map_from_entries(F.transform(news, lambda n: F.struct(n["key"].alias("key"), F.variant_get(n["value"], "$.v", "variant").alias("value"))))))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def display_list(a: Column) -> Column:
    """Trimmed members in their order, without blanks, nulls and repeats."""
    return F.array_distinct(F.filter(F.transform(F.array_compact(a), lambda x: F.trim(x)), lambda x: x != ""))


def first_or_blank(text: Column) -> Column:
    """The first member of a JSON list of strings, '' where there is none."""
    return F.coalesce(F.get(F.from_json(text, "array<string>"), F.lit(0)), F.lit(""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def display_values(text: pd.Series) -> pd.Series:
    """The members of a JSON value for display: lists flattened to any depth, trimmed, without blanks and repeats; objects as JSON text."""

    def flat(value) -> list:
        if isinstance(value, list):
            return [y for x in value for y in flat(x)]
        return [value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)]

    return text.map(lambda t: list(dict.fromkeys(x for v in flat(_load(t)) if (x := v.strip()))))


def kept_json(columns: dict[str, Column], keep: list[str]) -> Column:
    """A JSON object of the listed columns, as far as there are any; nulls are kept as nulls."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in keep if k in columns)), {"ignoreNullFields": "false"})
