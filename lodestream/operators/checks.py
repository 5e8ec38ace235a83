"""Checks of rows by named rules, and keys resolved in more than one way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(df: DataFrame, rules: dict[str, Column], name: str = "failed") -> DataFrame:
    """``df`` with the sorted names of the rules that a row breaks; a rule that can't tell (null) is broken."""
    return df.withColumn(name, F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())))))


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with the rules they break)."""
    marked = checked(df, rules, "_failed")
    return marked.where(F.size("_failed") == 0).drop("_failed"), marked.where(F.size("_failed") > 0).withColumnRenamed("_failed", "failed")


def optional(column: Column, *tests: Column) -> Column:
    """A rule for a column that may be null."""
    out = column.isNull()
    both = F.lit(True)
    for t in tests:
        both = both & t
    return out | both


def resolve(df: DataFrame, known: DataFrame, row_id: str, ways: list[tuple[Column, Column]]) -> DataFrame:
    """(row_id, known_id): for each row the smallest id of ``known`` by the first way that finds one, else null.

    ``known`` has ``id``; a way is a key of ``df`` and one of ``known``. An equality join for each way, never a
    join on alternatives.
    """
    out, found = df.select(F.col(row_id).alias("row_id"), *(a.alias(f"_k{i}") for i, (a, _) in enumerate(ways))), []
    for i, (_, b) in enumerate(ways):
        of = known.select(b.alias(f"_k{i}"), F.col("id")).where(F.col(f"_k{i}").isNotNull()).groupBy(f"_k{i}").agg(F.min("id").alias(f"_id{i}"))
        out = out.join(of, f"_k{i}", "left")
        found.append(F.col(f"_id{i}"))
    return out.select("row_id", F.coalesce(*found).alias("known_id"))
