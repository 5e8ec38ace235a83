"""Duplicates hidden by formatting differences.

Records whose canonical key is equal collapse into one group; its representative is the smallest id.
Keys travel as 128-bit digests, so a shuffled record has the same small size whatever its text.

Hot keys (at least ``hot_rows`` records, whatever share of all records that is) are detected exactly from
counts that are combined on the map side. Their records never meet in one task: they are salted into
two-level aggregation and get their representative by a join with that table of one row for each hot key,
broadcast if it has been measured to be small. All other keys take one shuffle, which their aggregation and
the join back to their records share; a task sees fewer than ``hot_rows`` records of any of these keys.

Defined results: a null key is never in a group; a key that occurs once gives a group of one; repeated
rows with the same id count as copies; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.keyed import small_or_shuffled
from lodestream.session import materialize

#: Records of one key that a single task may be given.
HOT_ROWS = 10_000
SALTS = 64


def keyed(df: DataFrame, row_id: str, key: Column, tag: str) -> DataFrame:
    """(tag, id, digest) of the records with a key."""
    text = key.alias("k")
    rows = df.select(F.col(row_id).cast("long").alias("id"), text).where("k is not null")
    return rows.select(F.lit(tag).alias("tag"), "id", F.unhex(F.md5(F.concat(F.lit(tag + ":"), "k"))).alias("digest"))


def groups(records: DataFrame, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """(tag, id, first_id, copies) of every record of ``keyed``: its group's smallest id and size."""
    records = materialize(records, "keyed")
    hot = small_or_shuffled(records.groupBy("digest").count().where(F.col("count") >= hot_rows).select("digest"))
    state = (F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    out = ["tag", "id", "first_id", "copies"]
    rest = records.join(hot, "digest", "left_anti").repartition("digest")
    rest = rest.join(rest.groupBy("digest").agg(*state), "digest").select(*out)
    if hot.isEmpty():
        return rest
    heavy = records.join(hot, "digest", "left_semi")
    salted = heavy.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(*state)
    found = small_or_shuffled(salted.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies")))
    return rest.unionByName(heavy.join(found, "digest").select(*out))


def collapse(df: DataFrame, row_id: str, key: Column, **options) -> DataFrame:
    """One record of ``df`` for each group, with ``n_copies``; records without a key stand for themselves.

    A column of ``df`` that is called ``n_copies`` already is replaced.
    """
    of = groups(keyed(df, row_id, key, ""), **options)
    kept = of.where("id = first_id").groupBy("id").agg(F.max("copies").alias("_n")).withColumnRenamed("id", "_first")
    lone = df.where(key.isNull()).select("*", F.lit(1).cast("long").alias("_n"))
    first = df.where(key.isNotNull()).join(kept, F.col(row_id) == F.col("_first")).drop("_first").dropDuplicates([row_id])
    return first.unionByName(lone).drop("n_copies").withColumnRenamed("_n", "n_copies")
