"""Index rows as they arrive: files of a folder as a stream, merged batch by batch, and windowed counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestream.session import remove


def arrivals(spark: SparkSession, path: str, schema, files_at_once: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.parquet").parquet(path)


_PART = "_part"


def merge_arrivals(stream: DataFrame, target: str, state: str, key: str, merged: Callable[[DataFrame | None, DataFrame], DataFrame], parts: int = 64) -> StreamingQuery:
    """Merge each batch into a Parquet table by ``merged(current or None, batch)``, which keeps every key it is given.

    The table is divided by a hash of the key; a batch reads and rewrites the parts that its keys fall into and no
    others. A new version of a part is written beside the last, and a pointer row names the newest, so a batch that is
    run again after a failure starts from the same versions and readers never see half a batch. Versions
    that neither readers nor a repetition need are removed once the pointers have moved.
    """
    spark = stream.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            touched = sorted(r[0] for r in rows.select(part.alias("p")).distinct().collect())  # at most parts
            if not touched:
                return
            before = newest(spark, target, number)
            paths = [before[p] for p in touched if p in before]
            version = f"{target}/data/{number}-{uuid.uuid4().hex}"
            out = merged(spark.read.parquet(*paths) if paths else None, rows).withColumn(_PART, part)
            out.repartition(_PART).write.partitionBy(_PART).parquet(version)
            pointers = [(number, p, f"{version}/{_PART}={p}") for p in touched]
            spark.createDataFrame(pointers, "number bigint, part int, path string").coalesce(1).write.mode("append").parquet(f"{target}/versions")
            _remove_old(spark, target, touched)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def _remove_old(spark: SparkSession, target: str, touched: list[int]) -> None:
    """Remove all but the two newest versions of some parts; the older of these is what a repetition starts from."""
    versions = spark.read.parquet(f"{target}/versions").where(F.col("part").isin(touched))
    ranked = versions.groupBy("part").agg(F.array_sort(F.collect_list(F.struct((-F.col("number")).alias("n"), "path"))).alias("v"))
    for r in ranked.select(F.explode(F.expr("slice(v, 3, 8)")).alias("v")).select("v.path").collect():  # few for each part, as older ones went before
        remove(spark, r.path)


def newest(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """The path of the newest version of each part of a merged table (of those before a batch)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/versions")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return {}
    rows = spark.read.parquet(f"{target}/versions")
    rows = rows if before is None else rows.where(F.col("number") < before)
    return {r.part: r.path for r in rows.groupBy("part").agg(F.max_by("path", "number").alias("path")).collect()}


def merged_rows(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a merged table."""
    return spark.read.parquet(*newest(spark, target).values())


def windowed_counts(stream: DataFrame, at: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n) with late rows taken in up to a watermark; the same on a batch and on a stream."""
    seen = stream.withWatermark(at, late) if stream.isStreaming else stream
    return seen.groupBy(F.window(at, length).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "key", "n")
