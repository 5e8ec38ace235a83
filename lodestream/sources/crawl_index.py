"""Reading crawl indexes: Parquet with schemas merged by name, JSON lines, ranked lists, scanner output."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The answers that count as a page.
GOOD_STATUS = ("200", "301", "302")
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "status", "mime", "mime-detected", "languages", "timestamp")])


def index_paths(root: str, crawls: Iterable[str], files: dict[str, list[str]] | None = None, most: int | None = None, explicit: str | list[str] | None = None) -> list[str]:
    """The paths to read: an explicit one wins, else each crawl's folder, or its first ``most`` listed Parquet files."""
    if explicit:
        return [explicit] if isinstance(explicit, str) else list(explicit)
    out: list[str] = []
    for crawl in crawls:
        base = f"{root.rstrip('/')}/crawl={crawl}/subset=warc/"
        listed = files.get(crawl) if files else None
        out += [base] if listed is None else [f for f in listed if f.endswith(".parquet")][:most]
    return out


def read_index(spark: SparkSession, paths: list[str], skip_corrupt: bool = False) -> DataFrame:
    """Index rows of several paths with columns merged by name; ``skip_corrupt`` leaves out files that can't be read."""
    return spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("pathGlobFilter", "*.parquet").parquet(*paths)


def listed_files(spark: SparkSession, folder: str, most: int | None = None) -> list[str]:
    """The Parquet files of a folder, local or remote, in order of their names, the first ``most`` of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(str(f.getPath()) for f in found if f.getPath().getName().endswith(".parquet"))[:most]


def candidates(rows: DataFrame, patterns: list[str], limit: int, countries: list[str] | None = None, niches: list[str] | None = None) -> DataFrame:
    """(url, country, crawl) of index rows by optional clauses, five times as many as are wanted in the end.

    A pattern or niche is a part of the URL in lower case; a blank one counts as not given.
    """
    given = lambda words: [w for x in words or [] if (w := str(x).strip().lower())]
    low = F.lower("url")
    any_of = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words), F.lit(False))
    wanted, countries, niches = given(patterns), given(countries), given(niches)
    rows = rows.where(any_of(wanted)) if wanted else rows
    rows = rows.where(F.lower(F.coalesce("country", F.lit(""))).isin(countries)) if countries else rows
    rows = rows.where(any_of(niches)) if niches else rows
    return rows.select("url", F.coalesce("country", F.lit("")).alias("country"), F.coalesce("crawl", F.lit("")).alias("crawl")).orderBy("url", "crawl", "country").limit(max(1, limit * 5))


def run_summary(listed: list[str], read: DataFrame) -> DataFrame:
    """One row on a run over files: how many were listed, processed and skipped, and their rows."""
    of = rows_by_file(read)
    return of.agg(F.lit(len(listed)).alias("n_listed"), F.count(F.lit(1)).alias("n_processed"), F.lit(len(listed)).alias("_n"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")).select("n_listed", "n_processed", (F.col("_n") - F.col("n_processed")).alias("n_skipped"), "n_rows")


def rows_by_file(df: DataFrame) -> DataFrame:
    """(file, n_rows) of what was read: files that are missing here were skipped."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def page_rows(df: DataFrame, status: Column, mime: Column, xhtml: bool = False) -> DataFrame:
    """Rows that answered with a page: a good status and an HTML type."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    html = F.contains(kind, F.lit("text/html"))
    return df.where(F.trim(status.cast("string")).isin(*GOOD_STATUS) & (html | F.contains(kind, F.lit("application/xhtml")) if xhtml else html))


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Index records from JSON lines; lines that aren't valid are left out."""
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)


def read_ranks(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(rank, domain) of a ranked list, CSV or CSV in ZIP files, up to a rank."""
    schema = "rank int, domain string"
    if not path.endswith(".zip"):
        return spark.read.schema(schema).csv(path).where(F.col("rank") <= most)

    def unpacked(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    import pandas as pd

                    for name in z.namelist():
                        yield from pd.read_csv(z.open(name), names=["rank", "domain"], chunksize=50_000)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpacked, schema).where(F.col("rank") <= most)


def scanner_plugins(output: Column) -> Column:
    """The plugins of a scanner's first JSON line, names in lower case; null where there is none.

    A plugin's payload is JSON text of an object: an object as it is, a list as ``{"values": ...}``, anything else as ``{"value": ...}``.
    """
    first = F.get(F.filter(F.transform(F.split(output, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[\[{]")), F.lit(0))
    listed = F.get(F.from_json(F.when(first.startswith("["), first).otherwise(F.concat(F.lit("["), first, F.lit("]"))), "array<struct<target:string,plugins:map<string,variant>>>"), F.lit(0))
    named = F.transform_keys(F.map_filter(listed["plugins"], lambda k, _: F.trim(k) != ""), lambda k, _: F.lower(F.trim(k)))

    def payload(v: Column) -> Column:
        text, kind = F.coalesce(F.to_json(v), F.lit("null")), F.schema_of_variant(v)
        return F.when(kind.startswith("OBJECT"), text).when(kind.startswith("ARRAY"), F.concat(F.lit('{"values":'), text, F.lit("}"))).otherwise(F.concat(F.lit('{"value":'), text, F.lit("}")))

    return F.transform_values(named, lambda _, v: payload(v))
