"""Session helpers shared by all operators: shared scratch tables and sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir`` of the session wins; only where neither that nor a
    checkpoint folder of the context is set (local tests) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="lodestream-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet into the shared folder and read it again.

    Columnar and compressed, so it's smaller than ``checkpoint()``, and it survives the
    loss of any executor. The table is removed by ``release``, at the latest when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestream/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Remove the intermediate tables written so far: for long sessions, once the results that read them have been written."""
    while _written:
        spark, path = _written.pop()
        remove(spark, path)


@atexit.register
def _remove_written() -> None:
    try:
        release()
    except Exception:  # the JVM is gone; the folder's owner removes it
        return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
