from pyspark.sql import functions as F

from lodestream.functions.writing import trimmed_lower


def test_trimmed_lower(spark):
    df = spark.createDataFrame([("\t A b 　",), (None,)], "w string")
    assert [r[0] for r in df.select(trimmed_lower(F.col("w"))).collect()] == ["a b", None]
