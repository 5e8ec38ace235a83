import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestream.operators.keyed import merge
from lodestream.streaming.arrivals import arrivals, merge_arrivals, merged_rows, newest, windowed_counts

KIND = "k string, score int, at timestamp"
T = datetime(2025, 1, 1)


def test_arrivals_are_merged_batch_by_batch(spark, rows, tmp_path):
    def merged(current, batch):
        new = batch.groupBy("k").agg(F.max("score").alias("score"))
        return new if current is None else merge(current, new, "k", {"score": "greatest"}).drop("merge_state")

    for data in ([("a", 1, T), ("b", 5, T)], [("a", 3, T), ("c", 2, T)]):
        spark.createDataFrame(data, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        merge_arrivals(arrivals(spark, f"{tmp_path}/in", KIND), f"{tmp_path}/out", f"{tmp_path}/state", "k", merged).awaitTermination(60)
    assert rows(merged_rows(spark, f"{tmp_path}/out"), "k", "score") == [("a", 3), ("b", 5), ("c", 2)]


def test_a_batch_rewrites_only_its_parts_and_old_versions_go(spark, rows, tmp_path):
    def merged(current, batch):
        new = batch.groupBy("k").agg(F.max("score").alias("score"))
        return new if current is None else merge(current, new, "k", {"score": "greatest"}).drop("merge_state")

    seen = []
    for data in ([(c, 1, T) for c in "abcdefgh"], [("a", 2, T)], [("a", 3, T)], [("a", 4, T)]):
        spark.createDataFrame(data, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        merge_arrivals(arrivals(spark, f"{tmp_path}/in", KIND), f"{tmp_path}/out", f"{tmp_path}/state", "k", merged, parts=8).awaitTermination(60)
        seen.append(newest(spark, f"{tmp_path}/out"))
    changed = {p for p in seen[0] if seen[0][p] != seen[3][p]}
    assert len(changed) == 1 and len(seen[0]) > 1
    part = changed.pop()
    assert [os.path.exists(s[part].removeprefix("file:")) for s in seen] == [False, False, True, True]
    assert rows(merged_rows(spark, f"{tmp_path}/out"), "k", "score") == [("a", 4), *((c, 1) for c in "bcdefgh")]


def test_windows_count_the_same_on_a_stream(spark, rows, tmp_path):
    data = [("a", 1, T + timedelta(minutes=20 * i)) for i in range(6)]
    df = spark.createDataFrame(data, KIND)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = windowed_counts(arrivals(spark, f"{tmp_path}/in", KIND), "at", "k").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert rows(spark.table("counts")) == rows(windowed_counts(df, "at", "k")) == [(T, "a", 3), (T + timedelta(hours=1), "a", 3)]
