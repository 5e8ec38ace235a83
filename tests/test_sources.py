import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestream.sources import crawl_index as C
from lodestream.sources.paged import PagedIndex, fetch_page


def test_paths():
    assert C.index_paths("s3://b/", ["c1"]) == ["s3://b/crawl=c1/subset=warc/"]
    assert C.index_paths("b", ["c1", "c2"], {"c1": ["a.txt", "b.parquet", "c.parquet", "d.parquet"]}, 2) == ["b.parquet", "c.parquet", "b/crawl=c2/subset=warc/"]
    assert C.index_paths("b", ["c1"], explicit="x") == ["x"]


def test_schemas_merge_and_corrupt_files_are_counted(spark, tmp_path):
    spark.createDataFrame([("u1", 200)], "url string, fetch_status int").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([("u2", "text/html")], "url string, mime string").write.parquet(f"{tmp_path}/b")
    df = C.read_index(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert {(r.url, r.fetch_status, r.mime) for r in df.collect()} == {("u1", 200, None), ("u2", None, "text/html")}
    (tmp_path / "b" / "bad.parquet").write_bytes(b"no parquet")
    kind = "url string"
    seen = spark.read.schema(kind).option("ignoreCorruptFiles", "true").parquet(f"{tmp_path}/a", f"{tmp_path}/b")
    assert {r.n_rows for r in C.rows_by_file(seen).collect()} == {1} and C.rows_by_file(seen).count() == 2


def test_page_rows(spark):
    df = spark.createDataFrame([("200", "text/html; charset=x"), (" 301 ", "application/xhtml+xml"), ("404", "text/html"), (None, "text/html"), ("200", None)], "s string, m string")
    assert C.page_rows(df, F.col("s"), F.col("m")).count() == 1
    assert C.page_rows(df, F.col("s"), F.col("m"), xhtml=True).count() == 2


def test_records_and_ranks(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"url": "a", "status": "200"}\nbroken\n{"url": "b"}\n')
    assert sorted(r.url for r in C.read_records(spark, f"{tmp_path}/r.jsonl").collect()) == ["a", "b"]
    (tmp_path / "top.csv").write_text("1,a.de\n2,b.de\n3,c.de\n")
    with zipfile.ZipFile(tmp_path / "top.zip", "w") as z:
        z.writestr("top.csv", "1,a.de\n2,b.de\n3,c.de\n")
    for name in ("top.csv", "top.zip"):
        assert sorted(r.domain for r in C.read_ranks(spark, f"{tmp_path}/{name}", 2).collect()) == ["a.de", "b.de"]


def test_scanner_output(spark):
    outputs = ['noise\n[{"target": "x", "plugins": {" Shopify ": {"v": 1}, "": 1, "HTML5": "5"}}]', '{"plugins": {"Vue": [1]}}', "nothing", None]
    df = spark.createDataFrame([(o,) for o in outputs], "o string")
    got = [r.p for r in df.select(C.scanner_plugins(F.col("o")).alias("p")).collect()]
    assert got == [{"shopify": '{"v":1}', "html5": '{"value":"5"}'}, {"vue": '{"values":[1]}'}, None, None]


def test_paged_source_stops_at_a_sparse_page(spark, tmp_path):
    spark.dataSource.register(PagedIndex)
    line = lambda i: json.dumps({"url": f"u{i}", "status": 200})
    for page, n in enumerate((4, 1, 4)):
        (tmp_path / f"c1-de-{page}.jsonl").write_text("\n".join([*(line(page * 10 + i) for i in range(n)), "broken"]) + "\n")
    df = spark.read.format("paged_index").option("path", str(tmp_path)).option("crawls", "c1").option("endings", "de,nl").option("pagesize", "4").load()
    assert sorted((r.page, r.url) for r in df.collect()) == [(0, "u0"), (0, "u1"), (0, "u2"), (0, "u3"), (1, "u10")]


def test_failed_pages_are_tried_again():
    answers = iter([(503, ""), (200, '{"url": "a"}\n[]\n')])
    assert fetch_page(lambda *a: next(answers), "c", "de", 0, 10, 2, 0) == [{"url": "a"}]
    with pytest.raises(OSError):
        fetch_page(lambda *a: (502, ""), "c", "de", 0, 10, 1, 0)
    assert fetch_page(lambda *a: (404, ""), "c", "de", 0, 10, 1, 0) == []


def test_files_are_listed_and_runs_summed_up(spark, tmp_path):
    for name in ("b", "a"):
        spark.range(2).withColumn(name, F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    files = [f for n in ("a", "b") for f in C.listed_files(spark, f"{tmp_path}/{n}")]
    assert len(files) == 2 and C.listed_files(spark, f"{tmp_path}/a", 0) == []
    (tmp_path / "bad.parquet").write_text("none")
    paths = [*files, f"{tmp_path}/bad.parquet"]
    assert C.run_summary(paths, C.read_index(spark, paths, skip_corrupt=True)).collect() == [(3, 2, 1, 4)]
    with pytest.raises(Exception):  # noqa: B017 - nothing that can be read
        C.read_index(spark, [f"{tmp_path}/bad.parquet"], skip_corrupt=True).count()


def test_candidates_by_optional_clauses(spark):
    rows = spark.createDataFrame([("https://a.de/Shop", "DE", "c"), ("https://b.nl/x", None, None), (None, "de", "c")], "url string, country string, crawl string")
    urls = lambda *a, **o: [r.url for r in C.candidates(rows, *a, **o).collect()]
    assert urls(["shop"], 5) == ["https://a.de/Shop"] and urls([" "], 5) == [None, "https://a.de/Shop", "https://b.nl/x"]
    assert urls([], 5, countries=["de"], niches=["A.DE", ""]) == ["https://a.de/Shop"] and len(urls([], 0)) == 1


def test_addresses_of_pages():
    from lodestream.sources.paged import page_address

    assert page_address("https://index/c", "de", 2, 500) == "https://index/c?url=*.de&output=json&limit=100&fl=url,status,mime,languages&page=2"
