import glob
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    """The tables without rows, each with extra columns whose names are those the operators use inside."""
    folder = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        df = spark.read.parquet(path).limit(0)
        extra = [c for c in ("entity", "value", "at", "key", "host", "era", "rank", "mask", "digest", "tag", "pid", "us", "rec", "row_id", "_k", "n") if c not in df.columns]
        df.selectExpr("*", *(f"'clash' as `{c}`" for c in extra)).write.parquet(f"{folder}/{Path(path).name}")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("p")])
def test_problems_on_empty_tables(spark, empty, name):
    got = entry.queries()[name](spark, empty)
    assert got.columns == entry.queries()[name](spark, FOLDER).columns
    assert got.count() == (8 if name == "p8_shares" else 0) or name == "p8_shares"


@pytest.fixture(scope="module")
def doubled(spark, tmp_path_factory):
    """The smallest tables with the same extra columns, filled."""
    folder = tmp_path_factory.mktemp("extra")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        df = spark.read.parquet(path)
        extra = [c for c in ("entity", "value", "at", "key", "host", "era", "rank", "mask", "digest", "tag", "pid", "us", "rec", "row_id", "_k", "n") if c not in df.columns]
        df.selectExpr("*", *(f"'clash' as `{c}`" for c in extra)).coalesce(1).write.parquet(f"{folder}/{Path(path).name}")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.endswith("_found")])
def test_extra_columns_change_nothing(spark, doubled, rows, name):
    assert rows(entry.queries()[name](spark, doubled)) == rows(entry.queries()[name](spark, FOLDER))
