import __spark_entry__ as entry

#: Later pages of a grid, which the smallest tables don't reach.
LATER = {"r_latest_filter"}


def test_every_query_runs_on_the_smallest_tables(spark):
    sql = entry.oracle_sql()
    assert set(sql) <= set(entry.queries())
    for name, query in entry.queries().items():
        folder = "/root/testdata/sf0.01" if name in LATER else "/root/testdata/sf0.001"
        df = query(spark, folder)
        assert len(set(df.columns)) == len(df.columns) > 0, name
        assert df.count() > 0, name
        assert query(spark, folder).schema.simpleString() == df.schema.simpleString(), name


def test_flagship(spark):
    df = entry.entry(spark)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("attribute", "string"), ("domain_id", "bigint"), ("attr_value", "string"), ("valid_from", "string")]
    assert df.count() == 400
