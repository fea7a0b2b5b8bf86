import __spark_entry__ as entry


def test_entry(spark, data):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
