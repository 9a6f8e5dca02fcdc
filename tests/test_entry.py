import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["unit_id", "criterion", "severity", "n", "last_line"]
    assert df.count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
