import __spark_entry__ as entry


def test_entry_gives_rows_of_a_stable_schema(spark):
    out = entry.entry(spark)
    assert out.columns == ["id", "score", "best"] and out.count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 76
