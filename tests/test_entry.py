import __spark_entry__ as e


def test_registry():
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries)


def test_entry(spark):
    assert e.entry(spark).count() > 0
