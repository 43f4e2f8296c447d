import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 20


def test_queries_and_sql_belong_together():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40
