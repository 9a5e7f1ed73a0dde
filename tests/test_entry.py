import __spark_entry__ as contract


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "text_id"] and df.count() > 0


def test_sql_is_for_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
