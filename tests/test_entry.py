import __spark_entry__


def test_queries_and_oracles(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and "sessions" in q
    assert __spark_entry__.entry(spark).count() == 15
