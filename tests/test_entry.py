import __spark_entry__ as e


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "hybrid_search" in e.queries()


def test_the_flagship_query(spark):
    rows = e.entry(spark).collect()
    assert len(rows) == 10
