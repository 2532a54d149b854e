import __spark_entry__ as driver


def test_entry_runs(spark):
    rows = driver.entry(spark)
    assert rows.count() > 0 and "modal_sector" in rows.columns


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
