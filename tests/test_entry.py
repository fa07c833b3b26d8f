import __spark_entry__ as driver


def test_entry_has_rows_and_a_stable_schema(spark):
    out = driver.entry(spark)
    assert out.columns == ["doc_id", "chunk_index", "kind", "speech_ms", "gap_ms"] and not out.isEmpty()


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
