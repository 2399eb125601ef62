import __spark_entry__ as entry


def test_flagship_and_registry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["page_id", "det_id", "class_name", "line", "ord", "reading"] and frame.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
