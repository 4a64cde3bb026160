import __spark_entry__ as entry


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "merge_report" in entry.queries()
