"""The registry: names, SQL for the same names, and the flagship query."""

import __spark_entry__ as entry


def test_registry():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "klt" in names and len(names) > 90


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row.k > 0 and row.status in ("PASS", "REVIEW")
