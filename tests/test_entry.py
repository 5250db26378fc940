"""The driver's entry points, with or without the optional part."""

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
    assert len(entry.queries()) > 150


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "cited_by", "citation_rank"] and df.count() > 0
