"""Every query against its SQL on another engine."""

import math

import duckdb
import pytest

from lexweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns, rows):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(registry.oracles()[name])
    names = [d[0] for d in result.description]
    expected = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    assert sorted(names) == columns
    assert rows_of(columns, df.collect()) == rows_of(columns, expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0


def test_index_finds_what_first_lines_lack(spark, sf_dir, duck):
    first = {r[0] for r in duck.execute("SELECT doc_id FROM documents WHERE contains(lower(split_part(text, chr(10), 1)), 'tion ')").fetchall()}
    assert first < {r["doc_id"] for r in registry.queries()["q09_trigram_index"](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", ["a20_site_by_level", "a20_central_by_sites"])
def test_citations_meet_sites_by_merging(spark, sf_dir, name):
    """the files of all citations are small enough to be broadcast, their rows aren't."""
    assert "Broadcast" not in registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a28_citation_gaps", "g01_document_citations"])
def test_queries_read_written_citations(spark, sf_dir, name):
    """the plan has written citations and documents, not the builder's last joins."""
    assert {"citations" if "/citations-" in f else f.rsplit("/", 1)[-1] for f in registry.queries()[name](spark, sf_dir).inputFiles()} == {"citations", "documents.parquet"}
