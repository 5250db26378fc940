"""Filters over documents. All arguments are optional; those that are None don't filter."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_body(c: Column, least: int = 1) -> Column:
    """null counts as empty; least is the shortest text that counts as a body."""
    return F.length(F.coalesce(c, F.lit(""))) >= least


def half_open(c: Column, start: str | None, end: str | None) -> Column:
    """F2."""
    tests = [t for t in ((c >= F.lit(start)) if start else None, (c < F.lit(end)) if end else None) if t is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def document_filter(
    docs: DataFrame, *, site: str | None = None, sites: Iterable[str] | None = None, not_sites: Iterable[str] | None = None, category: str | None = None, year: int | None = None, start: str | None = None,
    end: str | None = None, has_number: bool | None = None, importance: str | None = None, doc_type: str | None = None, min_relevance: float | None = None, day: str = "day",
) -> DataFrame:
    """One conjunction, which reaches the scan. A range of days beats a year."""
    tests = [F.lit(True)]
    if site:
        tests.append(F.col("site_key") == site)
    if sites is not None:
        tests.append(F.col("site_key").isin(list(sites)))
    if not_sites:
        tests.append(~F.col("site_key").isin(list(not_sites)))
    if category:
        tests.append(F.col("category") == category)
    if start or end:
        tests.append(half_open(F.col(day), start, end))
    elif year is not None:
        tests.append(half_open(F.col(day), f"{year}-01-01", f"{year + 1}-01-01"))
    if has_number is not None:
        test = F.coalesce(F.col("document_number"), F.lit("")) != ""
        tests.append(test if has_number else ~test)
    for name, value in (("importance", importance), ("doc_type", doc_type)):
        if value:
            tests.append(F.col(name) == value)
    if min_relevance is not None:
        tests.append(F.col("ai_relevance") >= min_relevance)
    return docs.filter(reduce(lambda a, b: a & b, tests))


def any_term(columns: Iterable[str], terms: Iterable[str]) -> Column:
    """any term in any column, whatever the case of ASCII letters; % and _ are ordinary characters."""
    terms = [t.lower() for t in terms]
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False)) for c in columns for t in terms])


def any_or_pairs(c: Column, terms: Iterable[str], pairs: Iterable[tuple[str, str]]) -> Column:
    """any term, or both of a pair."""
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms] + [c.contains(a) & c.contains(b) for a, b in pairs])


def all_terms(c: Column, terms: Iterable[str]) -> Column:
    """F8."""
    return reduce(lambda a, b: a & b, [c.contains(t) for t in terms])


def untyped(c: Column) -> Column:
    """F5."""
    return F.coalesce(c, F.lit("")).isin("", "other")


def unprocessed(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't done."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def processed(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """F15."""
    return docs.join(done.select(key).distinct(), key, "left_semi")


def not_self(source_title: Column, target: Column) -> Column:
    """F16: neither name is part of the other."""
    return ~source_title.contains(target) & ~target.contains(source_title)
