"""All queries of the engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.plans import assembly, more, official, relations, reports, texts

BOOKS = [reports.BOOK, relations.BOOK, texts.BOOK, more.BOOK, official.BOOK, assembly.BOOK]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for b in BOOKS for name, f in b.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for b in BOOKS for name, sql in b.oracles.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["cited_passages_ranked"](spark, sf_dir)
