"""Helpers shared by the operators: tables, joins of hot keys, and from the session's module shared storage and Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import fresh_path, materialize, remove_intermediates, shared_dir, spread, text_batches

__all__ = ["fresh_path", "join_hot_keys", "materialize", "remove_intermediates", "shared_dir", "table", "text_batches", "text_or_empty"]


#: Keys that join_hot_keys() takes for hot at most: those that hold at least that part of all rows.
HOT_KEYS = 1000


def join_hot_keys(rows: DataFrame, named: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """rows joined with named by a key that is distinct in named; counts (key, n) says how many rows each key has. All three
    are written tables. Keys with a HOT_KEYS-th of all rows, so at most HOT_KEYS keys, are joined by broadcast: a key that
    a third of all rows share stays where it is."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") * HOT_KEYS >= F.lit(total)).filter("n > 1").select(key)
    some = F.broadcast(named.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(some, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(named, key))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
