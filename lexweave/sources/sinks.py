"""Sinks. Tables are replaced as a whole, so a job that fails leaves the old one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K5/K8."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """C3."""
    df.write.mode("append").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """K9: edges or nodes with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def json(df: DataFrame, path: str) -> None:
    """K10."""
    df.write.mode("overwrite").json(path)


def manifest(docs: DataFrame) -> DataFrame:
    """Id, url, site and body length."""
    return docs.select("id", "url", "site_key", F.length(F.coalesce("body", F.lit(""))).alias("body_length"))


def shrunk(before: int, after: int, share: float = 0.99) -> bool:
    """Whether a table lost more rows than it may."""
    return after < before * share


def snapshot(df: DataFrame, root: str, day: str) -> str:
    """A dated, compressed copy."""
    path = f"{root}/day={day}"
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)
    return path


def expired(days: list[str], daily: int = 7, weekly: int = 4) -> list[str]:
    """Dated copies beyond the newest `daily` and one for each of `weekly` older weeks."""
    from datetime import date

    ordered = sorted(days, reverse=True)
    keep, weeks = set(ordered[:daily]), []
    for d in ordered[daily:]:
        week = date.fromisoformat(d).isocalendar()[:2]
        if week not in weeks and len(weeks) < weekly:
            weeks.append(week)
            keep.add(d)
    return [d for d in sorted(days) if d not in keep]


def html_files(pages: DataFrame, path: str) -> None:
    """Page sources as text, a folder per site."""
    pages.select("site_key", F.col("html").alias("value")).write.mode("overwrite").partitionBy("site_key").option("lineSep", "\u0000").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Whether path took the name; if something has it already, path is deleted and that stays."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where(to)):
        fs.mkdirs(where(to).getParent())
        if fs.rename(where(path), where(to)):
            return True
    fs.delete(where(path), True)
    return False


class Versions:
    """A table as versioned folders below root/name: a version counts when its marker is there, the newest one is the table.
    A writer that dies leaves the version before it; old versions go when a newer one is complete."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root}/{name}"
        self.where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.where(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """All versions, complete or not."""
        if not self.fs.exists(self.where(self.path)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.where(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def _complete(self, number: int) -> bool:
        return self.fs.exists(self.where(f"{self.path}/v={number}/_SUCCESS"))

    def current(self) -> str | None:
        """The folder of the newest complete version."""
        return next((f"{self.path}/v={n}" for n in reversed(self._numbers()) if self._complete(n)), None)

    def read(self, schema: str) -> DataFrame:
        at = self.current()
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def replace(self, df: DataFrame) -> DataFrame:
        numbers = self._numbers()
        number = (numbers[-1] if numbers else 0) + 1
        df.write.parquet(f"{self.path}/v={number}")
        for n in numbers:
            self.fs.delete(self.where(f"{self.path}/v={n}"), True)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/v={number}")
