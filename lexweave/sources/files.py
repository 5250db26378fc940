"""Sources: files of all formats that the engine reads, and the parsers of feeds. Nothing here fetches from a network:
pages and answers of interfaces come as tables or files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lexweave.functions.html import balanced


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Columns and filters reach the scan."""
    return spark.read.parquet(path)


def sqlite(spark: SparkSession, path: str, table: str, driver: str = "org.sqlite.JDBC") -> DataFrame:
    """Needs a SQLite JDBC driver on the class path."""
    return spark.read.format("jdbc").options(url=f"jdbc:sqlite:{path}", dbtable=table, driver=driver).load()


def optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """S3: an empty table where the path doesn't exist."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def yaml_tree(text: str) -> list[tuple[str, str | None, str, list[str], list[str]]]:
    """A nested list of {id, label, sites, prefixes, children} -> (id, parent_id, label, sites, prefixes)."""
    import yaml

    out: list[tuple[str, str | None, str, list[str], list[str]]] = []

    def walk(nodes: list[dict], parent: str | None) -> None:
        for n in nodes or []:
            out.append((str(n["id"]), parent, str(n.get("label", n["id"])), list(n.get("sites", [])), list(n.get("prefixes", []))))
            walk(n.get("children", []), str(n["id"]))

    data = yaml.safe_load(text)
    walk(data if isinstance(data, list) else data.get("tree", []), None)
    return out


def yaml_dimension(spark: SparkSession, path: str) -> DataFrame:
    """A tree file as a table; such files are small configuration."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(yaml_tree(text), "id string, parent_id string, label string, sites array<string>, prefixes array<string>")


def json_config(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return spark.read.option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Bad lines become nulls."""
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A declared schema, so the file isn't read twice."""
    return spark.read.schema(schema).option("header", True).csv(path)


def xlsx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """First sheet of each workbook as strings; needs openpyxl."""
    import importlib.util

    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("reading workbooks needs openpyxl")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.read_excel(io.BytesIO(content), dtype=str)[columns]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns))


def raw_html(spark: SparkSession, path: str) -> DataFrame:
    """Path and whole text of each file; bytes that aren't UTF-8 are replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def magic_type(content: Column) -> Column:
    """Type of an attachment by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "docx").when(head.startswith("D0CF11E0"), "doc").when(head.startswith("7B5C727466"), "rtf").otherwise("unknown")


@F.pandas_udf(StringType())
def decode_charset(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """By the declared charset, GBK and GB2312 as GB18030, else UTF-8, else GB18030."""
    import re

    sign = re.compile(rb"charset=[\"']?([\w-]+)", re.I)

    def decode(data: bytes | None) -> str | None:
        if data is None:
            return None
        m = sign.search(data[:2048])
        name = m[1].decode("ascii").lower() if m else "utf-8"
        name = "gb18030" if name in ("gbk", "gb2312", "gb18030") else name
        for charset in (name, "gb18030"):
            try:
                return data.decode(charset)
            except (UnicodeDecodeError, LookupError):
                continue
        return data.decode("utf-8", "replace")

    for content in contents:
        yield content.map(decode)


def paged_items(answers: DataFrame, schema: str, items: str = "items") -> DataFrame:
    """Rows of the arrays in JSON answers (body)."""
    return answers.select(F.from_json("body", f"{items} array<struct<{schema}>>").alias("j")).select(F.inline(F.col(f"j.{items}")))


def counted_pages(answers: DataFrame, per_page: int, total: str = "total") -> DataFrame:
    """The answers (page from 0, body) up to the page that the first answer's total makes the last: some interfaces repeat
    their last page for ever. Without a readable total all pages stay."""
    first = answers.filter("page = 0").agg(F.max(F.ceil(F.from_json("body", f"{total} long")[total] / per_page)).alias("__pages"))
    return answers.crossJoin(F.broadcast(first)).filter(F.col("__pages").isNull() | (F.col("page") < F.col("__pages"))).drop("__pages")


def rss_items(xml: Column) -> Column:
    """Array of (title, link, day) of a feed; CDATA marks go."""
    part = lambda tag: F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<item\b.*?</item>"), F.lit(0)), lambda i: F.trim(F.regexp_replace(F.regexp_extract(i, rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"<!\[CDATA\[|\]\]>", "")))
    return F.transform(F.arrays_zip(part("title").alias("title"), part("link").alias("link"), part("pubDate").alias("day")), lambda r: r)


def sitemap_urls(xml: Column) -> Column:
    """S15."""
    return F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))


def cdata_records(xml: Column) -> Column:
    """Contents of CDATA records."""
    return F.regexp_extract_all(xml, F.lit(r"(?s)<record><!\[CDATA\[(.*?)\]\]></record>"), F.lit(1))


def live_or_archive(live: DataFrame, archive: DataFrame, key: str, body: str, usable: Column) -> DataFrame:
    """The live body where it is usable, else the archive's."""
    good = live.filter(usable).select(key, body, F.lit("live").alias("origin"))
    rest = archive.join(good.select(key), key, "left_anti").select(key, body, F.lit("archive").alias("origin"))
    return good.unionByName(rest)


def embedded_config(html: Column, name: str, schema: str) -> Column:
    """A JSON object or list assigned to a variable, or to a key, in a page's script; braces are matched, so values may
    hold objects, and "};" in strings."""
    return F.from_json(balanced(html, F.lit(rf"\b{name}\s*[=:]\s*")), schema)


def config_tree(html: Column, name: str, key: str, schema: str) -> Column:
    """The JSON list under a key of a script's object that isn't JSON itself (bare keys, single quotes)."""
    return embedded_config(balanced(html, F.lit(rf"\b{name}\s*=\s*")), key, schema)


def id_range(spark: SparkSession, listing: DataFrame, key: str, ahead: int = 49) -> DataFrame:
    """Ids of a listing and the next ones after its largest."""
    top = listing.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    more = top.select(F.explode(F.sequence(F.col("top") + 1, F.col("top") + ahead)).alias(key))
    return listing.select(key).unionByName(more).distinct()
