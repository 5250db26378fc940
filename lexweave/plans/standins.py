"""The data model of the engine on the driver's tables: DataFrames, and the same as common table expressions in SQL.

documents: source is the site, its number decides the site's level. edges: an order cites the parts of its lines; parts
of a size under 5 aren't held, so their edges dangle. items: line amounts by nation and part type. changes: events by
day and type. careers: a customer's orders in a year at a nation. pages: hrefs are references that nothing resolves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import spread

LEVELS = {"1-URGENT": "central", "2-HIGH": "provincial", "3-MEDIUM": "municipal", "4-NOT SPECIFIED": "department"}


class Book:
    """Queries of a module and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table; those with whole texts, whose work is in the texts, use all cores."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def level_of(c: F.Column) -> F.Column:
    out = F.lit("unknown")
    for k, v in LEVELS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, site_key, category, title (first line), body, n_chars, document_number (of every third), day."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("site_key"), F.col("lang").alias("category"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "n_chars",
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("No. "), F.col("doc_id").cast("string"))).otherwise("").alias("document_number"), F.date_add(F.lit("2015-01-01").cast("date"), (F.col("doc_id") % 3000).cast("int")).alias("day"),
    )


DOCUMENTS = """docs AS (SELECT doc_id AS id, source AS site_key, lang AS category, split_part(text, chr(10), 1) AS title, text AS body, n_chars,
 CASE WHEN doc_id % 3 = 0 THEN 'No. ' || doc_id ELSE '' END AS document_number, DATE '2015-01-01' + CAST(doc_id % 3000 AS INTEGER) AS day FROM documents)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    level = F.element_at(F.array(*[F.lit(x) for x in ("central", "provincial", "municipal", "department", "media")]), n % 5 + 1)
    return read(spark, sf_dir, "documents").select("source").distinct().select(F.col("source").alias("site_key"), F.concat(F.lit("Site "), n.cast("string")).alias("name"), level.alias("admin_level"))


SITES = """sites AS (SELECT DISTINCT source AS site_key, 'Site ' || CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS name,
 ['central', 'provincial', 'municipal', 'department', 'media'][CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 5 + 1] AS admin_level FROM documents)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, order, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    e = line.join(order, line.l_orderkey == order.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    kind = F.when(F.col("l_linenumber") % 3 == 1, "formal").when(F.col("l_linenumber") % 3 == 2, "named").otherwise("llm")
    return e.select(
        F.col("o_orderkey").alias("source_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target_ref"), F.when(F.col("p_size") >= 5, F.col("l_partkey")).alias("target_id"), kind.alias("citation_type"),
        level_of(F.col("o_orderpriority")).alias("source_level"), F.element_at(F.array(*[F.lit(x) for x in ("central", "provincial", "municipal", "district", "unknown")]), (F.col("l_partkey") % 5 + 1).cast("int")).alias("target_level"),
    )


_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVELS.items()) + " ELSE 'unknown' END"
EDGES = f"""edges AS (SELECT o_orderkey AS source_id, 'P' || l_partkey AS target_ref, CASE WHEN p_size >= 5 THEN l_partkey END AS target_id,
 CASE l_linenumber % 3 WHEN 1 THEN 'formal' WHEN 2 THEN 'named' ELSE 'llm' END AS citation_type, {_CASE} AS source_level,
 ['central', 'provincial', 'municipal', 'district', 'unknown'][l_partkey % 5 + 1] AS target_level
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, order, part, customer, nation = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer", "nation"))
    e = line.join(order, line.l_orderkey == order.o_orderkey).join(part, line.l_partkey == part.p_partkey).join(customer, order.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return e.select(F.col("o_orderkey").alias("document_id"), F.round("l_extendedprice").cast("long").alias("amount"), F.col("p_type").alias("sector"), F.col("n_name").alias("site_key"), F.to_date("o_orderdate").alias("day"))


ITEMS = """items AS (SELECT o_orderkey AS document_id, CAST(round(l_extendedprice) AS BIGINT) AS amount, p_type AS sector, n_name AS site_key, CAST(o_orderdate AS DATE) AS day
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("site_key"), kind.alias("change_type"), F.date_format("ts", "yyyy-MM-dd").alias("sync_run_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("detected_at"))


CHANGES = """changes AS (SELECT event_id AS document_id, 'src' || (user_id % 20) AS site_key, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type,
 strftime(ts, '%Y-%m-%d') AS sync_run_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS detected_at FROM events)"""


def careers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, organization, province, start_m, end_m (null for odd persons' last)."""
    order, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    e = order.join(customer, order.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    m = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    org = F.concat_ws("/", "n_name", "c_mktsegment")
    return e.groupBy(F.col("c_custkey").alias("person_id"), org.alias("organization"), F.col("n_name").alias("province"), F.floor(F.year("o_orderdate") / 2).cast("int").alias("term")).agg(F.min(m).alias("start_m"), F.max(m).alias("last")).select(
        "person_id", "organization", "province", "term", "start_m", F.when((F.col("person_id") % 7 == 0) & (F.col("last") > 24000), F.lit(None)).otherwise(F.col("last")).alias("end_m")
    )


CAREERS = """careers AS (SELECT person_id, organization, province, term, start_m, CASE WHEN person_id % 7 = 0 AND last > 24000 THEN NULL ELSE last END AS end_m FROM (
 SELECT c_custkey AS person_id, n_name || '/' || c_mktsegment AS organization, n_name AS province, CAST(floor(year(o_orderdate) / 2) AS INTEGER) AS term,
 min(CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER)) AS start_m, max(CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER)) AS last
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4))"""


def with_(*tables: str) -> str:
    return "WITH " + ", ".join(tables) + " "
