"""The corpus pipeline: five stages over documents, each of them written before the next one reads it.

Rows that stages keep keep all their columns, whatever their names. Null texts count as empty, null ids never beat others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import exact_dedup, packing, quality, secret_scan, simhash
from lexweave.llm.common import materialize, table, text_or_empty

#: Names for helper columns; no table has these.
ID, KEY = "__lexweave_id", "__lexweave_key"


def _without(docs: DataFrame, dropped: DataFrame, key: F.Column) -> DataFrame:
    """docs without the rows whose (doc_id, key) is in dropped (doc_id, key)."""
    named = dropped.select(F.col("doc_id").alias("__drop_id"), F.col("key").alias("__drop_key")).distinct()
    tagged = docs.withColumn(ID, F.col("doc_id").cast("long")).withColumn(KEY, key)
    same = F.col(ID).eqNullSafe(F.col("__drop_id")) & (F.col(KEY) == F.col("__drop_key"))
    return tagged.join(named, same, "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.good_rows(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the row with the smallest id stays; of rows that repeat it, one."""
    found = materialize(exact_dedup.exact_dedup(docs), "exact-dedup")
    keys = found.groupBy("doc_id", F.col("text_sha256").alias("key")).agg(F.count("*").alias("n"), F.count_if("kept").alias("stay"))
    key = F.sha2(exact_dedup.normalized(text_or_empty("text")), 256)
    left = _without(docs, keys.filter("stay = 0"), key)
    if not keys.filter("n > stay and stay > 0").isEmpty():
        left = left.dropDuplicates([ID, KEY])
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    found = materialize(simhash.similar_documents(docs), "near-dedup")
    dropped = found.filter("component_id is not null and not (doc_id <=> component_id)").select("doc_id", F.col("text_hash").alias("key"))
    left = _without(docs, dropped, F.xxhash64(text_or_empty("text")))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return secret_scan.redact(docs, secret_scan.train())


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, packing.vocabulary_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("near dedup", near_deduplication),
    ("secret scans", secret_redaction),
    ("packing", best_fit_packing),
]

#: Boosted trees, fingerprints and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
