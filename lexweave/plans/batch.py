"""The nightly batch (X5): take a snapshot in, compare, rebuild citations, scores and the search index, write only what
changed. Each step is written before the next one reads it. A table is a folder of versions, of which the newest complete one
counts (sinks.Versions), so a batch that dies at any point leaves whole tables and can be run again; run twice on the same
input, the second run changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.operators.changes import diff_write, snapshot_diff, upsert
from lexweave.operators.citations import build_citations, citation_rank
from lexweave.operators.search import postings
from lexweave.sources.sinks import Versions, shrunk

DOCUMENTS = "id int, site_key string, title string, number string, body string, references array<string>"
SCORES = "id int, citation_rank double, doc_type string, relevance double"


def scores(docs: DataFrame, citations: DataFrame, terms: dict[str, int] = L.AI_TERMS, kinds: list[tuple[str, str]] = L.DOC_TYPES) -> DataFrame:
    rank = citation_rank(citations).withColumnRenamed("target_id", "id")
    own = docs.select("id", T.first_rule(F.col("title"), kinds, "unknown", "other").alias("doc_type"), T.relevance(F.col("title"), F.col("body"), F.lit(""), terms).alias("relevance"))
    return own.join(rank, "id", "left").select("id", F.coalesce("citation_rank", F.lit(0.0)).alias("citation_rank"), "doc_type", "relevance")


def run_batch(spark: SparkSession, incoming: DataFrame, sites: DataFrame, root: str, run_id: str) -> dict[str, int]:
    """Tables below root: documents, changes/run=..., citations, scores, index. Returns the counts of a run's report."""

    def table(name: str) -> Versions:
        return Versions(spark, root, name)

    old = table("documents").read(DOCUMENTS)
    before = old.count()
    seen = old.join(incoming.select("id"), "id", "left_semi")
    changes = snapshot_diff(seen, incoming, "id", ["title", "number", "body"], run_id)
    changes.write.mode("overwrite").parquet(f"{root}/changes/run={run_id}")
    docs = table("documents").replace(upsert(old, incoming, "id"))
    citations = table("citations").replace(build_citations(docs, sites))
    now = scores(docs, citations)
    had = table("scores").read(SCORES)
    changed = diff_write(had, now, "id", ["citation_rank", "relevance"], ["doc_type"])
    changed.write.mode("overwrite").parquet(f"{root}/scores_changed/run={run_id}")
    table("scores").replace(now)
    table("index").replace(postings(docs.select(F.col("id").alias("doc_id"), "title", F.col("number").alias("document_number"), "body")))
    after = docs.count()
    return {
        "documents": after,
        "changes": spark.read.parquet(f"{root}/changes/run={run_id}").count(),
        "citations": citations.count(),
        "scores_written": spark.read.parquet(f"{root}/scores_changed/run={run_id}").count(),
        "shrunk": int(shrunk(before, after)),
    }
