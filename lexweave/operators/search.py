"""Ranked search: tokens, postings, a stored index, BM25, substring search, and the chain of fallbacks."""

from __future__ import annotations

import math
import uuid
import zlib
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources.sinks import exists, rename

WEIGHTS = {"title": 12.0, "document_number": 6.0, "keywords": 4.0, "abstract": 2.0, "body": 1.0}
K1, B = 1.2, 0.75
BODY_CAP = 5000


def tokens(text: Column) -> Column:
    """Q1/Q2: lower-case words; runs of CJK characters as bigrams (single characters stand alone)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(r"[\x{4e00}-\x{9fff}]+|[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+"), F.lit(0))
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = lambda w: F.when(w.rlike(r"^[\x{4e00}-\x{9fff}]{2,}$"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda p: F.substring(w, p, F.lit(2)))).otherwise(F.array(w))
    # Texts without CJK, and there each token would pass through the lambda, take the plain way.
    return F.when(low.rlike(r"[\x{4e00}-\x{9fff}]"), F.flatten(F.transform(runs, grams))).otherwise(words)


def _weighted_terms(docs: DataFrame, weights: dict[str, float], body_cap: int) -> DataFrame:
    """doc_id, dl and terms: array of (term, w), a struct for each token."""
    fields = [f for f in weights if f in docs.columns]
    source = lambda f: F.substring(f, 1, body_cap) if f == "body" else F.col(f)
    arrays = docs.select("doc_id", *[tokens(source(f)).alias(f) for f in fields])
    arrays = arrays.withColumn("dl", sum((F.size(f) for f in fields), F.lit(0)))

    def weighted(f: str) -> Column:
        return F.transform(f, lambda t: F.struct(t.alias("term"), F.lit(weights[f]).alias("w")))

    return arrays.select("doc_id", "dl", F.concat(*[weighted(f) for f in fields]).alias("terms"))


def _counted(terms: DataFrame) -> DataFrame:
    return terms.select("doc_id", "dl", F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term"), "doc_id", "dl").agg(F.sum("t.w").alias("wtf"))


def postings(docs: DataFrame, weights: dict[str, float] = WEIGHTS, body_cap: int = BODY_CAP) -> DataFrame:
    """Q3: (term, doc_id, wtf, dl): weighted frequency and length of the document in tokens. The cap on the body is part of
    the index's definition."""
    return _counted(_weighted_terms(docs, weights, body_cap))


class StoredIndex:
    """Q3: an index that is built once and read by term. Below path: postings, a folder for each bucket of terms; documents
    (doc_id and the columns that ranking needs); stats (total, tokens), a row."""

    #: Part of an index's identity: changes with how terms are made, weighed and dealt.
    FORMAT = "2"

    def __init__(self, spark: SparkSession, path: str):
        """An index that is there, or an AnalysisException."""
        self.spark, self.path = spark, path
        stats = spark.read.parquet(f"{path}/stats").first()
        self.total, self.tokens, self.buckets = stats["total"], stats["tokens"], stats["buckets"]

    @classmethod
    def build(cls, docs: DataFrame, path: str, kept: list[str], buckets: int = 64, task_rows: int = 5_000_000) -> StoredIndex:
        """Written beside path and moved there when it is whole, so path holds a whole index or none. The postings of a term
        that is in most documents are dealt over several files of its bucket, about task_rows to each. A row without a term
        for each document gives the lengths."""
        spark, beside = docs.sparkSession, f"{path}.{uuid.uuid4().hex}"
        docs.select("doc_id", *kept).write.parquet(f"{beside}/documents")
        total = spark.read.parquet(f"{beside}/documents").count()
        salts = max(1, min(1000, total // task_rows))
        terms = _weighted_terms(docs, WEIGHTS, BODY_CAP)
        whole = F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("w")))
        rows = _counted(terms.withColumn("terms", F.concat("terms", whole))).withColumn("bucket", cls.bucket(F.col("term"), buckets))
        dealt = rows.repartition(buckets * salts, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{beside}/postings")
        lengths = cls._read(spark, beside, [""], buckets).agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
        lengths.select(F.lit(total).cast("long").alias("total"), F.col("tokens").cast("long").alias("tokens"), F.lit(buckets).alias("buckets")).write.parquet(f"{beside}/stats")
        rename(spark, beside, path)
        return cls(spark, path)

    @staticmethod
    def bucket(term: Column, buckets: int) -> Column:
        return (F.crc32(term.cast("binary")) % buckets).cast("int")

    @property
    def mean_length(self) -> float:
        """Documents without tokens count with length 0."""
        return self.tokens / self.total if self.tokens else 1.0

    @classmethod
    def _read(cls, spark: SparkSession, path: str, terms: list[str], buckets: int) -> DataFrame:
        """The folders of the terms' buckets; others aren't even listed."""
        schema, numbers = "term string, doc_id long, dl int, wtf double", {zlib.crc32(t.encode()) % buckets for t in terms}
        folders = [f for n in sorted(numbers) if exists(spark, f := f"{path}/postings/bucket={n}")]
        rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
        return rows.filter(F.col("term").isin(terms))

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of some terms; only their buckets are read."""
        return self._read(self.spark, self.path, terms, self.buckets)

    @cached_property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def bm25(self, query: list[str]) -> DataFrame:
        return bm25(self.postings(sorted(set(query))), query, self.total, self.mean_length)


def bm25(index: DataFrame, query: list[str], total: int, mean_length: float, k1: float = K1, b: float = B) -> DataFrame:
    """Q4: doc_id and score of the documents that hold all query terms. Only the terms' postings are read. An empty table or
    query has no hits."""
    terms = sorted(set(query))
    if not terms or not total:
        return index.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    hits = index.filter(F.col("term").isin(terms))
    # A count for each term of the query; those that no document has end the search.
    df = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}
    if len(df) < len(terms):
        return index.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    idf = F.element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, max(math.log((total - df[t] + 0.5) / (df[t] + 0.5)), 1e-6))]), F.col("term"))
    part = idf * F.col("wtf") * (k1 + 1) / (F.col("wtf") + k1 * (1 - b + b * F.col("dl") / mean_length))
    scored = hits.groupBy("doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("n"))
    return scored.filter(F.col("n") == len(terms)).select("doc_id", "score")


def ranked(docs: DataFrame, scores: DataFrame, query: str, title: str, day: str) -> DataFrame:
    """Q5: titles that hold the query, then score, then the newest; the smaller id on ties."""
    hit = docs.join(scores, "doc_id")
    return hit.orderBy(F.when(F.lower(F.col(title)).contains(query.lower()), 0).otherwise(1), F.desc("score"), F.desc_nulls_last(day), "doc_id")


def trigram_search(docs: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Q6: rows where a column holds the query (3 characters or more), whatever the case of letters."""
    if len(query) < 3:
        return docs.limit(0)
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False))
    return docs.filter(test)


def like_search(docs: DataFrame, query: str, columns: list[str], marks: str = "《》「」『』（）()“”\"'，。、；：！？· ") -> DataFrame:
    """Q7: as Q6 without regard to punctuation."""
    bare = query.lower().translate({ord(c): None for c in marks})
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.lower(F.translate(F.col(c), marks, "")).contains(bare), F.lit(False))
    return docs.filter(test)


def search(docs: DataFrame, index: StoredIndex | str | None, query: str, query_terms: list[str], columns: list[str]) -> tuple[str, DataFrame]:
    """Q8: the first path that finds something: BM25, then trigrams, then punctuation-blind scan. An index (or its path) that
    isn't there is passed over."""
    try:
        stored = StoredIndex(docs.sparkSession, index) if isinstance(index, str) else index
        if stored is not None and query_terms:
            scores = stored.bm25(query_terms)
            if not scores.isEmpty():
                return "bm25", docs.join(scores, "doc_id")
    except AnalysisException:  # no index, or one without postings
        pass
    found = trigram_search(docs, query, columns)
    if not found.isEmpty():
        return "trigram", found.withColumn("score", F.lit(0.0))
    return "like", like_search(docs, query, columns).withColumn("score", F.lit(0.0))


def trigram_index(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Q9: (gram, doc_id) of all three-character windows of the columns in lower case."""
    text = F.lower(F.concat_ws("\n", *columns))
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))
    return docs.select("doc_id", F.explode(grams).alias("gram"))


def indexed_search(docs: DataFrame, index: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Q6 by the index: documents that have all trigrams of the query are candidates, and are then verified."""
    low = query.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    hits = index.filter(F.col("gram").isin(grams)).groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    return trigram_search(docs.join(hits.select("doc_id"), "doc_id", "left_semi"), query, columns)


def refresh_index(index: DataFrame, docs: DataFrame, changed: DataFrame, columns: list[str]) -> DataFrame:
    """The index after documents changed: the rows of changed or deleted ids go, those of changed ids come anew."""
    kept = index.join(changed.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(trigram_index(docs.join(changed.select("doc_id"), "doc_id", "left_semi"), columns).select(*kept.columns))
