"""The citation builder: extraction, canonical form, resolution, levels, ranks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.operators.joins import longest_suffix, resolve_titles, two_keys
from lexweave.session import materialize


def known_abbreviations(numbers: DataFrame, refs: DataFrame, most: int = 6, issuers: dict[str, str] = L.ISSUERS) -> DataFrame:
    """T9x: issuer abbreviations (word) of held documents (number), of short standalone references (ref) and the table."""
    held = numbers.select(T.ref_issuer(F.col("number")).alias("word")).filter("word is not null")
    short = refs.select(T.ref_issuer(T.normalize_ref(F.col("ref"))).alias("word")).filter(F.length("word").between(2, most) & ~F.col("word").rlike(L.HEAD_NOISE))
    listed = refs.sparkSession.createDataFrame([(k,) for k in issuers if not re.match(L.LEAD_IN, k)], "word string")
    return held.unionByName(short).unionByName(listed).distinct()


def canonical_refs(refs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """T10x: adds canonical to refs (ref). What stands before a known abbreviation goes if it looks like an agency's name
    or a piece of a sentence, or if the whole is longer than 8."""
    base = refs.withColumn("__norm", T.normalize_ref(F.col("ref"))).withColumn("__prefix", T.ref_issuer(F.col("__norm"))).withColumn("__core", T.ref_core(F.col("__norm")))
    gate = F.col("head").rlike(f"[{L.ORG_MARKERS}]") | F.col("head").rlike(L.HEAD_NOISE) | (F.length("__prefix") > 8)
    found = longest_suffix(base, "__prefix", vocabulary, gate)
    return found.withColumn("canonical", F.when(F.col("suffix").isNotNull(), F.concat("suffix", "__core")).otherwise(F.col("__norm"))).drop("__norm", "__prefix", "__core", "suffix")


def extract_references(docs: DataFrame) -> DataFrame:
    """T16x: doc (id, body) -> ordered distinct references (id, ref, pos): book quotes, then numbers."""
    both = F.array_distinct(F.concat(T.named_refs(F.col("body")), T.formal_refs(F.col("body"))))
    return docs.select("id", F.posexplode(both).alias("pos", "ref")).select("id", "ref", "pos")


def build_citations(docs: DataFrame, sites: DataFrame) -> DataFrame:
    """T14x: docs (id, site_key, title, number, body, references array) and sites (site_key, admin_level) ->
    source_id, target_ref, target_id, citation_type, source_level, target_level.

    Texts are read once: what was extracted is written. So is what each later step finds (vocabulary, canonical forms, edges
    by number, names, their titles, all edges), so the driver plans one step at a time, a query on the edges
    plans none of the builder, and nothing is computed twice. Kinds are formal, named and llm. References to the document
    itself don't count; an llm reference that the patterns found too doesn't either.

    What grows with the corpus meets by merging: Spark takes the size of packed files, before lists are unfolded, for that of
    the rows, and sent hundreds of MB to the driver to broadcast them.
    """
    leveled = docs.join(sites.select("site_key", "admin_level"), "site_key", "left")
    extracted = [F.array_distinct(T.formal_refs(F.col("body"))).alias("formal"), F.array_distinct(T.named_refs(F.col("body"))).alias("named"), F.array_distinct("references").alias("references")]
    base = materialize(leveled.select("id", "number", "title", T.source_level(F.col("number"), F.col("admin_level")).alias("source_level"), T.norm_title(F.col("title")).alias("own"), *extracted), "extracted")
    docs = base.select("id", "number", "title")
    keys = docs.select("id", F.coalesce("number", F.lit("")).alias("number"), T.norm_docnum(F.col("number")).alias("number_norm"))
    titles = docs.select(T.norm_title(F.col("title")).alias("title"), "id").filter("title <> ''")

    raw = base.select(F.col("id").alias("source_id"), F.coalesce("number", F.lit("")).alias("own_number"), "source_level", F.explode("formal").alias("ref"))
    refs = materialize(raw.select("ref").distinct(), "references")
    known = materialize(known_abbreviations(keys, refs), "abbreviations")
    canonical = materialize(canonical_refs(refs, known).select("ref", "canonical"), "canonical-references")
    formal = raw.join(canonical.hint("merge"), "ref").filter(F.col("canonical") != F.col("own_number"))
    formal = two_keys(formal.select("source_id", F.col("canonical").alias("target_ref"), "source_level").distinct(), keys, F.col("target_ref"), T.norm_docnum(F.col("target_ref")))
    formal = materialize(formal, "formal-references").filter("target_id is null or target_id <> source_id").withColumn("citation_type", F.lit("formal")).withColumn("target_level", T.admin_level(F.col("target_ref")))

    named = base.select(F.col("id").alias("source_id"), "own", "source_level", F.explode("named").alias("target_ref")).filter(T.is_policy(F.col("target_ref"))).withColumn("citation_type", F.lit("named"))
    told = base.select(F.col("id").alias("source_id"), "own", "source_level", F.explode("references").alias("target_ref")).filter(F.length("target_ref") >= 4)
    told = told.join(named.select("source_id", "target_ref").hint("merge"), ["source_id", "target_ref"], "left_anti").join(formal.select("source_id", "target_ref").hint("merge"), ["source_id", "target_ref"], "left_anti").withColumn("citation_type", F.lit("llm"))
    names = named.unionByName(told).withColumn("name", T.norm_title(F.col("target_ref"))).filter(F.col("name") != F.col("own"))
    names = materialize(names, "named-references")
    found = materialize(resolve_titles(names.select("name"), titles), "resolved-titles")
    by_name = names.join(found.select("name", F.col("id").alias("target_id")).hint("merge"), "name", "left").filter("target_id is null or target_id <> source_id").withColumn("target_level", T.named_level(F.col("target_ref")))

    columns = ["source_id", "target_ref", "target_id", "citation_type", "source_level", "target_level"]
    return materialize(formal.select(*columns).unionByName(by_name.select(*columns)).dropDuplicates(["source_id", "target_ref", "citation_type"]), "citations")


def citation_rank(edges: DataFrame, weights: dict[str, float] = L.LEVEL_WEIGHTS) -> DataFrame:
    """Weighted inbound citations of each target; edges without a target don't count. Counted before weighing, so a
    target with many citations costs a row a level and task."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    counts = edges.filter("target_id is not null").groupBy("target_id", "source_level").agg(F.count("*").alias("n"))
    return counts.groupBy("target_id").agg(F.sum(F.col("n") * F.coalesce(table[F.coalesce("source_level", F.lit(""))], F.lit(0.5))).alias("citation_rank"))


def citation_gaps(edges: DataFrame, held: DataFrame, samples: int = 5) -> DataFrame:
    """Unresolved references by issuer, or by level where only a name is known: n, level, crawled (the issuer has documents
    in held (number)), counts by type, and the first samples, joined by |."""
    issuer = F.when(F.col("citation_type") == "formal", T.issuer(F.col("target_ref"))).otherwise(F.concat(F.lit("Unknown ("), F.col("target_level"), F.lit(")")))
    each = edges.filter("target_id is null").groupBy(issuer.alias("issuer"), "target_ref").agg(F.count("*").alias("n"), F.min("target_level").alias("level"), *[F.count_if(F.col("citation_type") == k).alias(k) for k in ("formal", "named", "llm")])
    known = held.filter("number <> ''").select(T.issuer(F.col("number")).alias("issuer")).distinct().withColumn("crawled", F.lit(True))
    numbered = each.withColumn("k", F.row_number().over(Window.partitionBy("issuer").orderBy("target_ref")))
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.col("target_ref")))), "|").alias("samples")
    sums = numbered.groupBy("issuer").agg(F.sum("n").alias("n"), F.min("level").alias("level"), *[F.sum(k).alias(k) for k in ("formal", "named", "llm")], first)
    return sums.join(known, "issuer", "left").withColumn("crawled", F.coalesce("crawled", F.lit(False)))


def compare_extractors(refs: DataFrame, safe: float = 0.8, useful: float = 0.5) -> DataFrame:
    """Refs (id, model array, pattern array) -> one row of totals over normalised references: what both found, the mean
    Jaccard similarity of documents that have any, the patterns' recall of the model's references, and a verdict."""
    norm = lambda c: F.array_distinct(F.transform(c, lambda r: T.normalize_ref(r)))
    x = refs.select(norm("model").alias("m"), norm("pattern").alias("r"))
    both, union = F.size(F.array_intersect("m", "r")), F.size(F.array_union("m", "r"))
    sums = x.agg(F.count("*").alias("docs"), F.sum(F.size("m")).alias("model_refs"), F.sum(F.size("r")).alias("pattern_refs"), F.sum(both).alias("both_refs"), F.round(F.avg(F.when(union > 0, both / union)), 6).alias("jaccard"))
    recall = F.col("both_refs") / F.greatest("model_refs", F.lit(1))
    verdict = F.when(recall >= safe, "patterns").when(recall >= useful, "hybrid").otherwise("model")
    return sums.select("*", (F.col("model_refs") - F.col("both_refs")).alias("model_only"), (F.col("pattern_refs") - F.col("both_refs")).alias("pattern_only"), F.round(recall, 6).alias("recall"), verdict.alias("verdict"))
