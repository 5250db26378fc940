"""Aggregate reports, sorts and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import lexicons as L
from lexweave.operators.citations import citation_rank
from lexweave.plans import standins as S
from lexweave.plans.standins import CAREERS, CHANGES, DOCUMENTS, EDGES, ITEMS, SITES, with_

BOOK = S.Book()
query = BOOK.query
n_of = lambda test, name: F.count_if(test).alias(name)


@query(with_(DOCUMENTS) + "SELECT count(*) AS total, count(*) FILTER (body <> '') AS with_body, count(*) FILTER (document_number <> '') AS with_number FROM docs")
def a01_corpus_totals(spark, sf):
    return S.documents(spark, sf).agg(F.count("*").alias("total"), n_of(F.col("body") != "", "with_body"), n_of(F.col("document_number") != "", "with_number"))


@query(with_(DOCUMENTS, SITES) + "SELECT s.site_key, s.name, count(d.id) AS docs, count(*) FILTER (length(body) > 500) AS long_body, count(*) FILTER (document_number <> '') AS numbered FROM sites s LEFT JOIN docs d USING (site_key) GROUP BY 1, 2")
def a02_site_counts(spark, sf):
    counts = S.documents(spark, sf).groupBy("site_key").agg(F.count("id").alias("docs"), n_of(F.length("body") > 500, "long_body"), n_of(F.col("document_number") != "", "numbered"))
    return S.sites(spark, sf).join(counts, "site_key", "left").select("site_key", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "long_body", "numbered")])


@query(with_(DOCUMENTS) + "SELECT category, count(*) AS n FROM docs GROUP BY 1")
def a03_category_frequency(spark, sf):
    return S.documents(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2030 GROUP BY 1")
def a04_year_histogram(spark, sf):
    return S.read(spark, sf, "orders").filter(F.year("o_orderdate").between(1995, 2030)).groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, CASE CAST(ts AS DATE) WHEN DATE '2024-01-30' THEN 'Today' WHEN DATE '2024-01-29' THEN 'Yesterday' ELSE strftime(ts, '%Y-%m-%d') END AS label, count(*) AS n FROM events GROUP BY 1, 2")
def a05_inbox_days(spark, sf):
    day = F.to_date("ts")
    label = F.when(day == F.lit("2024-01-30").cast("date"), "Today").when(day == F.lit("2024-01-29").cast("date"), "Yesterday").otherwise(day.cast("string"))
    return S.read(spark, sf, "events").groupBy(day.alias("day"), label.alias("label")).agg(F.count("*").alias("n"))


@query(with_(EDGES) + "SELECT source_level, target_level, count(*) AS n FROM edges GROUP BY 1, 2")
def a06_level_flow(spark, sf):
    return S.edges(spark, sf).groupBy("source_level", "target_level").agg(F.count("*").alias("n"))


@query(with_(EDGES) + "SELECT source_level, " + ", ".join(f"count(*) FILTER (target_level = '{x}') AS to_{x}" for x in ("central", "provincial", "municipal", "district", "unknown")) + " FROM edges GROUP BY 1")
def a06_level_matrix(spark, sf):
    levels = ["central", "provincial", "municipal", "district", "unknown"]
    wide = S.edges(spark, sf).groupBy("source_level").pivot("target_level", levels).agg(F.count(F.lit(1)))
    return wide.select("source_level", *[F.coalesce(x, F.lit(0)).alias(f"to_{x}") for x in levels])


@query(with_(EDGES) + "SELECT target_level, count(*) AS n FROM edges GROUP BY 1")
def a07_cited_levels(spark, sf):
    return S.edges(spark, sf).groupBy("target_level").agg(F.count("*").alias("n"))


@query(with_(EDGES) + "SELECT target_ref, count(*) AS n, count(target_id) > 0 AS resolved, max(target_id) AS target_id FROM edges GROUP BY 1 ORDER BY n DESC, target_ref LIMIT 20")
def a08_top_cited(spark, sf):
    return S.edges(spark, sf).groupBy("target_ref").agg(F.count("*").alias("n"), (F.count("target_id") > 0).alias("resolved"), F.max("target_id").alias("target_id")).orderBy(F.desc("n"), "target_ref").limit(20)


_WEIGHT = "CASE source_level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.LEVEL_WEIGHTS.items()) + " ELSE 0.5 END"


@query(with_(EDGES) + f"SELECT target_id, CAST(sum(CAST({_WEIGHT} AS DOUBLE)) AS DOUBLE) AS citation_rank FROM edges WHERE target_id IS NOT NULL GROUP BY 1")
def a09_citation_rank(spark, sf):
    return citation_rank(S.edges(spark, sf))


@query(with_(EDGES) + f", r AS (SELECT target_id, sum(CAST({_WEIGHT} AS DOUBLE)) AS r FROM edges WHERE target_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN r >= 60 THEN 'high' WHEN r >= 45 THEN 'medium' WHEN r >= 30 THEN 'low' ELSE 'minimal' END AS bucket, count(*) AS n, count(*) FILTER (target_id % 2 = 0) AS even_ids FROM r GROUP BY 1")
def a10_rank_buckets(spark, sf):
    r = F.col("citation_rank")
    bucket = F.when(r >= 60, "high").when(r >= 45, "medium").when(r >= 30, "low").otherwise("minimal")
    return citation_rank(S.edges(spark, sf)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), n_of(F.col("target_id") % 2 == 0, "even_ids"))


@query(with_(CHANGES) + "SELECT sync_run_id, min(detected_at) AS started, count(*) AS total, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'modified') AS modified, count(*) FILTER (change_type = 'deleted') AS deleted FROM changes GROUP BY 1")
def a11_run_summary(spark, sf):
    from lexweave.operators.changes import run_summary

    return run_summary(S.changes(spark, sf))


@query(with_(CHANGES) + "SELECT count(*) AS total, count(DISTINCT sync_run_id) AS runs, count(DISTINCT site_key) AS sites, count(*) FILTER (change_type = 'added') AS added FROM changes")
def a12_change_totals(spark, sf):
    return S.changes(spark, sf).agg(F.count("*").alias("total"), F.count_distinct("sync_run_id").alias("runs"), F.count_distinct("site_key").alias("sites"), n_of(F.col("change_type") == "added", "added"))


@query(with_(CHANGES) + "SELECT site_key, change_type, count(*) AS n FROM changes GROUP BY 1, 2")
def a13_changes_by_site(spark, sf):
    return S.changes(spark, sf).groupBy("site_key", "change_type").agg(F.count("*").alias("n"))


@query(with_(ITEMS) + "SELECT count(DISTINCT document_id) AS docs, count(*) AS items, CAST(sum(amount) AS BIGINT) AS total, CAST(sum(amount) AS DOUBLE) / 10000 AS total_large FROM items")
def a14_amount_totals(spark, sf):
    return S.items(spark, sf).agg(F.count_distinct("document_id").alias("docs"), F.count("*").alias("items"), F.sum("amount").alias("total"), (F.sum("amount").cast("double") / 10000).alias("total_large"))


@query(with_(ITEMS) + "SELECT site_key, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total, max(amount) AS most, round(CAST(sum(amount) AS DOUBLE) / count(*), 4) AS mean FROM items GROUP BY 1")
def a15_amounts_by_site(spark, sf):
    return S.items(spark, sf).groupBy("site_key").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.max("amount").alias("most"), F.round(F.sum("amount").cast("double") / F.count("*"), 4).alias("mean"))


@query(with_(ITEMS) + "SELECT sector, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total, count(DISTINCT document_id) AS docs FROM items GROUP BY 1")
def a16_amounts_by_sector(spark, sf):
    return S.items(spark, sf).groupBy("sector").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.count_distinct("document_id").alias("docs"))


@query(with_(ITEMS) + "SELECT strftime(day, '%Y') AS year, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM items GROUP BY 1 HAVING strftime(day, '%Y') >= '1995'")
def a17_amounts_by_year(spark, sf):
    year = F.substring(F.col("day").cast("string"), 1, 4)
    return S.items(spark, sf).groupBy(year.alias("year")).agg(F.count("*").alias("n"), F.sum("amount").alias("total")).filter("year >= '1995'")


@query(with_(ITEMS) + "SELECT document_id, count(*) AS n, string_agg(DISTINCT sector, ',' ORDER BY sector) AS sectors FROM items GROUP BY 1")
def a18_sectors_of_document(spark, sf):
    return S.items(spark, sf).groupBy("document_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("sector")), ",").alias("sectors"))


@query(with_(EDGES, ITEMS) + "SELECT target_ref, count(DISTINCT source_id) AS docs FROM edges WHERE target_level = 'central' AND source_id IN (SELECT document_id FROM items WHERE amount > 50000) GROUP BY 1")
def a19_directives_behind_amounts(spark, sf):
    rich = S.items(spark, sf).filter("amount > 50000").select(F.col("document_id").alias("source_id")).distinct()
    return S.edges(spark, sf).filter("target_level = 'central'").join(rich, "source_id", "left_semi").groupBy("target_ref").agg(F.count_distinct("source_id").alias("docs"))


@query(with_(EDGES) + "SELECT target_ref, count(*) AS n, count(DISTINCT source_level) AS levels, string_agg(DISTINCT source_level, ',' ORDER BY source_level) AS cited_by FROM edges WHERE target_level = 'central' GROUP BY 1")
def a20_central_refs(spark, sf):
    central = S.edges(spark, sf).filter("target_level = 'central'").groupBy("target_ref")
    return central.agg(F.count("*").alias("n"), F.count_distinct("source_level").alias("levels"), F.array_join(F.array_sort(F.collect_set("source_level")), ",").alias("cited_by"))


@query(with_(DOCUMENTS) + ", c AS (SELECT site_key, count(*) AS n FROM docs WHERE contains(body, 'the') GROUP BY 1) SELECT site_key, n, CAST((SELECT sum(n) FROM c) AS BIGINT) AS total, round(100.0::DOUBLE * n / (SELECT max(n) FROM c), 2) AS pct FROM c ORDER BY n DESC, site_key LIMIT 8")
def a21_term_by_site(spark, sf):
    counts = S.documents(spark, sf).filter(F.col("body").contains("the")).groupBy("site_key").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(whole)).select("site_key", "n", "total", F.round(F.lit(100.0) * F.col("n") / F.col("most"), 2).alias("pct")).orderBy(F.desc("n"), "site_key").limit(8)


@query("WITH t AS (SELECT DISTINCT p_partkey AS doc_id, p_brand AS item_id FROM part WHERE p_size > 20), c AS (SELECT item_id, count(*) AS n FROM t GROUP BY 1) SELECT b.item_id, coalesce(n, 0) AS n, round(100.0::DOUBLE * coalesce(n, 0) / (SELECT max(n) FROM c), 2) AS pct FROM (SELECT DISTINCT p_brand AS item_id FROM part) b LEFT JOIN c USING (item_id)")
def a22_taxonomy_coverage(spark, sf):
    part = S.read(spark, sf, "part")
    counts = part.filter("p_size > 20").groupBy(F.col("p_brand").alias("item_id")).agg(F.count("*").alias("n"))
    most = F.broadcast(counts.agg(F.max("n").alias("most")))
    return part.select(F.col("p_brand").alias("item_id")).distinct().join(counts, "item_id", "left").crossJoin(most).select("item_id", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.lit(100.0) * F.coalesce("n", F.lit(0)) / F.col("most"), 2).alias("pct"))


@query(with_(CAREERS) + ", p AS (SELECT person_id, province, min(start_m) AS first_m, max(end_m) AS last_m FROM careers GROUP BY 1, 2) SELECT person_id, count(*) AS provinces, CAST(min(first_m) AS INTEGER) AS first_m, CAST(max(last_m) AS INTEGER) AS last_m FROM p GROUP BY 1")
def a23_province_mobility(spark, sf):
    each = S.careers(spark, sf).groupBy("person_id", "province").agg(F.min("start_m").alias("first_m"), F.max("end_m").alias("last_m"))
    return each.groupBy("person_id").agg(F.count("*").alias("provinces"), F.min("first_m").alias("first_m"), F.max("last_m").alias("last_m"))


@query(with_(CAREERS) + "SELECT person_id, coalesce(nullif(organization, ''), province) AS place, CAST(floor(min(start_m) / 12) AS BIGINT) AS from_year, count(*) AS terms, string_agg(CAST(start_m AS VARCHAR), ',' ORDER BY start_m) AS periods FROM careers GROUP BY 1, 2")
def a24_career_places(spark, sf):
    place = F.coalesce(F.nullif(F.col("organization"), F.lit("")), F.col("province"))
    return S.careers(spark, sf).groupBy("person_id", place.alias("place")).agg(F.floor(F.min("start_m") / 12).alias("from_year"), F.count("*").alias("terms"), F.array_join(F.transform(F.array_sort(F.collect_list("start_m")), lambda m: m.cast("string")), ",").alias("periods"))


@query(with_(EDGES) + "SELECT substr(target_ref, 1, 2) AS cluster, count(*) AS refs, count(DISTINCT target_ref) AS distinct_refs, list_aggregate(list_slice(list_sort(list(DISTINCT target_ref)), 1, 3), 'string_agg', ',') AS samples FROM edges WHERE target_id IS NULL GROUP BY 1")
def a27_frontier_clusters(spark, sf):
    missing = S.edges(spark, sf).filter("target_id is null").groupBy(F.substring("target_ref", 1, 2).alias("cluster"), "target_ref").agg(F.count("*").alias("n"))
    top = missing.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("target_ref")))
    return top.groupBy("cluster").agg(F.sum("n").alias("refs"), F.count("*").alias("distinct_refs"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("target_ref")))), ",").alias("samples"))


@query(with_(EDGES) + "SELECT target_level, count(*) AS n, count(*) FILTER (citation_type = 'formal') AS formal, count(*) FILTER (citation_type = 'named') AS named, count(*) FILTER (citation_type = 'llm') AS llm FROM edges WHERE target_id IS NULL GROUP BY 1")
def a28_gaps_by_issuer(spark, sf):
    kinds = [n_of(F.col("citation_type") == k, k) for k in ("formal", "named", "llm")]
    return S.edges(spark, sf).filter("target_id is null").groupBy("target_level").agg(F.count("*").alias("n"), *kinds)


@query(with_(EDGES) + "SELECT citation_type, count(*) AS total, count(target_id) AS resolved, count(*) - count(target_id) AS dangling, round(100.0::DOUBLE * count(target_id) / count(*), 3) AS pct FROM edges GROUP BY 1")
def a29_resolution_by_type(spark, sf):
    return S.edges(spark, sf).groupBy("citation_type").agg(F.count("*").alias("total"), F.count("target_id").alias("resolved"), (F.count("*") - F.count("target_id")).alias("dangling"), F.round(F.lit(100.0) * F.count("target_id") / F.count("*"), 3).alias("pct"))


@query(with_(EDGES) + "SELECT count(*) AS refs, count(*) FILTER (held) AS found, round(avg(CASE WHEN held THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM (SELECT target_ref, bool_or(target_id IS NOT NULL) AS held FROM edges GROUP BY 1)")
def a30_resolution_rate(spark, sf):
    refs = S.edges(spark, sf).groupBy("target_ref").agg(F.bool_or(F.col("target_id").isNotNull()).alias("held"))
    return refs.agg(F.count("*").alias("refs"), F.count_if("held").alias("found"), F.round(F.avg(F.col("held").cast("double")), 6).alias("rate"))


@query("SELECT 'R' || r_regionkey AS branch, count(*) AS customers, round(sum(CAST(c_acctbal AS DOUBLE)), 2) AS balance FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'N' || n_nationkey, count(*), round(sum(CAST(c_acctbal AS DOUBLE)), 2) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'root', count(*), round(sum(CAST(c_acctbal AS DOUBLE)), 2) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def a31_hierarchy_rollup(spark, sf):
    from lexweave.operators.graph import rollup

    nation, region = S.read(spark, sf, "nation"), S.read(spark, sf, "region")
    tree = nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    tree = tree.unionByName(region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("root").alias("parent_id"))).unionByName(spark.createDataFrame([("root", None)], "id string, parent_id string"))
    facts = S.read(spark, sf, "customer").groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("leaf")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    return rollup(facts, "leaf", tree, [F.sum("n").alias("customers"), F.round(F.sum("b"), 2).alias("balance")]).withColumnRenamed("ancestor", "branch")


@query(with_(DOCUMENTS) + "SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (contains(title, 'the')) AS policy FROM docs GROUP BY 1")
def a32_collection_months(spark, sf):
    return S.documents(spark, sf).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), n_of(F.col("title").contains("the"), "policy"))


@query(with_(DOCUMENTS) + "SELECT site_key, count(*) AS docs, round(1.0::DOUBLE * count(*) FILTER (length(body) > 1000) / count(*), 4) AS ratio FROM docs GROUP BY 1 ORDER BY ratio, site_key LIMIT 10")
def a33_body_ratio_worst_first(spark, sf):
    return S.documents(spark, sf).groupBy("site_key").agg(F.count("*").alias("docs"), F.round(F.lit(1.0) * F.count_if(F.length("body") > 1000) / F.count("*"), 4).alias("ratio")).orderBy("ratio", "site_key").limit(10)


@query(with_(DOCUMENTS, SITES) + "SELECT admin_level, round(avg(CASE WHEN n > 45 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS covered, CASE WHEN sum(n) >= 5000 THEN 5 WHEN sum(n) >= 2000 THEN 4 WHEN sum(n) >= 500 THEN 3 WHEN sum(n) >= 100 THEN 2 WHEN sum(n) > 0 THEN 1 ELSE 0 END AS class FROM (SELECT s.site_key, admin_level, count(d.id) AS n FROM sites s LEFT JOIN docs d USING (site_key) GROUP BY 1, 2) GROUP BY 1")
def a34_coverage_by_level(spark, sf):
    """Share of covered sites and a size class."""
    n = S.documents(spark, sf).groupBy("site_key").agg(F.count("*").alias("n"))
    each = S.sites(spark, sf).join(n, "site_key", "left").fillna(0, "n")
    t = F.sum("n")
    size = F.when(t >= 5000, 5).when(t >= 2000, 4).when(t >= 500, 3).when(t >= 100, 2).when(t > 0, 1).otherwise(0)
    return each.groupBy("admin_level").agg(F.round(F.avg((F.col("n") > 45).cast("double")), 4).alias("covered"), size.alias("class"))


@query(with_(EDGES) + "SELECT count(*) FILTER (citation_type = 'formal') AS formal, count(*) FILTER (citation_type = 'named') AS named, count(*) FILTER (citation_type = 'llm') AS llm, count(DISTINCT target_ref) AS policies FROM edges")
def a35_chain_stats(spark, sf):
    return S.edges(spark, sf).agg(*[n_of(F.col("citation_type") == k, k) for k in ("formal", "named", "llm")], F.count_distinct("target_ref").alias("policies"))


@query("SELECT md5(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def a36_repeated_texts(spark, sf):
    return S.read(spark, sf, "documents").groupBy(F.md5("text").alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z]{8,10}')) AS b FROM documents) SELECT doc_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS both_n, CAST(len(a) - len(list_intersect(a, b)) AS INTEGER) AS only_a, CAST(len(b) - len(list_intersect(a, b)) AS INTEGER) AS only_b, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM t")
def a37_extractor_comparison(spark, sf):
    low = F.lower("text")
    t = S.read(spark, sf, "documents").select("doc_id", *[F.array_distinct(F.regexp_extract_all(low, F.lit(p), F.lit(0))).alias(n) for n, p in (("a", "[a-z]{9,}"), ("b", "[a-z]{8,10}"))])
    both = F.size(F.array_intersect("a", "b"))
    union = F.size(F.array_union("a", "b"))
    return t.select("doc_id", both.alias("both_n"), F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_except("b", "a")).alias("only_b"), F.round(F.when(union == 0, 1.0).otherwise(both / union), 6).alias("jaccard"))


@query("SELECT d.lang, count(*) AS n, round(avg(CASE WHEN (regexp_matches(text, '[|$%&#*]|!!')) = (quality = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM documents d JOIN labels l USING (doc_id) GROUP BY 1")
def a38_rule_accuracy(spark, sf):
    d = S.read(spark, sf, "documents").join(S.read(spark, sf, "labels"), "doc_id")
    right = F.col("text").rlike(r"[|$%&#*]|!!") == (F.col("quality") == 0)
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a40_status_counts(spark, sf):
    return S.read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(with_(DOCUMENTS) + " , terms AS (SELECT unnest(['the', 'die', 'queen', 'zzz']) AS term) SELECT term, count(*) FILTER (contains(title, term)) AS titles, count(*) FILTER (contains(body, term)) AS bodies FROM terms, docs GROUP BY 1")
def a41_keyword_hits(spark, sf):
    """One pass counts all terms; the terms' rows come from the one result row."""
    terms = ["the", "die", "queen", "zzz"]
    wide = S.documents(spark, sf).agg(*[F.struct(F.lit(t).alias("term"), F.count_if(F.col("title").contains(t)).alias("titles"), F.count_if(F.col("body").contains(t)).alias("bodies")).alias(f"t{i}") for i, t in enumerate(terms)])
    return wide.select(F.inline(F.array(*[F.col(f"t{i}") for i in range(len(terms))])))


@query(with_(EDGES) + "SELECT target_ref, count(*) AS n FROM edges WHERE target_id IS NULL AND citation_type = 'named' AND length(target_ref) BETWEEN 3 AND 5 GROUP BY 1 ORDER BY n DESC, target_ref LIMIT 50")
def a43_top_dangling(spark, sf):
    e = S.edges(spark, sf).filter(F.col("target_id").isNull() & (F.col("citation_type") == "named") & F.length("target_ref").between(3, 5))
    return e.groupBy("target_ref").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_ref").limit(50)


@query(with_(DOCUMENTS, SITES) + "SELECT s.site_key, admin_level, count(d.id) AS docs, count(*) FILTER (document_number <> '') AS numbered FROM sites s LEFT JOIN docs d USING (site_key) GROUP BY 1, 2")
def a44_site_inventory(spark, sf):
    n = S.documents(spark, sf).groupBy("site_key").agg(F.count("*").alias("docs"), n_of(F.col("document_number") != "", "numbered"))
    return S.sites(spark, sf).join(n, "site_key", "left").select("site_key", "admin_level", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("numbered", F.lit(0)).alias("numbered"))


@query("SELECT CASE WHEN r > 0.05 THEN 'accented' ELSE 'plain' END AS kind, count(*) AS n FROM (SELECT CAST(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS DOUBLE) / greatest(length(text), 1) AS r FROM documents) GROUP BY 1")
def a45_language_split(spark, sf):
    r = F.length(F.regexp_replace("text", r"[\x00-\x7F]", "")) / F.greatest(F.length("text"), F.lit(1))
    return S.read(spark, sf, "documents").groupBy(F.when(r > 0.05, "accented").otherwise("plain").alias("kind")).agg(F.count("*").alias("n"))


# Windows and sorts


@query("SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) AS k FROM documents) WHERE k = 1")
def w1_longest_per_key(spark, sf):
    from lexweave.operators.joins import keep_first

    return keep_first(S.read(spark, sf, "documents").withColumn("len", F.length("text")), ["source", "lang"], [F.desc("len"), F.col("doc_id")]).select("doc_id", "lang", "n_chars")


@query(with_(CAREERS) + "SELECT person_id, organization, term, start_m, CAST(coalesce(end_m, lead(start_m) OVER (PARTITION BY person_id ORDER BY start_m, organization, term)) AS INTEGER) AS end_m FROM careers")
def w2_end_from_next(spark, sf):
    nxt = F.lead("start_m").over(Window.partitionBy("person_id").orderBy("start_m", "organization", "term"))
    return S.careers(spark, sf).select("person_id", "organization", "term", "start_m", F.coalesce("end_m", nxt).alias("end_m"))


@query(with_(EDGES) + "SELECT target_ref, arg_min(source_level, source_id * 100 + CASE citation_type WHEN 'formal' THEN 0 WHEN 'named' THEN 1 ELSE 2 END) AS first_level FROM edges GROUP BY 1")
def w3_first_level(spark, sf):
    kind = F.when(F.col("citation_type") == "formal", 0).when(F.col("citation_type") == "named", 1).otherwise(2)
    return S.edges(spark, sf).groupBy("target_ref").agg(F.min_by("source_level", F.col("source_id") * 100 + kind).alias("first_level"))


@query("SELECT d.doc_id, coalesce(n, 0) AS words_n, md5(coalesce(words, '')) AS words_md5 FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS words FROM (SELECT doc_id, word, min(place) AS place FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)) GROUP BY 1, 2) GROUP BY 1) USING (doc_id)")
def w4_ordered_distinct(spark, sf):
    """Distinct words of the whole text in the order of their first places."""
    words = F.array_distinct(F.split(F.lower("text"), " "))
    return S.read(spark, sf, "documents").select("doc_id", F.coalesce(F.greatest(F.size(words), F.lit(0)), F.lit(0)).cast("long").alias("words_n"), F.md5(F.coalesce(F.array_join(words, " "), F.lit(""))).alias("words_md5"))


@query("WITH c AS (SELECT source, count(*) FILTER (lang = 'en') AS n FROM documents GROUP BY 1) SELECT source, n, round(100.0::DOUBLE * n / max(n) OVER (), 3) AS pct FROM c")
def w5_percent_of_max(spark, sf):
    c = S.read(spark, sf, "documents").groupBy("source").agg(n_of(F.col("lang") == "en", "n"))
    return c.crossJoin(F.broadcast(c.agg(F.max("n").alias("most")))).select("source", "n", F.round(F.lit(100.0) * F.col("n") / F.col("most"), 3).alias("pct"))


@query("SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5 GROUP BY 1")
def w6_samples_per_group(spark, sf):
    d = S.read(spark, sf, "documents").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("k <= 5")
    return d.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("samples"))


@query("SELECT conv_id, turn, role, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), true) AS breaks FROM conversations")
def w7_group_breaks(spark, sf):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return S.read(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce(F.col("role") != before, F.lit(True)).alias("breaks"))


@query(with_(EDGES) + "SELECT row_number() OVER (ORDER BY n DESC, target_ref) AS place, target_ref, n FROM (SELECT target_ref, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, target_ref LIMIT 25)")
def w8_numbered_top_list(spark, sf):
    top = S.edges(spark, sf).groupBy("target_ref").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_ref").limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "target_ref")).cast("long")).select("place", "target_ref", "n")


@query(with_(CHANGES) + ", c AS (SELECT sync_run_id, count(*) AS n FROM changes GROUP BY 1) SELECT sync_run_id, n, n - lag(n) OVER (ORDER BY sync_run_id) AS delta FROM c")
def w9_count_delta(spark, sf):
    c = S.changes(spark, sf).groupBy("sync_run_id").agg(F.count("*").alias("n"))  # a row per run: ordered in one task
    return c.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("sync_run_id")))


@query(with_(DOCUMENTS) + "SELECT id, site_key, day FROM docs ORDER BY day DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def o2_page_of_documents(spark, sf):
    return S.documents(spark, sf).select("id", "site_key", "day").orderBy(F.desc_nulls_last("day"), "id").offset(40).limit(20)


@query(with_(DOCUMENTS) + "SELECT id, CASE WHEN contains(title, 'the') THEN 0 WHEN document_number <> '' THEN 1 WHEN contains(body, 'ing') THEN 2 ELSE 3 END AS bucket FROM docs ORDER BY bucket, day DESC, id LIMIT 50")
def o3_bucketed_sort(spark, sf):
    bucket = F.when(F.col("title").contains("the"), 0).when(F.col("document_number") != "", 1).when(F.col("body").contains("ing"), 2).otherwise(3)
    return S.documents(spark, sf).select("id", bucket.alias("bucket"), "day").orderBy("bucket", F.desc("day"), "id").limit(50).select("id", "bucket")


@query("SELECT p_partkey, round(2 * p_retailprice + 0.05 * p_size, 4) AS priority FROM part ORDER BY 2 * p_retailprice + 0.05 * p_size DESC, p_partkey LIMIT 30")
def o4_expression_sort(spark, sf):
    e = 2 * F.col("p_retailprice") + 0.05 * F.col("p_size")
    return S.read(spark, sf, "part").select("p_partkey", F.round(e, 4).alias("priority"), e.alias("e")).orderBy(F.desc("e"), "p_partkey").limit(30).select("p_partkey", "priority")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY (o_orderpriority = '2-HIGH') DESC, o_orderdate DESC, o_orderkey LIMIT 40")
def o5_boolean_first(spark, sf):
    return S.read(spark, sf, "orders").orderBy((F.col("o_orderpriority") == "2-HIGH").desc(), F.desc("o_orderdate"), "o_orderkey").limit(40).select("o_orderkey", "o_orderpriority")


@query(with_(ITEMS) + "SELECT document_id, sector, amount FROM items ORDER BY amount DESC, document_id, sector LIMIT 25")
def o6_largest_amounts(spark, sf):
    return S.items(spark, sf).select("document_id", "sector", "amount").orderBy(F.desc("amount"), "document_id", "sector").limit(25)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 2 END AS ord FROM orders ORDER BY ord, o_orderdate DESC, o_orderkey LIMIT 30")
def o11_ordinal_sort(spark, sf):
    ord_ = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return S.read(spark, sf, "orders").select("o_orderkey", ord_.alias("ord"), "o_orderdate").orderBy("ord", F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey", "ord")


@query("WITH l(label, i) AS (VALUES ('BUILDING', 0), ('MACHINERY', 1)) SELECT c_mktsegment, count(*) AS n, CAST(coalesce(max(i), 999) AS INTEGER) AS idx FROM customer LEFT JOIN l ON label = c_mktsegment GROUP BY 1")
def o10_label_order(spark, sf):
    labels = spark.createDataFrame([("BUILDING", 0), ("MACHINERY", 1)], "label string, i int")
    c = S.read(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(labels), F.col("label") == F.col("c_mktsegment"), "left").select("c_mktsegment", "n", F.coalesce("i", F.lit(999)).alias("idx")).orderBy("idx", "c_mktsegment")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, source DESC, lang LIMIT 15")
def o13_report_sort(spark, sf):
    return S.read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("source"), "lang").limit(15)
