"""Filters, joins, set operations, changes, writes, graph and search on the driver's tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.operators import changes as C
from lexweave.operators import filters as FI
from lexweave.operators import graph as G
from lexweave.operators import joins as J
from lexweave.operators import search as Q
from lexweave.operators.citations import citation_rank
from lexweave.plans import standins as S
from lexweave.plans.standins import CAREERS, CHANGES, DOCUMENTS, EDGES, ITEMS, SITES, with_
from lexweave.session import shared_dir
from lexweave.sources.sinks import exists

BOOK = S.Book()
query = BOOK.query


def passages(spark, sf):
    d = S.read(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text", "lang")
    b = S.read(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return d, b


@query("SELECT item_id, count(DISTINCT doc_id) AS cited_by, CAST(sum(CASE lang WHEN 'en' THEN 3.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 1.5 ELSE 1.0 END) AS DOUBLE) AS citation_rank FROM (SELECT DISTINCT d.doc_id, d.lang, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)) GROUP BY 1 ORDER BY citation_rank DESC, item_id LIMIT 10")
def cited_passages_ranked(spark, sf):
    """The flagship: containment edges from documents to passages, weighted in-degree, top list."""
    d, b = passages(spark, sf)
    edges = J.contained_passages(d, b).join(d.select("text_id", "lang"), "text_id").distinct()
    weight = F.when(F.col("lang") == "en", 3.0).when(F.col("lang") == "de", 2.0).when(F.col("lang") == "fr", 1.5).otherwise(1.0)
    rank = edges.groupBy(F.col("passage_id").alias("item_id")).agg(F.count_distinct("text_id").alias("cited_by"), F.sum(weight).alias("citation_rank"))
    return rank.orderBy(F.desc("citation_rank"), "item_id").limit(10)


@query("SELECT DISTINCT d.doc_id AS text_id, b.item_id AS passage_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def j12_contained_passages(spark, sf):
    return J.contained_passages(*passages(spark, sf))


@query(with_(DOCUMENTS) + "SELECT id, site_key, day FROM docs WHERE site_key IN ('src1', 'src2', 'src3') AND category = 'en' AND day >= DATE '2016-01-01' AND day < DATE '2017-01-01' AND document_number <> ''")
def f01_document_filter(spark, sf):
    return FI.document_filter(S.documents(spark, sf), sites=["src1", "src2", "src3"], category="en", year=2016, has_number=True).select("id", "site_key", "day")


@query(with_(DOCUMENTS) + "SELECT id, day FROM docs WHERE day >= DATE '2016-03-01' AND day < DATE '2016-06-01'")
def f02_half_open_range(spark, sf):
    return FI.document_filter(S.documents(spark, sf), year=1999, start="2016-03-01", end="2016-06-01").select("id", "day")


@query(with_(DOCUMENTS, SITES) + "SELECT id, site_key FROM docs WHERE site_key IN (SELECT site_key FROM sites WHERE admin_level <> 'media')")
def f03_source_type(spark, sf):
    official = S.sites(spark, sf).filter("admin_level <> 'media'")
    return S.documents(spark, sf).join(official, "site_key", "left_semi").select("id", "site_key")


@query(with_(DOCUMENTS) + "SELECT id FROM docs WHERE site_key NOT IN ('src0', 'src4')")
def f04_excluded_sites(spark, sf):
    return FI.document_filter(S.documents(spark, sf), not_sites=["src0", "src4"]).select("id")


@query("SELECT p_partkey FROM part WHERE coalesce(nullif(p_type, 'SMALL'), '') IN ('', 'other')")
def f05_untyped(spark, sf):
    return S.read(spark, sf, "part").filter(FI.untyped(F.nullif(F.col("p_type"), F.lit("SMALL")))).select("p_partkey")


@query(with_(DOCUMENTS) + "SELECT id FROM docs WHERE contains(lower(title), 'tion the') OR contains(lower(title), '100%') OR contains(lower(body), 'tion the') OR contains(lower(body), '100%')")
def f06_any_term(spark, sf):
    return S.documents(spark, sf).filter(FI.any_term(["title", "body"], ["TION the", "100%"])).select("id")


@query(with_(DOCUMENTS) + "SELECT id FROM docs WHERE contains(title, 'zz') OR (contains(title, 'the') AND contains(title, 'and'))")
def f07_any_or_pairs(spark, sf):
    return S.documents(spark, sf).filter(FI.any_or_pairs(F.col("title"), ["zz"], [("the", "and")])).select("id")


@query(with_(DOCUMENTS) + "SELECT count(*) AS n FROM docs WHERE contains(body, 'the') AND contains(body, 'with') AND contains(body, 'from')")
def f08_all_terms(spark, sf):
    return S.documents(spark, sf).filter(FI.all_terms(F.col("body"), ["the", "with", "from"])).agg(F.count("*").alias("n"))


@query(with_(DOCUMENTS) + "SELECT id FROM docs WHERE (contains(title, 'ing') OR category = 'es') AND length(body) > 2000")
def f09_keyword_category_length(spark, sf):
    return S.documents(spark, sf).filter((F.col("title").contains("ing") | (F.col("category") == "es")) & FI.has_body(F.col("body"), 2001)).select("id")


@query(with_(DOCUMENTS) + "SELECT id, contains(title, 'the') AS policy, contains(title, 'ing') OR (contains(title, 'and') AND contains(body, 'License')) AS focus FROM docs WHERE contains(title, 'the') OR contains(title, 'ing') OR (contains(title, 'and') AND contains(body, 'License'))")
def f10_collection(spark, sf):
    policy, focus = F.col("title").contains("the"), F.col("title").contains("ing") | (F.col("title").contains("and") & F.col("body").contains("License"))
    return S.documents(spark, sf).filter(policy | focus).select("id", policy.alias("policy"), focus.alias("focus"))


@query(with_(DOCUMENTS) + "SELECT id FROM docs WHERE length(body) < 400 AND regexp_matches(body, 'License|Licensed|CC BY')")
def f11_stubs(spark, sf):
    from lexweave.functions.html import is_stub

    return S.documents(spark, sf).filter(is_stub(F.col("body"), "License|Licensed|CC BY", 400)).select("id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def f13_unprocessed(spark, sf):
    return FI.unprocessed(S.read(spark, sf, "documents"), S.read(spark, sf, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def f15_processed(spark, sf):
    return FI.processed(S.read(spark, sf, "documents"), S.read(spark, sf, "labels").filter("toxic = 1"), "doc_id").select("doc_id")


@query("SELECT p_partkey FROM part WHERE NOT contains(p_name, p_type) AND NOT contains(p_type, p_name)")
def f16_not_self(spark, sf):
    return S.read(spark, sf, "part").filter(FI.not_self(F.col("p_name"), F.col("p_type"))).select("p_partkey")


@query("SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 260) AS snippet FROM documents")
def f20_snippets(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", T.flatten(F.col("text")).alias("snippet"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 100000")
def f21_parameters(spark, sf):
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_orderstatus = :status AND o_totalprice >= :least", args={"status": "P", "least": 100000}, orders=S.read(spark, sf, "orders"))


@query(with_(DOCUMENTS, SITES) + "SELECT d.id, s.name, s.admin_level FROM docs d JOIN sites s USING (site_key)")
def j01_documents_sites(spark, sf):
    return S.documents(spark, sf).join(S.sites(spark, sf), "site_key").select("id", "name", "admin_level")


@query(with_(EDGES) + "SELECT source_id, target_ref, p_name FROM edges LEFT JOIN part ON target_id = p_partkey")
def j03_targets(spark, sf):
    part = S.read(spark, sf, "part")
    return S.edges(spark, sf).join(part, F.col("target_id") == part.p_partkey, "left").select("source_id", "target_ref", "p_name")


@query(with_(EDGES) + "SELECT source_id, target_ref, o_orderstatus FROM edges JOIN orders ON source_id = o_orderkey WHERE source_level = 'central'")
def j04_sources(spark, sf):
    orders = S.read(spark, sf, "orders")
    return S.edges(spark, sf).filter("source_level = 'central'").join(orders, F.col("source_id") == orders.o_orderkey).select("source_id", "target_ref", "o_orderstatus")


@query(with_(CHANGES, DOCUMENTS, SITES) + "SELECT c.document_id, c.change_type, d.category, s.name FROM changes c LEFT JOIN docs d ON c.document_id = d.id LEFT JOIN sites s ON c.site_key = s.site_key")
def j05_change_feed(spark, sf):
    c, d, s = S.changes(spark, sf), S.documents(spark, sf).select("id", "category"), S.sites(spark, sf).select("site_key", "name")
    return c.join(d, c.document_id == d.id, "left").join(s, "site_key", "left").select("document_id", "change_type", "category", "name")


@query(with_(ITEMS) + "SELECT i.document_id, o_orderstatus, n_regionkey, amount FROM items i JOIN orders ON document_id = o_orderkey JOIN nation ON site_key = n_name WHERE amount > 90000")
def j06_items_documents_sites(spark, sf):
    i, o, n = S.items(spark, sf).filter("amount > 90000"), S.read(spark, sf, "orders"), S.read(spark, sf, "nation")
    return i.join(o, i.document_id == o.o_orderkey).join(n, i.site_key == n.n_name).select("document_id", "o_orderstatus", "n_regionkey", "amount")


_PAIRS = """pairs AS (SELECT organization AS grp, person_a AS a, person_b AS b, from_m, to_m, to_m - from_m AS months FROM (
 SELECT x.organization, x.person_id AS person_a, y.person_id AS person_b, greatest(x.start_m, y.start_m) AS from_m, least(coalesce(x.end_m, x.start_m + 48), coalesce(y.end_m, y.start_m + 48)) AS to_m
 FROM careers x JOIN careers y ON x.organization = y.organization AND x.person_id < y.person_id) WHERE to_m > from_m)"""


@query(with_(CAREERS, _PAIRS) + "SELECT grp, a, b, from_m, to_m, months FROM pairs")
def j11_interval_overlaps(spark, sf):
    return J.overlap_pairs(S.careers(spark, sf), "organization")


@query(with_(CAREERS, _PAIRS) + "SELECT person, count(*) AS partners, CAST(sum(months) AS BIGINT) AS months FROM (SELECT a AS person, months FROM pairs UNION ALL SELECT b, months FROM pairs) GROUP BY 1")
def a25_most_connected(spark, sf):
    totals = J.overlap_totals(S.careers(spark, sf), "organization")
    return totals.groupBy("person").agg(F.sum("overlaps").alias("partners"), F.sum("months").alias("months"))


@query(with_(CAREERS, _PAIRS) + "SELECT grp, count(*) AS n FROM pairs GROUP BY 1")
def a26_overlaps_by_place(spark, sf):
    return J.overlap_totals(S.careers(spark, sf), "organization").groupBy("grp").agg((F.sum("overlaps") / 2).cast("long").alias("n"))


@query(with_(CAREERS, _PAIRS) + "SELECT a, b, grp, max(months) AS months, max(x.c_name) AS name_a, max(y.c_name) AS name_b FROM pairs JOIN customer x ON a = x.c_custkey JOIN customer y ON b = y.c_custkey GROUP BY 1, 2, 3")
def j07_overlaps_with_names(spark, sf):
    names = S.read(spark, sf, "customer").groupBy(F.col("c_custkey").alias("person")).agg(F.max("c_name").alias("name"))
    return J.longest_overlaps(S.careers(spark, sf), "organization", names=names).select("a", "b", "grp", "months", "name_a", "name_b")


@query(with_(CAREERS, _PAIRS) + "SELECT CASE WHEN a = 7 THEN b ELSE a END AS other, count(*) AS n FROM pairs WHERE a = 7 OR b = 7 GROUP BY 1")
def j08_other_endpoint(spark, sf):
    p = J.overlaps_of(S.careers(spark, sf), 7, "organization")
    return p.groupBy(F.when(F.col("a") == 7, F.col("b")).otherwise(F.col("a")).alias("other")).agg(F.count("*").alias("n"))


_TREE_EDGES = "e AS (SELECT conv_id * 100 + turn AS source_id, conv_id * 100 + turn - 1 AS target_id FROM conversations WHERE turn > 0)"


def turns(spark, sf):
    at = F.col("conv_id") * 100 + F.col("turn")
    return S.read(spark, sf, "conversations").filter("turn > 0").select(at.alias("source_id"), (at - 1).alias("target_id"))


@query(with_(_TREE_EDGES) + 'SELECT DISTINCT d.source_id AS "last", d.target_id AS middle, u.target_id AS "first" FROM e d JOIN e u ON d.target_id = u.source_id')
def j09_cascade(spark, sf):
    return G.cascade(turns(spark, sf))


@query("SELECT p_partkey, p_brand, CASE WHEN p_brand = 'Brand#7' THEN 'exact' WHEN p_brand LIKE 'Brand#1_%' THEN 'teens' WHEN p_brand LIKE 'Brand#1%' THEN 'ones' WHEN p_brand LIKE 'Brand#2%' THEN 'twos' ELSE 'other' END AS leaf FROM part")
def j17_prefix_rules(spark, sf):
    rules = spark.createDataFrame([("Brand#7", "exact", True), ("Brand#1", "ones", False), ("Brand#2", "twos", False), *[(f"Brand#1{k}", "teens", False) for k in range(10)]], "rule string, leaf string, exact boolean")
    return J.prefix_rule_join(S.read(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", rules, value="leaf")


@query("SELECT CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 'colour' WHEN regexp_matches(p_name, 'ring|bolt') THEN 'metal' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def j18_first_match_rules(spark, sf):
    kind = T.first_rule(F.col("p_name"), [("^(red|blue)", "colour"), ("ring|bolt", "metal")], "other", "other")
    return S.read(spark, sf, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(with_(CAREERS) + "SELECT DISTINCT x.person_id, y.person_id AS other FROM careers x JOIN careers y ON x.organization = y.organization AND x.term = y.term AND x.person_id <> y.person_id WHERE x.person_id < 20")
def j20_co_members(spark, sf):
    c = S.careers(spark, sf)
    mine, theirs = c.filter("person_id < 20").select("organization", "term", "person_id"), c.select("organization", "term", F.col("person_id").alias("other"))
    return mine.join(theirs, ["organization", "term"]).filter("person_id <> other").select("person_id", "other").distinct()


@query("SELECT doc_id, w.a AS amount, w.s AS sector FROM (SELECT doc_id, unnest(amounts) AS a, sectors FROM (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN [doc_id % 7, doc_id % 11] ELSE [doc_id % 7] END AS amounts, CASE WHEN n_chars % 3 = 0 THEN ['x', 'y'] WHEN n_chars % 3 = 1 THEN ['x'] ELSE [NULL] END AS sectors FROM documents)) v, LATERAL (SELECT v.a AS a, unnest(v.sectors) AS s) w")
def j21_amounts_by_sectors(spark, sf):
    """Two explodes; a document without sectors keeps its amounts."""
    amounts = F.when(F.col("n_chars") % 2 == 0, F.array(F.col("doc_id") % 7, F.col("doc_id") % 11)).otherwise(F.array(F.col("doc_id") % 7))
    sectors = F.when(F.col("n_chars") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).when(F.col("n_chars") % 3 == 1, F.array(F.lit("x")))
    return S.read(spark, sf, "documents").select("doc_id", F.explode(amounts).alias("amount"), sectors.alias("s")).select("doc_id", "amount", F.explode_outer("s").alias("sector"))


@query("SELECT o.o_orderkey, coalesce(v.tag, 'none') AS tag FROM orders o LEFT JOIN (VALUES (CAST(1 AS BIGINT), 'a'), (CAST(3 AS BIGINT), 'b')) v(k, tag) ON o.o_orderkey = v.k")
def j23_overlay(spark, sf):
    overlay = spark.createDataFrame([(1, "a"), (3, "b")], "o_orderkey long, tag string")
    return S.read(spark, sf, "orders").join(F.broadcast(overlay), "o_orderkey", "left").select("o_orderkey", F.coalesce("tag", F.lit("none")).alias("tag"))


@query("SELECT r_name, count(n_nationkey) AS units, string_agg(n_name, ',' ORDER BY n_name) AS children FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def j24_org_chart(spark, sf):
    n = S.read(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("units"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("children"))
    return S.read(spark, sf, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", F.coalesce("units", F.lit(0)).alias("units"), "children")


@query("SELECT split_part(regexp_replace(url, '^https?://', ''), '.', 2) AS family, count(*) AS n FROM pages GROUP BY 1")
def j25_domain_families(spark, sf):
    return S.read(spark, sf, "pages").groupBy(F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("."), F.lit(2)).alias("family")).agg(F.count("*").alias("n"))


@query("SELECT t.item_id, d.p_name FROM (SELECT p_partkey AS doc_id, p_brand AS item_id FROM part WHERE p_size > 30) t JOIN part d ON t.doc_id = d.p_partkey")
def j26_bridge(spark, sf):
    part = S.read(spark, sf, "part")
    bridge = part.filter("p_size > 30").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("item_id"))
    return bridge.join(part, bridge.doc_id == part.p_partkey).select("item_id", "p_name")


@query("SELECT page_id, CAST(least(len(h), len(l)) AS INTEGER) AS rows_n, h[1] AS first_href, l[1] AS first_label FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h, regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1) AS l FROM pages)")
def j27_zip_shortest(spark, sf):
    h, label = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), F.regexp_extract_all("html", F.lit("<a [^>]*>([^<]*)</a>"), F.lit(1))
    z = J.zip_shortest(F.col("h"), F.col("l"))
    return S.read(spark, sf, "pages").select("page_id", h.alias("h"), label.alias("l")).select("page_id", F.size(z).alias("rows_n"), F.get(z, F.lit(0))["h"].alias("first_href"), F.get(z, F.lit(0))["l"].alias("first_label"))


@query("SELECT regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '[?#].*$', ''), '/+$', '') AS key, count(*) AS n FROM pages GROUP BY 1")
def j16_normalised_urls(spark, sf):
    from lexweave.functions.html import normalize_url

    return S.read(spark, sf, "pages").groupBy(normalize_url(F.col("url")).alias("key")).agg(F.count("*").alias("n"))


# Sets


@query("SELECT kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'common' END AS kind FROM (SELECT d.doc_id FROM documents d) LEFT JOIN labels l USING (doc_id)) GROUP BY 1")
def u2_id_sets(spark, sf):
    d, l = S.read(spark, sf, "documents").select("doc_id"), S.read(spark, sf, "labels").select("doc_id")  # noqa: E741
    new = d.exceptAll(l).select(F.lit("new").alias("kind"))
    return new.unionByName(d.intersect(l).select(F.lit("common").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(with_(DOCUMENTS) + "SELECT id, bool_or(p) AS policy, bool_or(f) AS focus FROM (SELECT id, true AS p, false AS f FROM docs WHERE contains(title, 'the') UNION ALL SELECT id, false, true FROM docs WHERE contains(title, 'ing')) GROUP BY 1")
def u4_merged_flags(spark, sf):
    d = S.documents(spark, sf)
    part = lambda word, p, f: d.filter(F.col("title").contains(word)).select("id", F.lit(p).alias("p"), F.lit(f).alias("f"))
    return part("the", True, False).unionByName(part("ing", False, True)).groupBy("id").agg(F.bool_or("p").alias("policy"), F.bool_or("f").alias("focus"))


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1")
def u6_first_per_host(spark, sf):
    from lexweave.functions.html import host

    p = S.read(spark, sf, "pages").select("page_id", host(F.col("url")).alias("host"))
    return J.keep_first(p, ["host"], [F.col("page_id")]).select("host", "page_id")


# Changes and writes

_OLD = "old AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey % 10 <> 1)"
_NEW = "new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_name || '  ' WHEN c_custkey % 7 = 0 THEN c_name || 'x' ELSE c_name END AS name, c_acctbal AS balance, CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 10 <> 2)"


def snapshots(spark, sf):
    c = S.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    name = F.when(F.col("id") % 5 == 0, F.concat("name", F.lit("  "))).when(F.col("id") % 7 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name"))
    new = c.filter("id % 10 <> 2").withColumn("name", name).withColumn("segment", F.when(F.col("id") % 14 == 0, F.lit(None)).otherwise(F.col("segment")))
    return c.filter("id % 10 <> 1"), new


@query(with_(_OLD, _NEW) + """, j AS (SELECT coalesce(o.id, n.id) AS id, o.id AS a, n.id AS b, trim(coalesce(o.name, '')) AS on_, trim(coalesce(n.name, '')) AS nn, coalesce(o.segment, '') AS os, coalesce(n.segment, '') AS ns FROM old o FULL JOIN new n ON o.id = n.id)
SELECT id, 'added' AS change_type, CAST(NULL AS VARCHAR) AS field_name, CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value, 'r1' AS sync_run_id, '2024-01-01' AS detected_at FROM j WHERE a IS NULL
UNION ALL SELECT id, 'deleted', NULL, NULL, NULL, 'r1', '2024-01-01' FROM j WHERE b IS NULL
UNION ALL SELECT id, 'modified', 'name', on_, nn, 'r1', '2024-01-01' FROM j WHERE a = b AND on_ <> nn
UNION ALL SELECT id, 'modified', 'segment', os, ns, 'r1', '2024-01-01' FROM j WHERE a = b AND os <> ns""")
def c01_snapshot_diff(spark, sf):
    return C.snapshot_diff(*snapshots(spark, sf), "id", ["name", "segment"], "r1", "2024-01-01")


@query(with_(_OLD, _NEW) + "SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL AND (coalesce(n.name, '') <> '' OR o.id IS NULL) THEN n.name ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL AND (coalesce(n.segment, '') <> '' OR o.id IS NULL) THEN n.segment ELSE o.segment END AS segment FROM old o FULL JOIN new n ON o.id = n.id")
def k01_upsert_keep(spark, sf):
    old, new = snapshots(spark, sf)
    return C.upsert(old, new, "id").select("id", "name", "segment")


@query(with_(_OLD, _NEW) + "SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.segment ELSE o.segment END AS segment FROM old o FULL JOIN new n ON o.id = n.id")
def k02_upsert_overwrite(spark, sf):
    old, new = snapshots(spark, sf)
    return C.upsert(old, new, "id", keep_if_empty=False).select("id", "segment")


@query(with_(_OLD, _NEW) + "SELECT n.id, n.name FROM new n WHERE n.id NOT IN (SELECT id FROM old)")
def k04_insert_missing(spark, sf):
    old, new = snapshots(spark, sf)
    return C.insert_missing(old, new, ["id"]).select("id", "name")


@query(with_(EDGES) + f", r AS (SELECT target_id AS id, sum(CAST({'CASE source_level ' + ' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in L.LEVEL_WEIGHTS.items()) + ' ELSE 0.5 END'} AS DOUBLE)) AS rank FROM edges WHERE target_id IS NOT NULL GROUP BY 1) SELECT id, CAST(rank AS DOUBLE) AS rank FROM r WHERE id % 3 = 0")
def k06_diff_write(spark, sf):
    """Stored ranks differ for every third target; the others are off by less than the tolerance."""
    now = citation_rank(S.edges(spark, sf)).select(F.col("target_id").alias("id"), F.col("citation_rank").alias("rank"))
    stored = now.withColumn("rank", F.when(F.col("id") % 3 == 0, F.col("rank") + 1).otherwise(F.col("rank") + 1e-12))
    return C.diff_write(stored, now, "id", ["rank"])


@query(with_(_OLD) + "SELECT id, CASE WHEN id % 4 = 0 THEN upper(segment) || '!' ELSE segment END AS segment FROM old")
def k07_partial_update(spark, sf):
    old, _ = snapshots(spark, sf)
    changes = old.filter("id % 4 = 0").select("id", F.concat(F.upper("segment"), F.lit("!")).alias("segment"))
    return C.update_columns(old, changes, "id", ["segment"]).select("id", "segment")


@query(with_(_OLD) + "SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY s_name) AS id, s_name AS name FROM supplier")
def k14_allocate_ids(spark, sf):
    old, _ = snapshots(spark, sf)
    return C.allocate_ids(old, S.read(spark, sf, "supplier").select(F.col("s_name").alias("name")), "id", ["name"]).select("id", "name")


@query("SELECT s_suppkey, s_name, 0 AS is_expired, '' AS keywords FROM supplier")
def k15_defaults(spark, sf):
    return C.with_defaults(S.read(spark, sf, "supplier").select("s_suppkey", "s_name"), {"is_expired": 0, "keywords": "", "s_name": "never"})


@query("WITH a AS (SELECT page_id AS id, url FROM pages WHERE page_id % 3 <> 0), b AS (SELECT url FROM pages WHERE page_id % 2 = 0) SELECT id, url FROM a UNION ALL SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY url), url FROM b WHERE url NOT IN (SELECT url FROM a)")
def k16_merge_corpora(spark, sf):
    p = S.read(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    return C.merge_corpora(p.filter("id % 3 <> 0"), p.filter("id % 2 = 0"), "url", "id")


# Graph


@query(with_(EDGES) + ", near AS (SELECT DISTINCT source_id, target_id FROM edges WHERE target_id = 10) SELECT id, id = 10 AS is_centre FROM (SELECT source_id AS id FROM near UNION SELECT target_id FROM near UNION SELECT CAST(10 AS BIGINT))")
def g02_neighbourhood(spark, sf):
    e = S.edges(spark, sf).filter("target_id = 10")
    return G.neighbourhood(e, 10)[0]


@query(with_(EDGES) + ", h AS (SELECT target_id, count(*) AS cited FROM edges WHERE target_id IS NOT NULL GROUP BY 1 ORDER BY cited DESC, target_id LIMIT 40) SELECT source_id, target_id, n FROM (SELECT source_id, target_id, count(*) AS n FROM edges GROUP BY 1, 2) JOIN h USING (target_id) ORDER BY cited DESC, target_id, n DESC, source_id LIMIT 250")
def g03_hub_network(spark, sf):
    return G.hub_network(S.edges(spark, sf), 40, 250)


@query(with_(CAREERS, _PAIRS) + "SELECT a, b, months FROM (SELECT a, b, max(months) AS months FROM pairs GROUP BY 1, 2 ORDER BY months DESC, a, b LIMIT 2000) WHERE months >= 6")
def g04_officials_network(spark, sf):
    """The cap comes before the last filter, as the result is defined."""
    return J.top_overlaps(S.careers(spark, sf), "organization", 2000).filter("months >= 6")


@query(with_(EDGES) + """, core AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 480000), r AS (SELECT id, 0 AS r FROM core UNION ALL SELECT target_id, 1 FROM edges WHERE target_id IS NOT NULL AND source_id IN (SELECT id FROM core)
UNION ALL SELECT source_id, 2 FROM edges WHERE target_id IN (SELECT id FROM core)) SELECT id, CASE min(r) WHEN 0 THEN 'topic' WHEN 1 THEN 'outbound' ELSE 'inbound' END AS role FROM r GROUP BY 1""")
def g05_policy_chain(spark, sf):
    docs = S.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return G.policy_chain(docs, S.edges(spark, sf).select("source_id", "target_id"), F.col("o_totalprice") > 480000)


@query("WITH RECURSIVE t(id, parent_id) AS (SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, 'root' FROM region UNION ALL SELECT 'root', NULL), c(ancestor, node, depth) AS (SELECT id, id, 0 FROM t UNION ALL SELECT t.parent_id, c.node, c.depth + 1 FROM c JOIN t ON c.ancestor = t.id WHERE t.parent_id IS NOT NULL) SELECT ancestor, node, depth FROM c")
def g08_closure(spark, sf):
    n, r = S.read(spark, sf, "nation"), S.read(spark, sf, "region")
    tree = n.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent_id")).unionByName(r.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit("root").alias("parent_id")))
    return G.closure(tree.unionByName(spark.createDataFrame([("root", None)], "id string, parent_id string")))


# Search

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def search_docs(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", F.col("text").alias("body"), F.substring_index("text", "\n", 1).alias("title"), (F.col("doc_id") % 1000).alias("day"))


_POSTINGS = """tok AS (SELECT doc_id, regexp_extract_all(lower(substr(text, 1, 5000)), '[\\p{L}\\p{N}]+') AS b, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\\p{L}\\p{N}]+') AS t FROM documents),
len AS (SELECT doc_id, len(b) + len(t) AS dl FROM tok), post AS (SELECT term, doc_id, sum(w) AS wtf FROM (SELECT doc_id, unnest(b) AS term, 1.0::DOUBLE AS w FROM tok UNION ALL SELECT doc_id, unnest(t), 12.0::DOUBLE FROM tok) GROUP BY 1, 2)"""


@query(with_(_POSTINGS) + "SELECT count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(wtf) AS BIGINT) AS weight FROM post")
def q03_postings(spark, sf):
    p = Q.postings(search_docs(spark, sf))
    return p.agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"), F.sum("wtf").cast("long").alias("weight"))


_BM25 = with_(_POSTINGS) + """, st AS (SELECT count(*) AS n, avg(dl) AS mean FROM len), hit AS (SELECT * FROM post WHERE term IN ('and', 'with')), df AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
score AS (SELECT doc_id, sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS score, count(*) AS k FROM hit JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1)
"""


#: Indexes that were opened: their statistics, a row each.
_OPEN: dict[tuple[str, str], Q.StoredIndex] = {}


def stored_index(spark, sf):
    """The index of a table, built when it is first asked for and again when the table's files have changed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    state = [sf, Q.StoredIndex.FORMAT, *sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)]
    path = f"{shared_dir(spark)}/lexweave/search-index/{hashlib.sha1('|'.join(state).encode()).hexdigest()}"
    key = (spark.sparkContext.applicationId, path)
    if key not in _OPEN:
        _OPEN[key] = Q.StoredIndex(spark, path) if exists(spark, path) else Q.StoredIndex.build(search_docs(spark, sf), path, ["title", "day"])
    return _OPEN[key]


@query(with_(_POSTINGS) + "SELECT (SELECT count(*) FROM documents) AS documents, CAST((SELECT sum(dl) FROM len) AS BIGINT) AS tokens, count(*) AS hits FROM post WHERE term IN ('and', 'with')")
def q03_stored_index(spark, sf):
    """Builds the index unless it is there, and reads two terms."""
    index = stored_index(spark, sf)
    return index.postings(["and", "with"]).agg(F.count("*").alias("hits")).select(F.lit(index.total).cast("long").alias("documents"), F.lit(index.tokens).cast("long").alias("tokens"), "hits")


@query(_BM25 + "SELECT doc_id, round(score, 6) AS score FROM score WHERE k = 2")
def q04_bm25(spark, sf):
    return stored_index(spark, sf).bm25(["and", "with"]).select("doc_id", F.round("score", 6).alias("score"))


@query(_BM25 + "SELECT doc_id FROM score JOIN documents USING (doc_id) WHERE k = 2 ORDER BY CASE WHEN contains(lower(split_part(text, chr(10), 1)), 'and with') THEN 0 ELSE 1 END, round(score, 9) DESC, doc_id % 1000 DESC, doc_id LIMIT 20")
def q05_ranked_search(spark, sf):
    index = stored_index(spark, sf)
    scores = index.bm25(["and", "with"]).withColumn("score", F.round("score", 9))
    return Q.ranked(index.documents, scores, "and with", "title", "day").limit(20).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion of the')")
def q06_trigram(spark, sf):
    return Q.trigram_search(search_docs(spark, sf), "Tion of the", ["title", "body"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(translate(lower(text), '.,', ''), 'of the')")
def q07_like(spark, sf):
    return Q.like_search(search_docs(spark, sf), "Of, the", ["body"], marks=".,").select("doc_id")


@query("SELECT doc_id, 'trigram' AS path FROM documents WHERE contains(lower(text), 'ing. th')")
def q08_fallback(spark, sf):
    """No document has the query's word, so the second path answers."""
    path, found = Q.search(search_docs(spark, sf), stored_index(spark, sf), "ing. th", ["nosuchword"], ["title", "body"])
    return found.select("doc_id", F.lit(path).alias("path"))


@query(with_(_POSTINGS) + "SELECT doc_id, 'bm25' AS path FROM post WHERE term IN ('and', 'with') GROUP BY 1 HAVING count(*) = 2")
def q08_first_path(spark, sf):
    path, found = Q.search(search_docs(spark, sf), stored_index(spark, sf), "and with", ["and", "with"], ["title", "body"])
    return found.select("doc_id", F.lit(path).alias("path"))


@query("SELECT doc_id, 'like' AS path FROM documents WHERE contains(translate(lower(text), '《》「」『』【】（）()“”\"''，。、；：！？· ', ''), 'ofthe')")
def q08_third_path(spark, sf):
    """The query's marks are in no text, so only the scan without them answers; the index isn't there at all."""
    path, found = Q.search(search_docs(spark, sf), f"{shared_dir(spark)}/lexweave/no-index", "《of》《the》", ["and"], ["body"])
    return found.select("doc_id", F.lit(path).alias("path"))


@query(with_(DOCUMENTS) + "SELECT id FROM docs WHERE contains(lower(title), 'ening') OR contains(lower(body), 'ening') ORDER BY day DESC, id LIMIT 20")
def q10_keyword_search(spark, sf):
    return S.documents(spark, sf).filter(FI.any_term(["title", "body"], ["ening"])).select("id", "day").orderBy(F.desc("day"), "id").limit(20).select("id")
