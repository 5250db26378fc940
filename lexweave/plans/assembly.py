"""Profiles, collections, annotations, branches of sites and the daily report on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.operators import assembly as A
from lexweave.operators import graph as G
from lexweave.plans import standins as S
from lexweave.plans.standins import CAREERS, DOCUMENTS, SITES, with_
from lexweave.plans.texts import values

BOOK = S.Book()
query = BOOK.query

# Sites: an exact rule goes before prefixes, of which the longest counts; one site is placed in 'other' on purpose.
RULES = [("src1", "central", True), ("src1", "provincial", False), ("src12", "party", False), ("src2", "municipal", False), ("src0", "media", True), ("src7", "other", True)]
TREE = [("root", None), ("gov", "root"), ("local", "gov"), ("central", "gov"), ("provincial", "local"), ("municipal", "local"), ("press", "root"), ("media", "press"), ("party", "press"), ("other", "root")]
_LEAF = "CASE WHEN site_key = 'src1' THEN 'central' WHEN site_key = 'src0' THEN 'media' WHEN site_key = 'src7' THEN 'other' WHEN site_key LIKE 'src12%' THEN 'party' WHEN site_key LIKE 'src1%' THEN 'provincial' WHEN site_key LIKE 'src2%' THEN 'municipal' ELSE 'other' END"
_BRANCHES = values("t", "id, parent_id", TREE) + ", c(ancestor, node) AS (SELECT id, id FROM t UNION ALL SELECT t.parent_id, c.node FROM c JOIN t ON c.ancestor = t.id WHERE t.parent_id IS NOT NULL)"


def _rules(spark):
    return spark.createDataFrame(RULES, "rule string, leaf string, exact boolean")


def _tree(spark):
    return spark.createDataFrame(TREE, "id string, parent_id string")


@query(f"WITH RECURSIVE {_BRANCHES} SELECT ancestor AS branch, count(*) AS docs, count(DISTINCT source) AS sites FROM (SELECT source, source AS site_key FROM documents) d JOIN c ON node = {_LEAF} GROUP BY 1")
def g08_documents_of_branches(spark, sf):
    """Every branch with the documents of all its sites; sites that no rule knows are under 'other'."""
    per_site = S.read(spark, sf, "documents").groupBy(F.col("source").alias("site_key")).agg(F.count("*").alias("docs"))
    leaves = A.classified_sites(per_site, _rules(spark)).join(per_site, "site_key")
    return G.rollup(leaves, "leaf", _tree(spark), [F.sum("docs").alias("docs"), F.count("*").alias("sites")]).withColumnRenamed("ancestor", "branch")


@query(with_(DOCUMENTS) + f"SELECT id FROM docs WHERE {_LEAF} NOT IN ('central', 'provincial', 'municipal')")
def g08_excluded_branch(spark, sf):
    d = S.documents(spark, sf).select("id", "site_key")
    return d.join(A.branch_sites(d, _rules(spark), _tree(spark), "gov").filter("not inside"), "site_key", "left_semi").select("id")


@query(f"SELECT {_LEAF} AS leaf, count(*) AS sites, count(*) FILTER ({_LEAF} = 'other' AND site_key <> 'src7') AS unmapped FROM (SELECT DISTINCT source AS site_key FROM documents) GROUP BY 1")
def g08_validation(spark, sf):
    sites = S.read(spark, sf, "documents").select(F.col("source").alias("site_key"))
    return A.classified_sites(sites, _rules(spark)).groupBy("leaf").agg(F.count("*").alias("sites"), F.count_if("unmapped").alias("unmapped"))


_WHO = 11
_OWN = """r AS (SELECT person_id, CASE WHEN term % 3 = 0 THEN NULL ELSE organization END AS org, province, start_m, end_m FROM careers),
 mine AS (SELECT * FROM r WHERE person_id = 11),
 places AS (SELECT coalesce(org, province) AS place, min(start_m) AS a, max(end_m) AS b, bool_or(org IS NOT NULL) AS by_org FROM mine GROUP BY 1),
 met AS (SELECT place, person_id, min(start_m) AS a, max(end_m) AS b, count(*) AS n FROM r JOIN places ON CASE WHEN by_org THEN r.org ELSE r.province END = place WHERE person_id <> 11 GROUP BY 1, 2),
 ov AS (SELECT r.org AS place, r.person_id, greatest(r.start_m, m.start_m) AS a, least(coalesce(r.end_m, r.start_m + 48), coalesce(m.end_m, m.start_m + 48)) AS b FROM r JOIN mine m ON r.org = m.org WHERE r.person_id <> 11)"""


@query(
    with_(CAREERS, _OWN)
    + """SELECT 'career' AS part, coalesce(org, province) AS place, CAST(NULL AS BIGINT) AS other, CAST(NULL AS VARCHAR) AS name, start_m AS from_m, end_m AS to_m, CAST(NULL AS BIGINT) AS n FROM mine
 UNION ALL SELECT * FROM (SELECT 'overlap', place, person_id, c_name, a, b, CAST(b - a AS BIGINT) FROM ov JOIN customer ON c_custkey = person_id WHERE b > a ORDER BY b - a DESC, person_id, place, a LIMIT 50)
 UNION ALL SELECT 'government', place, NULL, NULL, a, b, (SELECT count(*) FROM met WHERE met.place = places.place) FROM places
 UNION ALL SELECT 'colleague', place, person_id, c_name, a, b, n FROM met JOIN customer ON c_custkey = person_id"""
)
def g11_profile(spark, sf):
    """Every third term has no organisation, so its government is the province."""
    careers = S.careers(spark, sf).withColumn("organization", F.when(F.col("term") % 3 == 0, "").otherwise(F.col("organization")))
    people = S.read(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    return A.profile(careers, people, _WHO)


_URL = "'http://' || site_key || '/' || (id // 2)"
_COLLECTION = (
    DOCUMENTS
    + ", "
    + SITES
    + f""", hits AS (SELECT *, {_URL} AS url, contains(title, 'the') AS p, contains(title, 'ing') OR (contains(title, 'and') AND contains(body, 'from')) AS f FROM docs),
 kept AS (SELECT *, bool_or(p) OVER u AS in_policy, bool_or(f) OVER u AS in_focus, row_number() OVER (PARTITION BY url ORDER BY NOT p, id) AS k FROM hits WHERE p OR f WINDOW u AS (PARTITION BY url)),
 coll AS (SELECT url, id, site_key, admin_level AS tier, day, title, substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 260) AS snippet, in_policy, in_focus,
 CASE WHEN (id // 2) % 2 = 0 THEN 'marked' WHEN in_focus AND contains(title, 'queen') THEN 'royal' WHEN in_focus THEN 'plain' ELSE '' END AS tag, CASE WHEN (id // 2) % 2 = 0 THEN 'note' ELSE '' END AS note, contains(title, 'er') AS china
 FROM kept JOIN sites USING (site_key) WHERE k = 1)"""
)


def _collection(spark, sf):
    title = F.col("title")
    docs = S.documents(spark, sf).withColumn("url", F.concat(F.lit("http://"), "site_key", F.lit("/"), F.floor(F.col("id") / 2).cast("string")))
    policy, focus = title.contains("the"), title.contains("ing") | (title.contains("and") & F.col("body").contains("from"))
    overlay = docs.filter("floor(id / 2) % 2 = 0").select("url", F.lit("marked").alias("tag"), F.lit("note").alias("note")).distinct()
    return A.collection(docs, S.sites(spark, sf), overlay, policy, focus, [("queen", "royal")], ["er"], "plain")


@query("WITH " + _COLLECTION + " SELECT * FROM coll")
def g13_collection(spark, sf):
    return _collection(spark, sf)


@query("WITH " + _COLLECTION + " SELECT 'month' AS kind, strftime(day, '%Y-%m') AS key, count(*) AS n FROM coll GROUP BY 2 UNION ALL SELECT 'site', site_key, count(*) FROM coll GROUP BY 2 UNION ALL SELECT 'total', x, sum(y) FROM (SELECT unnest(['all', 'in_policy', 'in_focus', 'china']) AS x, unnest([1, in_policy::INT, in_focus::INT, china::INT]) AS y FROM coll) GROUP BY 2 HAVING sum(y) > 0")
def a32_collection_counts(spark, sf):
    return A.collection_counts(_collection(spark, sf))


WORDS = {"T": "the", "I": "ing", "A": "and", "Z": "zzzz"}
TAXONOMY = [("T", "short"), ("I", "short"), ("A", "long"), ("Z", "long")]
_MAPPING = "m AS (SELECT doc_id, unnest(CASE WHEN len(x) = 0 THEN ['__none__'] ELSE x END) AS item_id FROM (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN contains(text, '{w}') THEN '{k}' END" for k, w in WORDS.items()) + "], lambda v: v IS NOT NULL) AS x FROM documents))"


def _mapping(spark, sf):
    marks = F.array_compact(F.array(*[F.when(F.col("text").contains(w), k) for k, w in WORDS.items()]))
    return S.read(spark, sf, "documents").select("doc_id", F.explode(F.when(F.size(marks) == 0, F.array(F.lit("__none__"))).otherwise(marks)).alias("item_id"))


@query("WITH " + values("t", "item_id, category", TAXONOMY) + f", {_MAPPING}, n AS (SELECT item_id, count(*) AS n FROM m GROUP BY 1) SELECT item_id, category, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT max(n) FROM n WHERE item_id <> '__none__'), 2) AS pct, (SELECT count(DISTINCT doc_id) FROM m WHERE item_id <> '__none__') AS tagged, (SELECT count(*) FROM m WHERE item_id = '__none__') AS untagged FROM t LEFT JOIN n USING (item_id)")
def g14_annotation_overview(spark, sf):
    return A.annotation_overview(_mapping(spark, sf), spark.createDataFrame(TAXONOMY, "item_id string, category string"))


@query(f"WITH {_MAPPING} SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS place, doc_id, n_chars AS rank, count(*) OVER (PARTITION BY item_id) AS linked FROM m JOIN documents USING (doc_id) WHERE item_id <> '__none__') WHERE place <= 24")
def g14_annotation_items(spark, sf):
    return A.annotation_items(_mapping(spark, sf), S.read(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("rank")))


_EVENT_DOCUMENTS = "e AS (SELECT event_id AS id, 'src' || (user_id % 20) AS site_key, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS importance, CAST(ts AS DATE) AS crawled, ts AS written FROM events)"


@query(
    f"WITH {_EVENT_DOCUMENTS}, d AS (SELECT * FROM e WHERE crawled = DATE '2024-01-15') SELECT 'importance' AS part, importance AS key, count(*) AS n FROM e GROUP BY 2"
    " UNION ALL SELECT * FROM (SELECT 'site', site_key, count(*) AS n FROM d GROUP BY 2 ORDER BY n DESC, site_key LIMIT 5)"
    " UNION ALL SELECT 'sample', CAST(id AS VARCHAR), k FROM (SELECT id, row_number() OVER (ORDER BY CASE importance WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, written DESC, id) AS k FROM d) WHERE k <= 10"
)
def a42_daily_report(spark, sf):
    kind = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    e = S.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("site_key"), kind.alias("importance"), F.to_date("ts").alias("crawled"), F.col("ts").alias("written"))
    return A.daily_report(e, "2024-01-15")
