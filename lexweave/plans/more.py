"""Careers, collections, frontier, rest of the joins, sorts, sets and the whole batch, on fixtures and driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import careers as K
from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.operators import changes as C
from lexweave.operators import filters as FI
from lexweave.operators import graph as G
from lexweave.operators import joins as J
from lexweave.plans import standins as S
from lexweave.plans.relations import snapshots
from lexweave.plans.standins import CAREERS, CHANGES, DOCUMENTS, EDGES, ITEMS, SITES, with_
from lexweave.plans.texts import any_word, values
from lexweave.sources import files, sinks

BOOK = S.Book()
query = BOOK.query

LIVES = [(1, "1975.09-1978.12 深圳市宝安区区长\n（其间：在职学习）\n1980-1985年 国务院办公厅副主任\n1990年3月任广东省委书记。"), (2, "1999年7月毕业于北京大学。\n2001年 任上海市浦东新区副区长；\n2003年5月任上海市市长。"), (3, None)]


@query("WITH " + values("e", "person_id, position, organization, province, admin_level, start_year, start_month, end_year, end_month", [
    (1, "宝安区区长", "深圳市", None, "district", 1975, 9, 1978, 12), (1, "办公厅副主任", "国务院", None, "central", 1980, None, 1985, None), (1, "委书记", "广东省", "广东", "provincial", 1990, 3, None, None),
    (2, "浦东新区副区长", "上海市", "上海", "provincial", 2001, None, 2003, 5), (2, "市长", "上海市", "上海", "provincial", 2003, 5, None, None),
]) + " SELECT * FROM e")
def t36_career_records(spark, sf):
    return K.career_records(spark.createDataFrame(LIVES, "person_id int, career_text string")).drop("pos", "raw_text")


_Y, _M = "(start_m - 1) // 12", "(start_m - 1) % 12 + 1"


@query(
    with_(CAREERS) + f""", r AS (SELECT person_id, term, term % 3 AS form, CAST({_Y} AS INTEGER) AS start_year, CASE WHEN term % 3 <> 1 THEN CAST({_M} AS INTEGER) END AS start_month FROM careers)
 SELECT person_id, ['宝安区区长', '办公厅副主任', '委书记'][form + 1] AS position, ['深圳市', '国务院', '广东省'][form + 1] AS organization, CASE form WHEN 2 THEN '广东' END AS province, ['district', 'central', 'provincial'][form + 1] AS admin_level,
 start_year, start_month, CASE form WHEN 2 THEN lead(start_year) OVER w ELSE start_year + 2 END AS end_year, CASE form WHEN 2 THEN lead(start_month) OVER w WHEN 0 THEN 12 END AS end_month FROM r WINDOW w AS (PARTITION BY person_id ORDER BY term)"""
)
def t36_careers_of_people(spark, sf):
    """A text of lines for each person, a line for each record, in the three forms; prose has no end but the next line's start."""
    c = S.careers(spark, sf)
    year, month = F.floor((F.col("start_m") - 1) / 12), (F.col("start_m") - 1) % 12 + 1
    dotted = F.format_string("%d.%02d-%d.12 深圳市宝安区区长", year, month.cast("int"), year + 2)
    years, prose = F.format_string("%d-%d年 国务院办公厅副主任", year, year + 2), F.format_string("%d年%d月任广东省委书记。", year, month.cast("int"))
    line = F.when(F.col("term") % 3 == 0, dotted).when(F.col("term") % 3 == 1, years).otherwise(prose)
    texts = c.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("term", line.alias("line")))).alias("lines")).select("person_id", F.array_join("lines.line", "\n").alias("career_text"))
    return K.career_records(texts).drop("pos", "raw_text")


@query("WITH " + values("e", "id, t", [(1, "1975.09-1978.12 某市某局局长某某"), (2, "他曾长期担任某某省某某市某某区委书记兼任多种职务"), (3, "described")]) + " SELECT * FROM e")
def t38_career_texts(spark, sf):
    d = spark.createDataFrame([(1, "生平\n 1975.09-1978.12 某市某局局长某某\n短 1975", None), (2, "第一行\n他曾长期担任某某省某某市某某区委书记兼任多种职务", "x"), (3, "nothing", "described")], "id int, page string, about string")
    return d.select("id", K.career_text(F.col("page"), F.col("about")).alias("t"))


@query("WITH " + values("e", "person_id, old_year, new_year", [(1, 1920, 1958)]) + " SELECT * FROM e")
def t42_birth_years(spark, sf):
    people = spark.createDataFrame([(1, "a", 1920), (2, "a", 1958), (3, "b", 1900)], "person_id int, name string, birth_year int")
    posts = spark.createDataFrame([(1, 1980), (1, 1990), (2, 1981), (3, 1975)], "person_id int, start_year int")
    return K.birth_year_repairs(people, posts, spark.createDataFrame([("a", 1920), ("a", 1958), ("b", 1900)], "name string, birth_year int"))


LABELS = sorted(set(L.ISSUERS.values()))


@query("WITH " + values("d", "label", [(x,) for x in LABELS]) + " SELECT label, CASE " + " ".join(f"WHEN {any_word('lower(label)', ws)} THEN '{k}'" for k, ws in L.LABEL_LEVELS) + " ELSE 'unknown' END AS level FROM d")
def t24_label_levels(spark, sf):
    return spark.createDataFrame([(x,) for x in LABELS], "label string").select("label", K.label_level(F.col("label")).alias("level"))


@query(with_(DOCUMENTS) + f" SELECT id FROM docs WHERE regexp_matches(concat_ws(' ', title, category, site_key), '(?i)tion.*src1')")
def t25_filter_on_joined_fields(spark, sf):
    return S.documents(spark, sf).filter(F.concat_ws(" ", "title", "category", "site_key").rlike("(?i)tion.*src1")).select("id")


@query("WITH " + values("e", "s, cut", [("short <mark>x</mark>", "short <mark>x</mark>"), ("a" * 148 + "<mark>hit</mark> rest", "a" * 148 + "<m…"), ("a" * 140 + "<mark>hit</mark> rest of it", "a" * 140 + "<mark>hit</mark>…"), (None, "")]) + " SELECT * FROM e")
def t27_truncated_snippets(spark, sf):
    d = spark.createDataFrame([("short <mark>x</mark>",), ("a" * 148 + "<mark>hit</mark> rest",), ("a" * 140 + "<mark>hit</mark> rest of it",), (None,)], "s string")
    return d.select("s", T.truncate_marked(F.col("s")).alias("cut"))


HEADLINES = ["国家石油储备释放", "霍尔木兹海峡航运", "外交部：中方立场", "采购原油合同", "普通新闻"]


@query("WITH " + values("d", "title", [(x,) for x in HEADLINES]) + f" SELECT title, CASE WHEN contains(title, '储备') THEN 'reserve' WHEN contains(title, '霍尔木兹') THEN 'hormuz' WHEN {any_word('title', ['中方', '外交部', '中国', '中企'])} THEN 'chinaresp' WHEN {any_word('title', ['进口', '采购', '抢购', '供应'])} THEN 'import' ELSE 'hormuz' END AS tag, {any_word('title', L.CHINA_WORDS)} AS china FROM d")
def t34_title_flags(spark, sf):
    t = F.col("title")
    return spark.createDataFrame([(x,) for x in HEADLINES], "title string").select("title", T.first_rule(t, L.FOCUS_TAGS, "hormuz", "hormuz").alias("tag"), T.contains_any(t, L.CHINA_WORDS).alias("china"))


ISSUED = ["国发〔2020〕1号", "财税〔2019〕3号", "深府〔2018〕2号", "苏府〔2018〕1号", "皖政〔2018〕1号"]


@query("WITH " + values("d", "ref", [(x,) for x in ISSUED]) + " SELECT CASE " + " ".join(f"WHEN regexp_matches(ref, '{p}') THEN '{v.replace(chr(39), chr(39) * 2)}'" for p, v in L.REACH) + " ELSE 'new: ' || substr(ref, 1, 2) END AS source, count(*) AS refs FROM d GROUP BY 1")
def g12_frontier_sources(spark, sf):
    d = spark.createDataFrame([(x,) for x in ISSUED], "ref string")
    source = T.first_rule(F.col("ref"), L.REACH, "", "new")
    return d.groupBy(F.when(source == "new", F.concat(F.lit("new: "), F.substring("ref", 1, 2))).otherwise(source).alias("source")).agg(F.count("*").alias("refs"))


@query("SELECT page_id, CASE WHEN l.doc_id IS NOT NULL THEN 'CRAWLED' WHEN code = '200' AND contains(html, '<nav>') AND contains(html, '<article>') THEN 'BUILDABLE' WHEN code = '200' THEN 'REACHABLE-UNKNOWN-CMS' WHEN code IN ('403', '412', '406') THEN 'ANTI-BOT' ELSE 'BLOCKED' END AS status FROM pages LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0 GROUP BY 1) l ON doc_id = page_id LEFT JOIN (SELECT event_id, CASE event_type WHEN 'error' THEN '403' WHEN 'signup' THEN '404' ELSE '200' END AS code FROM events) ON event_id = page_id")
def h12_source_status(spark, sf):
    """Answers come from the event of a page's number; a page with a labelled bad document counts as held."""
    from lexweave.functions import html as H

    answers = S.read(spark, sf, "events").select(F.col("event_id").alias("page_id"), F.when(F.col("event_type") == "error", "403").when(F.col("event_type") == "signup", "404").otherwise("200").alias("code"))
    held = S.read(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("held")).distinct()
    p = S.read(spark, sf, "pages").select("page_id", H.cms(F.col("html"), [(r"(?s)<nav>.*<article>", "semantic")]).alias("system"))
    p = p.join(answers, "page_id", "left").join(held, "page_id", "left")
    return p.select("page_id", H.source_status(F.coalesce("code", F.lit("000")), F.col("system"), F.coalesce("held", F.lit(False))).alias("status"))


@query("SELECT 'N' || n_nationkey AS leaf, 'root/R' || n_regionkey || '/N' || n_nationkey AS path FROM nation")
def g09_tree_leaves(spark, sf):
    n, r = S.read(spark, sf, "nation"), S.read(spark, sf, "region")
    tree = n.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent_id")).unionByName(r.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit("root").alias("parent_id"))).unionByName(spark.createDataFrame([("root", None)], "id string, parent_id string"))
    leaves = tree.join(tree.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("node"))
    up = G.closure(tree).join(leaves, "node").groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.col("ancestor").alias("a")))).alias("p"))
    return up.select(F.col("node").alias("leaf"), F.array_join(F.transform("p", lambda x: x["a"]), "/").alias("path"))


@query(with_(EDGES) + "SELECT 'out' AS direction, count(*) AS n FROM edges WHERE source_id = 100 UNION ALL SELECT 'in', count(*) FROM edges WHERE target_id = 100")
def g01_both_directions(spark, sf):
    e = S.edges(spark, sf)
    side = lambda c, name: e.filter(F.col(c) == 100).agg(F.count("*").alias("n")).select(F.lit(name).alias("direction"), "n")
    return side("source_id", "out").unionByName(side("target_id", "in"))


@query(with_(EDGES) + ", c AS (SELECT target_ref, target_level, count(*) AS n FROM edges WHERE source_level = 'central' GROUP BY 1, 2) SELECT target_level, count(*) AS policies, CAST(sum(n) AS BIGINT) AS citations, max(n) AS most FROM c GROUP BY 1")
def g06_chain_hierarchy(spark, sf):
    c = S.edges(spark, sf).filter("source_level = 'central'").groupBy("target_ref", "target_level").agg(F.count("*").alias("n"))
    return c.groupBy("target_level").agg(F.count("*").alias("policies"), F.sum("n").alias("citations"), F.max("n").alias("most"))


@query("SELECT r_name AS tier, n_name AS unit, count(c_custkey) AS docs FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def g10_org_chart_tiers(spark, sf):
    live = S.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("docs"))
    chart = S.read(spark, sf, "nation").join(S.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chart.join(live, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("r_name").alias("tier"), F.col("n_name").alias("unit"), F.coalesce("docs", F.lit(0)).alias("docs"))


@query(with_(DOCUMENTS) + "SELECT id FROM docs WHERE coalesce(body, '') = '' OR length(body) < 120")
def f12_missing_bodies(spark, sf):
    return S.documents(spark, sf).filter(~FI.has_body(F.col("body"), 120)).select("id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def f14_unmapped(spark, sf):
    return FI.unprocessed(S.read(spark, sf, "documents"), S.read(spark, sf, "labels").filter("quality = 1"), "doc_id").select("doc_id")


@query(with_(DOCUMENTS, SITES) + "SELECT d.id FROM docs d JOIN sites s USING (site_key) WHERE s.admin_level <> 'media' AND d.category IN ('en', 'fr') AND contains(lower(d.title), 'the')")
def f17_client_filter(spark, sf):
    d = S.documents(spark, sf).filter(F.col("category").isin("en", "fr") & F.lower("title").contains("the"))
    return d.join(S.sites(spark, sf).filter("admin_level <> 'media'"), "site_key", "left_semi").select("id")


@query(with_(DOCUMENTS, SITES) + "SELECT s.site_key FROM sites s LEFT JOIN docs d ON s.site_key = d.site_key AND d.category = 'es' GROUP BY 1 HAVING count(d.id) < 3")
def f18_uncovered_sites(spark, sf):
    n = S.documents(spark, sf).filter("category = 'es'").groupBy("site_key").agg(F.count("*").alias("n"))
    return S.sites(spark, sf).join(n, "site_key", "left").filter(F.coalesce("n", F.lit(0)) < 3).select("site_key")


@query("SELECT page_id, (regexp_extract(href, '^https?://([^/?#]+)', 1) = '' OR regexp_extract(href, '^https?://([^/?#]+)', 1) = regexp_extract(url, '^https?://([^/?#]+)', 1)) AND NOT contains(href, '/../') AS inside FROM (SELECT page_id, url, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS href FROM pages)")
def f22_link_guard(spark, sf):
    from lexweave.functions.html import same_site

    return S.read(spark, sf, "pages").select("page_id", same_site(F.regexp_extract("html", '<a href="([^"]*)"', 1), F.col("url")).alias("inside"))


@query(with_(DOCUMENTS, SITES) + "SELECT s.name, count(d.id) AS docs, max(d.day) AS newest FROM sites s LEFT JOIN docs d USING (site_key) GROUP BY 1")
def j02_sites_with_documents(spark, sf):
    n = S.documents(spark, sf).groupBy("site_key").agg(F.count("*").alias("docs"), F.max("day").alias("newest"))
    return S.sites(spark, sf).join(n, "site_key", "left").select("name", F.coalesce("docs", F.lit(0)).alias("docs"), "newest")


@query(with_(EDGES) + "SELECT e.source_id, p.p_name FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE source_id < 50) e JOIN part p ON e.target_id = p.p_partkey")
def j19_enrichment_by_keys(spark, sf):
    e = S.edges(spark, sf).filter("source_id < 50").select("source_id", "target_id").distinct()
    part = S.read(spark, sf, "part")
    return e.join(part, e.target_id == part.p_partkey).select("source_id", "p_name")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY CASE WHEN p_size > 10 THEN p_size END DESC NULLS LAST, p_retailprice, p_partkey LIMIT 30")
def o1_selectable_sort(spark, sf):
    s = F.when(F.col("p_size") > 10, F.col("p_size"))
    return S.read(spark, sf, "part").withColumn("s", s).orderBy(F.desc_nulls_last("s"), "p_retailprice", "p_partkey").limit(30).select("p_partkey", "p_retailprice")


@query()
def o8_stratified_sample(spark, sf):
    """Five rows a site by a seeded hash: the sample is the feature."""
    w = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id")
    return S.read(spark, sf, "documents").select("doc_id", "source", F.row_number().over(w).alias("k")).filter("k <= 5").select("doc_id", "source")


@query(with_(DOCUMENTS, SITES) + "SELECT id, CASE admin_level WHEN 'central' THEN 0 WHEN 'provincial' THEN 1 WHEN 'municipal' THEN 2 ELSE 9 END AS tier FROM docs JOIN sites USING (site_key) ORDER BY tier, day DESC, id LIMIT 30")
def o9_authority_sort(spark, sf):
    rank = F.when(F.col("admin_level") == "central", 0).when(F.col("admin_level") == "provincial", 1).when(F.col("admin_level") == "municipal", 2).otherwise(9)
    return S.documents(spark, sf).join(S.sites(spark, sf), "site_key").select("id", rank.alias("tier"), "day").orderBy("tier", F.desc("day"), "id").limit(30).select("id", "tier")


@query("SELECT c_custkey AS id, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def u1_union_all(spark, sf):
    return S.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind")).unionByName(S.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind")))


@query(with_(EDGES) + "SELECT DISTINCT id FROM (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 490000 UNION SELECT target_id FROM edges WHERE target_id IS NOT NULL AND source_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 490000))")
def u5_union_of_ids(spark, sf):
    core = S.read(spark, sf, "orders").filter("o_totalprice > 490000").select(F.col("o_orderkey").alias("id"))
    out = S.edges(spark, sf).filter("target_id is not null").join(core.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    return core.union(out).distinct()


@query(with_(CHANGES) + "SELECT document_id, change_type, detected_at FROM changes WHERE site_key = 'src3' ORDER BY detected_at DESC, document_id LIMIT 50")
def c08_recent_changes(spark, sf):
    return S.changes(spark, sf).filter("site_key = 'src3'").orderBy(F.desc("detected_at"), "document_id").limit(50).select("document_id", "change_type", "detected_at")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0")
def c06_missing_from_index(spark, sf):
    """Rows that an index, here of every fourth document, lacks."""
    d = S.read(spark, sf, "documents").select("doc_id")
    return FI.unprocessed(d, d.filter("doc_id % 4 = 0"), "doc_id")


@query("SELECT CAST(0 AS BIGINT) AS events")
def c01_idempotence(spark, sf):
    """A table that took all of a snapshot differs from it in nothing."""
    old, new = snapshots(spark, sf)
    taken = C.upsert(old, new, "id", keep_if_empty=False).join(new.select("id"), "id", "left_semi")
    return C.snapshot_diff(taken, new, "id", ["name", "segment"]).agg(F.count("*").alias("events"))


@query(with_(DOCUMENTS, EDGES, ITEMS) + "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM edges) AS citations, (SELECT count(*) FROM edges WHERE target_id IS NOT NULL) AS resolved, (SELECT count(DISTINCT site_key) FROM docs) AS sites, (SELECT CAST(sum(amount) AS BIGINT) FROM items) AS amount")
def a39_corpus_report(spark, sf):
    d = S.documents(spark, sf).agg(F.count("*").alias("documents"), F.count_distinct("site_key").alias("sites"))
    e = S.edges(spark, sf).agg(F.count("*").alias("citations"), F.count("target_id").alias("resolved"))
    return d.crossJoin(e).crossJoin(S.items(spark, sf).agg(F.sum("amount").alias("amount"))).select("documents", "citations", "resolved", "sites", "amount")


@query("SELECT page_id AS id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site_key, CAST(length(html) AS INTEGER) AS body_length FROM pages")
def k11_manifest(spark, sf):
    from lexweave.functions.html import host

    return sinks.manifest(S.read(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", host(F.col("url")).alias("site_key"), F.col("html").alias("body")))


@query("SELECT s_suppkey AS id, s_name AS label FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def k17_shared_columns(spark, sf):
    a = S.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), "s_acctbal")
    b = S.read(spark, sf, "customer").select(F.col("c_name").alias("label"), F.col("c_custkey").alias("id"), "c_mktsegment")
    return C.shared_columns(a, b)


@query("SELECT doc_id AS id, CASE WHEN length(text) > 1995 THEN 'New: ' || text ELSE text END AS body FROM documents")
def k17_replaced_bodies(spark, sf):
    d = S.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return C.replace_bodies(d, d.withColumn("body", F.concat(F.lit("New: "), "body")), "id", "body", 2000)


@query("SELECT page_id, 'live' AS origin, md5(html) AS body FROM pages WHERE length(html) >= 2000 UNION ALL SELECT doc_id, 'archive', md5(text) FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages WHERE length(html) >= 2000)")
def s16_live_or_archive(spark, sf):
    """Pages are live, documents are the archive's bodies of the same ids; short pages aren't usable."""
    live, archive = S.read(spark, sf, "pages").select("page_id", F.col("html").alias("body")), S.read(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("body"))
    return files.live_or_archive(live, archive, "page_id", "body", F.length("body") >= 2000).select("page_id", "origin", F.md5("body").alias("body"))


@query("SELECT page_id FROM pages UNION SELECT unnest(range((SELECT max(page_id) + 1 FROM pages), (SELECT max(page_id) + 50 FROM pages)))")
def s19_id_range(spark, sf):
    return files.id_range(spark, S.read(spark, sf, "pages"), "page_id")


@query("WITH " + values("e", "title, link, day", [("A", "http://x/1", "Mon"), ("B & C", "http://x/2", "")]) + " SELECT * FROM e")
def s15_feed_items(spark, sf):
    xml = "<rss><item><title><![CDATA[A]]></title><link>http://x/1</link><pubDate>Mon</pubDate></item><item><title>B & C</title><link> http://x/2 </link></item></rss>"
    return spark.createDataFrame([(xml,)], "x string").select(F.inline(files.rss_items(F.col("x"))))


@query("SELECT doc_id AS id, md5(split_part(text, chr(10), 1)) AS title FROM documents")
def s13_paged_items(spark, sf):
    """Answers of twenty documents each, then the last one again on five more pages, and one that isn't JSON."""
    d = S.read(spark, sf, "documents").select(F.floor(F.col("doc_id") / 20).alias("page"), F.struct(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title")).alias("item"))
    total = F.broadcast(S.read(spark, sf, "documents").agg((F.max("doc_id") + 1).alias("total")))
    body = F.to_json(F.struct("total", "items"))
    answers = d.groupBy("page").agg(F.collect_list("item").alias("items")).crossJoin(total).select("page", body.alias("body"), "total")
    more = answers.filter(F.col("page") == F.floor((F.col("total") - 1) / 20)).select(F.explode(F.sequence(F.col("page") + 1, F.col("page") + 5)).alias("page"), "body")
    bad = spark.createDataFrame([(1, "bad")], "page long, body string")
    found = files.paged_items(files.counted_pages(answers.select("page", "body").union(more).union(bad), 20), "id long, title string")
    return found.select("id", F.md5("title").alias("title"))


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'pdf' WHEN user_id % 4 = 1 THEN 'docx' WHEN user_id % 4 = 2 THEN 'doc' ELSE 'unknown' END AS kind FROM events")
def s10_attachment_types(spark, sf):
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("255044462D312E34", "504B030414000600", "D0CF11E0A1B11AE1", "3C68746D6C3E")])
    return S.read(spark, sf, "events").select("event_id", files.magic_type(F.element_at(heads, (F.col("user_id") % 4 + 1).cast("int"))).alias("kind"))


@query("WITH " + values("e", "id, text", [(1, "<meta charset=gb2312>中文"), (2, "中文"), (3, "plain")]) + " SELECT * FROM e")
def s12_charsets(spark, sf):
    rows = [(1, bytearray("<meta charset=gb2312>中文".encode("gb18030"))), (2, bytearray("中文".encode())), (3, bytearray(b"plain"))]
    return spark.createDataFrame(rows, "id int, content binary").select("id", files.decode_charset(F.col("content")).alias("text"))


@query("WITH " + values("e", "k, v, dflt", [("central", 3.0, 3.0), ("other", None, 0.5)]) + " SELECT k, CAST(v AS DOUBLE) AS v, CAST(dflt AS DOUBLE) AS dflt FROM e")
def y2_map_lookup(spark, sf):
    table = F.create_map(*[F.lit(x) for kv in L.LEVEL_WEIGHTS.items() for x in kv])
    return spark.createDataFrame([("central",), ("other",)], "k string").select("k", table[F.col("k")].alias("v"), F.coalesce(table[F.col("k")], F.lit(0.5)).alias("dflt"))


def _whole(spark, sf):
    """Documents as title and body, which together are the whole text."""
    end = F.instr("text", "\n")
    body = F.when(end > 0, F.substr(F.col("text"), end + 1))
    return S.read(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), body.alias("body"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion ')")
def q09_trigram_index(spark, sf):
    from lexweave.operators import search as Q

    docs = _whole(spark, sf)
    return Q.indexed_search(docs, Q.trigram_index(docs, ["title", "body"]), "Tion ", ["title", "body"]).select("doc_id")


@query("SELECT doc_id, count(*) AS grams FROM (SELECT DISTINCT doc_id, substr(t, i, 3) AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 1, 1))) AS i FROM (SELECT doc_id, lower(text) AS t FROM documents))) GROUP BY 1")
def c05_refreshed_index(spark, sf):
    """An index that was built of other bodies for every third document is right after its refresh."""
    from lexweave.operators import search as Q

    docs, columns = _whole(spark, sf), ["title", "body"]
    stale = docs.withColumn("body", F.when(F.col("doc_id") % 3 == 0, F.lit("old text")).otherwise(F.col("body")))
    fresh = Q.refresh_index(Q.trigram_index(stale, columns), docs, docs.filter("doc_id % 3 = 0"), columns)
    return fresh.groupBy("doc_id").agg(F.count("*").alias("grams"))


@query("SELECT page_id, CAST(page_id AS VARCHAR) AS sid, url AS site, id, name FROM (SELECT page_id, url, unnest([1, 2]) AS id, unnest([html[1:9] || '}; ]', 'b' || page_id]) AS name FROM pages)")
def s17_embedded_config(spark, sf):
    """Every page gets a script with an object that isn't JSON, with brackets in strings, and the tree of its sections."""
    name = F.to_json(F.struct(F.concat(F.substring("html", 1, 9), F.lit("}; ]")).alias("name"), F.lit(1).alias("id")))
    rest = F.to_json(F.struct(F.lit(2).alias("id"), F.concat(F.lit("b"), F.col("page_id").cast("string")).alias("name"), F.array(F.struct(F.lit(3).alias("id"))).alias("children")))
    script = F.concat(F.col("html"), F.lit("<script>window._CONFIG = { SID: '"), F.col("page_id").cast("string"), F.lit("', HOST: "), F.to_json(F.struct(F.struct(F.col("url").alias("address")).alias("site"))), F.lit(", TREE: ["), name, F.lit(", "), rest, F.lit("], SERVICE_AREA_ID: {a: '};'} };</script>"))
    p = S.read(spark, sf, "pages").select("page_id", script.alias("html"))
    host = files.config_tree(F.col("html"), r"window\._CONFIG", "HOST", "site struct<address: string>")["site"]["address"]
    tree = files.config_tree(F.col("html"), r"window\._CONFIG", "TREE", "array<struct<id: int, name: string>>")
    return p.select("page_id", F.regexp_extract("html", r"SID:\s*'(\d+)'", 1).alias("sid"), host.alias("site"), F.inline(tree))


@query("WITH " + values("e", "kind, value", [("url", "http://x/a"), ("url", "http://x/b"), ("record", "<a>1</a>"), ("link", "/p/1"), ("link", "/p/2")]) + " SELECT * FROM e")
def s18_discovered_entries(spark, sf):
    """Addresses of a sitemap, CDATA records of an interface, links of a list page."""
    from lexweave.functions.html import links

    xml = "<urlset><url><loc> http://x/a </loc></url><url><loc>http://x/b</loc></url></urlset>"
    records, page = "<recordset><record><![CDATA[<a>1</a>]]></record></recordset>", '<a href="/p/1">1</a><a class="c" href="/p/2">2</a><a href="/p/1">again</a>'
    d = spark.createDataFrame([(xml, records, page)], "x string, r string, p string")
    kinds = [("url", files.sitemap_urls(F.col("x"))), ("record", files.cdata_records(F.col("r"))), ("link", F.array_distinct(links(F.col("p"))))]
    return d.select(F.explode(F.flatten(F.array(*[F.transform(v, _tag(n)) for n, v in kinds]))).alias("e")).select("e.*")


def _tag(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))


ACQUIRED = [("https://www.gov.cn/a.htm", "2024年3月5日"), ("http://sz.gov.cn/b", "2024-03"), ("http://sz.gov.cn/held", "2024.1.1"), ("http://else.com/c", "soon")]


@query("WITH " + values("e", "url, site_key, day", [("https://www.gov.cn/a.htm", "gov", "2024-03-05"), ("http://sz.gov.cn/b", "sz", "2024-03-01"), ("http://else.com/c", "other", None)]) + " SELECT url, site_key, CAST(day AS DATE) AS day FROM e")
def k18_acquired_documents(spark, sf):
    """Host to site, dates of several forms, addresses that are held drop out."""
    from lexweave.functions.dates import parse_day
    from lexweave.functions.html import host

    d = spark.createDataFrame(ACQUIRED, "url string, raw string")
    held = spark.createDataFrame([("http://sz.gov.cn/held",)], "url string")
    site = F.when(host(F.col("url")) == "www.gov.cn", "gov").when(host(F.col("url")) == "sz.gov.cn", "sz").otherwise("other")
    return C.insert_missing(held, d, ["url"]).select("url", site.alias("site_key"), parse_day(F.col("raw")).alias("day"))
