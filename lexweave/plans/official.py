"""A corpus of official texts made from the driver's documents, and the citation builder on all of it.

A document's number, title, body and list of references follow from its id: its whole text, then sentences that cite other
ids by number (plain, after an agency's name, in other brackets) and by title (whole, with an addition, a part of it). Ids
beyond the table dangle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.operators import citations as CI
from lexweave.operators import graph as G
from lexweave.operators import joins as J
from lexweave.plans import standins as S
from lexweave.plans.standins import SITES, with_
from lexweave.plans.texts import _DN, _NT, any_word, quoted, values

BOOK = S.Book()
query = BOOK.query

ORGS = ["国发", "国办发", "粤府", "粤府办", "深府", "深坪", "苏住建规"]
PLACES = ["国务院", "广东省", "深圳市", "深圳市龙华区"]
TOPICS = ["人工智能产业", "数据要素市场", "住房保障", "海洋经济", "新能源汽车", "中小企业", "绿色建筑", "数字政府", "医疗卫生", "职业教育", "低空经济"]
KINDS = ["实施方案", "若干措施", "管理办法", "行动计划", "工作报告", "指导意见"]


def _pick(words: list[str], x: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (x % len(words) + 1).cast("int"))


def _number(x: F.Column, marks: str = "〔〕") -> F.Column:
    return F.when(x % 4 == 3, "").otherwise(F.concat(_pick(ORGS, x), F.lit(marks[0]), (x % 20 + 2005).cast("string"), F.lit(marks[1]), x.cast("string"), F.lit("号")))


def _title(x: F.Column) -> F.Column:
    return F.concat(_pick(PLACES, x), F.lit("关于"), _pick(TOPICS, x), F.lit("第"), x.cast("string"), F.lit("期的"), _pick(KINDS, x))


def _core(x: F.Column) -> F.Column:
    return F.concat(_pick(TOPICS, x), F.lit("第"), x.cast("string"), F.lit("期的"), _pick(KINDS, x))


def official(spark: SparkSession, sf: str) -> DataFrame:
    """id, site_key, number, title, body, references."""
    i = F.col("doc_id")
    r = [(i * m + c) % 1200 for m, c in ((7, 3), (11, 5), (13, 1), (17, 9), (19, 4))]
    body = F.concat(
        F.coalesce("text", F.lit("")), F.lit("\n按照"), _number(r[0]), F.lit("和苏州市住房和城乡建设局"), _number(r[1]), F.lit("，落实《"), _title(r[2]), F.lit("》与《"), _title(r[3]), F.lit("（试行）》，"),
        F.lit("参见《"), _core(r[4]), F.lit("》，另见"), _number(r[4], "（）"), F.lit("。"),
    )
    refs = F.array(_title(r[2]), _title(r[1]), F.concat(_core(r[3]), F.lit("（节选）")), F.lit("短"))
    return S.read(spark, sf, "documents").select(i.alias("id"), F.col("source").alias("site_key"), _number(i).alias("number"), _title(i).alias("title"), body.alias("body"), refs.alias("references"))


def _sql_pick(words: list[str], x: str) -> str:
    return f"{quoted(words)}[({x}) % {len(words)} + 1]"


def _sql_number(x: str, marks: str = "〔〕") -> str:
    return f"CASE WHEN ({x}) % 4 = 3 THEN '' ELSE {_sql_pick(ORGS, x)} || '{marks[0]}' || (({x}) % 20 + 2005) || '{marks[1]}' || ({x}) || '号' END"


def _sql_core(x: str) -> str:
    return f"{_sql_pick(TOPICS, x)} || '第' || ({x}) || '期的' || {_sql_pick(KINDS, x)}"


def _sql_title(x: str) -> str:
    return f"{_sql_pick(PLACES, x)} || '关于' || {_sql_core(x)}"


OFFICIAL = f"""ids AS (SELECT doc_id AS i, source, text, (doc_id * 7 + 3) % 1200 AS a, (doc_id * 11 + 5) % 1200 AS b, (doc_id * 13 + 1) % 1200 AS c, (doc_id * 17 + 9) % 1200 AS d, (doc_id * 19 + 4) % 1200 AS e FROM documents),
official AS (SELECT i AS id, source AS site_key, {_sql_number('i')} AS number, {_sql_title('i')} AS title,
 coalesce(text, '') || chr(10) || '按照' || {_sql_number('a')} || '和苏州市住房和城乡建设局' || {_sql_number('b')} || '，落实《' || {_sql_title('c')} || '》与《' || {_sql_title('d')} || '（试行）》，参见《' || {_sql_core('e')} || '》，另见' || {_sql_number('e', '（）')} || '。' AS body,
 [{_sql_title('c')}, {_sql_title('b')}, {_sql_core('d')} || '（节选）', '短'] AS refs FROM ids)"""


def _level(num: str) -> str:
    clean = f"regexp_replace(regexp_replace({num}, '^依据', ''), '^依照', '')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'starts_with({clean}, {quoted(p)})' for p in ps)} THEN {quoted(k)}" for k, ps in L.LEVEL_PREFIXES.items()) + " ELSE 'unknown' END"


_NAMED_LEVEL = f"CASE WHEN {any_word('target_ref', L.CENTRAL_NAMES)} THEN 'central' WHEN {any_word('target_ref', L.PROVINCIAL_NAMES)} THEN 'provincial' WHEN contains(target_ref, '深圳市') AND NOT {any_word('target_ref', L.DISTRICT_NAMES)} THEN 'municipal' WHEN {any_word('target_ref', L.DISTRICT_NAMES)} THEN 'district' WHEN contains(target_ref, '深圳') AND NOT contains(target_ref, '区') THEN 'municipal' ELSE 'unknown' END"
_NORM = f"trim(regexp_replace(ref, {quoted(L.LEAD_IN)}, ''))"
_ISSUED = f"regexp_extract(number, {quoted(L.FORMAL_CORE)})"

#: The builder as joins of everything with everything, which is what the operators must not do.
CITATIONS = f"""{SITES}, {OFFICIAL},
base AS (SELECT o.*, CASE WHEN {_level('number')} <> 'unknown' THEN {_level('number')} WHEN admin_level = 'department' THEN 'municipal' ELSE coalesce(admin_level, 'unknown') END AS source_level, {_NT.format(c='title')} AS own FROM official o LEFT JOIN sites USING (site_key)),
raw AS (SELECT id, number, source_level, unnest(list_distinct(regexp_extract_all(body, {quoted(L.FORMAL_REF)}, 1))) AS ref FROM base),
p AS (SELECT ref, norm, core, CASE WHEN core <> '' THEN left(norm, length(norm) - length(core)) END AS prefix FROM (SELECT DISTINCT ref, {_NORM} AS norm, regexp_extract({_NORM}, {quoted(L.FORMAL_CORE)}) AS core FROM raw)),
{values('listed', 'word', [(k,) for k in L.ISSUERS if not k.startswith(('依据', '依照'))])},
known AS (SELECT word FROM listed UNION SELECT prefix FROM p WHERE length(prefix) BETWEEN 2 AND 6 AND NOT regexp_matches(prefix, {quoted(L.HEAD_NOISE)})
 UNION SELECT left(number, length(number) - length({_ISSUED})) FROM official WHERE {_ISSUED} <> ''),
hit AS (SELECT ref, arg_max(word, length(word)) AS word FROM (SELECT p.ref, known.word, left(prefix, length(prefix) - length(word)) AS head, prefix FROM p JOIN known ON length(word) >= 2 AND length(word) < length(prefix) AND ends_with(prefix, word) WHERE prefix NOT IN (SELECT word FROM known))
 WHERE regexp_matches(head, {quoted('[' + L.ORG_MARKERS + ']')}) OR regexp_matches(head, {quoted(L.HEAD_NOISE)}) OR length(prefix) > 8 GROUP BY 1),
canon AS (SELECT p.ref, CASE WHEN word IS NOT NULL THEN word || core ELSE norm END AS target_ref FROM p LEFT JOIN hit USING (ref)),
held AS (SELECT number, max(id) AS id FROM official WHERE number <> '' GROUP BY 1), folded AS (SELECT {_DN.format(c='number')} AS n, min(id) AS id FROM official WHERE number <> '' GROUP BY 1),
formal AS (SELECT DISTINCT r.id AS source_id, target_ref, coalesce(h.id, f.id) AS target_id, 'formal' AS citation_type, source_level, {_level('target_ref')} AS target_level FROM raw r JOIN canon USING (ref) LEFT JOIN held h ON h.number = target_ref LEFT JOIN folded f ON f.n = {_DN.format(c='target_ref')} WHERE target_ref <> r.number),
told AS (SELECT DISTINCT id AS source_id, own, source_level, target_ref, 'named' AS citation_type FROM (SELECT id, own, source_level, unnest(regexp_extract_all(body, {quoted(L.NAMED_REF)}, 1)) AS target_ref FROM base) WHERE {any_word('target_ref', L.POLICY_WORDS)} AND NOT {any_word('target_ref', L.NOT_POLICY_WORDS)}),
model AS (SELECT DISTINCT id AS source_id, own, source_level, target_ref, 'llm' AS citation_type FROM (SELECT id, own, source_level, unnest(refs) AS target_ref FROM base) m WHERE length(target_ref) >= 4 AND NOT EXISTS (SELECT 1 FROM told WHERE told.source_id = m.id AND told.target_ref = m.target_ref)),
names AS (SELECT *, {_NT.format(c='target_ref')} AS name FROM (SELECT * FROM told UNION ALL SELECT * FROM model)),
t AS (SELECT {_NT.format(c='title')} AS title, min(id) AS id FROM official GROUP BY 1), n AS (SELECT DISTINCT name FROM names WHERE name <> own),
e AS (SELECT name, id FROM n JOIN t ON name = title), f AS (SELECT name, arg_max(id, length(title) * 1000 - instr(name, title)) AS id FROM n JOIN t ON contains(name, title) AND length(title) >= 8 WHERE name NOT IN (SELECT name FROM e) GROUP BY 1),
g AS (SELECT name, arg_min(id, length(title) * 10000000 + id) AS id FROM n JOIN t ON contains(title, name) AND length(title) >= 8 WHERE length(name) >= 4 AND name NOT IN (SELECT name FROM e) AND name NOT IN (SELECT name FROM f) GROUP BY 1),
found AS (SELECT name, id, 'equal' AS how FROM e UNION ALL SELECT name, id, 'title in name' FROM f UNION ALL SELECT name, id, 'name in title' FROM g),
cites AS (SELECT source_id, target_ref, target_id, citation_type, source_level, target_level FROM formal WHERE target_id IS NULL OR target_id <> source_id
 UNION ALL SELECT source_id, target_ref, id, citation_type, source_level, {_NAMED_LEVEL} FROM names LEFT JOIN found USING (name) WHERE name <> own AND (id IS NULL OR id <> source_id))
"""


def citations(spark: SparkSession, sf: str) -> DataFrame:
    return CI.build_citations(official(spark, sf), S.sites(spark, sf))


@query(with_(CITATIONS) + "SELECT source_id, target_ref, target_id, citation_type, source_level, target_level FROM cites")
def t14_corpus_citations(spark, sf):
    """The citation builder on the whole corpus."""
    return citations(spark, sf)


@query(with_(CITATIONS) + "SELECT name, id, how FROM found")
def j12_corpus_titles(spark, sf):
    """Title resolution of all names that the corpus cites."""
    docs = official(spark, sf).withColumn("own", T.norm_title(F.col("title")))
    named = docs.select("own", F.explode(T.named_refs(F.col("body"))).alias("ref")).filter(T.is_policy(F.col("ref")))
    told = docs.select("own", F.explode("references").alias("ref")).filter(F.length("ref") >= 4)
    names = named.unionByName(told).select("own", T.norm_title(F.col("ref")).alias("name")).filter("name <> own")
    return J.resolve_titles(names, docs.select(F.col("own").alias("title"), "id"))


@query(with_(CITATIONS) + "SELECT DISTINCT ref, target_ref AS canonical FROM canon")
def t10_corpus_refs(spark, sf):
    """Canonical forms of all reference numbers in the corpus (T7x-T10x, J14)."""
    docs = official(spark, sf)
    refs = docs.select(F.explode(T.formal_refs(F.col("body"))).alias("ref")).distinct()
    return CI.canonical_refs(refs, CI.known_abbreviations(docs.select("number"), refs)).select("ref", "canonical")


@query(with_(OFFICIAL, values("lab", "prefix, label", list(L.ISSUERS.items()))) + f"SELECT {_level('number')} AS level, coalesce((SELECT arg_max(label, length(prefix)) FROM lab WHERE starts_with(number, prefix)), nullif(regexp_extract(number, '^([\\x{{4e00}}-\\x{{9fff}}]+)', 1), ''), 'Unknown') AS issuer, CASE WHEN coalesce(title, '') = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches(title, {quoted(p)}) THEN {quoted(v)}" for p, v in L.DOC_TYPES) + " ELSE 'other' END AS doc_type, count(*) AS n FROM official GROUP BY 1, 2, 3")
def t05_corpus_levels(spark, sf):
    """Level and issuer of all numbers and type of all titles (T5x, T6x, T18x)."""
    d = official(spark, sf)
    return d.groupBy(T.admin_level(F.col("number")).alias("level"), T.issuer(F.col("number")).alias("issuer"), T.first_rule(F.col("title"), L.DOC_TYPES, "unknown", "other").alias("doc_type")).agg(F.count("*").alias("n"))


@query(with_(CITATIONS) + "SELECT site_key, target_level, count(*) AS n FROM cites JOIN official ON source_id = id GROUP BY 1, 2")
def a20_site_by_level(spark, sf):
    """How often each site cites each level."""
    return citations(spark, sf).join(official(spark, sf).select(F.col("id").alias("source_id"), "site_key").hint("merge"), "source_id").groupBy("site_key", "target_level").agg(F.count("*").alias("n"))


@query(with_(CITATIONS) + "SELECT target_ref, count(DISTINCT site_key) AS sites, count(*) AS n FROM cites JOIN official ON source_id = id WHERE target_level = 'central' GROUP BY 1 ORDER BY sites DESC, n DESC, target_ref LIMIT 30")
def a20_central_by_sites(spark, sf):
    """Central references by the number of sites that cite them."""
    c = citations(spark, sf).filter("target_level = 'central'").join(official(spark, sf).select(F.col("id").alias("source_id"), "site_key").hint("merge"), "source_id")
    return c.groupBy("target_ref").agg(F.count_distinct("site_key").alias("sites"), F.count("*").alias("n")).orderBy(F.desc("sites"), F.desc("n"), "target_ref").limit(30)


_GAP_ISSUER = "coalesce((SELECT arg_max(label, length(prefix)) FROM lab WHERE starts_with(target_ref, prefix)), nullif(regexp_extract(target_ref, '^([\\x{4e00}-\\x{9fff}]+)', 1), ''), 'Unknown')"


@query(with_(CITATIONS, values("lab", "prefix, label", list(L.ISSUERS.items()))) + f""", gap AS (SELECT target_ref, citation_type, CASE WHEN citation_type = 'formal' THEN {_GAP_ISSUER} ELSE 'Unknown (' || target_level || ')' END AS issuer, target_level FROM cites WHERE target_id IS NULL),
have AS (SELECT DISTINCT {_GAP_ISSUER.replace('target_ref', 'number')} AS issuer FROM official WHERE number <> ''),
samp AS (SELECT issuer, string_agg(target_ref, '|' ORDER BY target_ref) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY target_ref) AS k FROM (SELECT DISTINCT issuer, target_ref FROM gap)) WHERE k <= 5 GROUP BY 1)
SELECT issuer, count(*) AS n, min(target_level) AS level, issuer IN (SELECT issuer FROM have) AS crawled, count(*) FILTER (citation_type = 'formal') AS formal, count(*) FILTER (citation_type = 'named') AS named, count(*) FILTER (citation_type = 'llm') AS llm, any_value(samples) AS samples FROM gap JOIN samp USING (issuer) GROUP BY 1""")
def a28_citation_gaps(spark, sf):
    """Unresolved references by issuer: how many, of what type, five samples, and whether that issuer is held at all."""
    return CI.citation_gaps(citations(spark, sf), official(spark, sf).select("number"))


@query(with_(CITATIONS) + "SELECT target_level, count(*) AS total, count(target_id) AS resolved, count(*) - count(target_id) AS dangling, round(100.0::DOUBLE * count(target_id) / count(*), 3) AS pct FROM cites GROUP BY 1")
def a29_resolution_by_level(spark, sf):
    return citations(spark, sf).groupBy("target_level").agg(F.count("*").alias("total"), F.count("target_id").alias("resolved"), (F.count("*") - F.count("target_id")).alias("dangling"), F.round(F.lit(100.0) * F.count("target_id") / F.count("*"), 3).alias("pct"))


_BOTH = f"""x AS (SELECT id, list_distinct(list_transform(refs, lambda ref: {_NORM})) AS m, list_distinct(list_transform(list_concat(regexp_extract_all(body, {quoted(L.NAMED_REF)}, 1), regexp_extract_all(body, {quoted(L.FORMAL_REF)}, 1)), lambda ref: {_NORM})) AS r FROM official),
s AS (SELECT count(*) AS docs, CAST(sum(len(m)) AS BIGINT) AS model_refs, CAST(sum(len(r)) AS BIGINT) AS pattern_refs, CAST(sum(len(list_intersect(m, r))) AS BIGINT) AS both_refs, round(avg(CAST(len(list_intersect(m, r)) AS DOUBLE) / (len(m) + len(r) - len(list_intersect(m, r)))), 6) AS jaccard FROM x)"""


@query(with_(OFFICIAL, _BOTH) + "SELECT *, model_refs - both_refs AS model_only, pattern_refs - both_refs AS pattern_only, round(CAST(both_refs AS DOUBLE) / greatest(model_refs, 1), 6) AS recall, CASE WHEN both_refs >= 0.8 * model_refs THEN 'patterns' WHEN both_refs >= 0.5 * model_refs THEN 'hybrid' ELSE 'model' END AS verdict FROM s")
def a37_extractors_compared(spark, sf):
    """The patterns' references against the ones that came with the documents (A37, U3, T17x)."""
    patterns = F.concat(T.named_refs(F.col("body")), T.formal_refs(F.col("body")))
    return CI.compare_extractors(official(spark, sf).select("id", F.col("references").alias("model"), patterns.alias("pattern")))


@query(with_(CITATIONS) + """SELECT 'cites' AS direction, target_ref AS ref, citation_type AS type, target_level AS level, target_id AS other_id, o.title, o.site_key FROM cites LEFT JOIN official o ON o.id = target_id WHERE source_id = 100
UNION ALL SELECT 'cited by', target_ref, citation_type, source_level, source_id, o.title, o.site_key FROM cites JOIN official o ON o.id = source_id WHERE target_id = 100""")
def g01_document_citations(spark, sf):
    """What a document cites, resolved or not, and what cites it, as rows."""
    return G.document_citations(citations(spark, sf), official(spark, sf).select("id", "title", "site_key"), 100)


@query(with_(CITATIONS) + """, l AS (SELECT DISTINCT c.source_id, c.target_id, d.source_level AS lower, coalesce(u.source_level, 'unknown') AS upper FROM cites c JOIN (SELECT id, source_level FROM base) d ON d.id = c.source_id LEFT JOIN (SELECT id, source_level FROM base) u ON u.id = c.target_id WHERE c.target_id IS NOT NULL)
SELECT a.target_id AS root, a.source_id AS middle, b.source_id AS leaf, a.upper || ' > ' || a.lower || coalesce(' > ' || b.lower, '') AS levels FROM l a LEFT JOIN l b ON b.target_id = a.source_id AND b.source_id <> a.target_id WHERE a.upper = 'central'""")
def g06_chains(spark, sf):
    """Chains from a central document to what cites it and what cites that."""
    levels = official(spark, sf).join(S.sites(spark, sf), "site_key", "left").select("id", T.source_level(F.col("number"), F.col("admin_level")).alias("level"))
    return G.chains(citations(spark, sf), levels, "central")


@query(with_(CITATIONS) + "SELECT target_id, round(sum(CASE source_level WHEN 'central' THEN 3.0 WHEN 'provincial' THEN 2.0 WHEN 'municipal' THEN 1.5 WHEN 'district' THEN 1.0 WHEN 'department' THEN 1.0 ELSE 0.5 END::DOUBLE), 6) AS citation_rank FROM cites WHERE target_id IS NOT NULL GROUP BY 1")
def a09_corpus_rank(spark, sf):
    return CI.citation_rank(citations(spark, sf)).select("target_id", F.round("citation_rank", 6).alias("citation_rank"))


@query(with_(CITATIONS) + f""", miss AS (SELECT target_ref, source_id FROM cites WHERE target_id IS NULL AND citation_type = 'formal') SELECT {{}} AS source, count(*) AS refs, count(DISTINCT target_ref) AS distinct_refs, count(DISTINCT source_id) AS documents FROM miss GROUP BY 1 ORDER BY refs DESC, source LIMIT 20""".format("CASE " + " ".join(f"WHEN regexp_matches(target_ref, {quoted(p)}) THEN {quoted(v)}" for p, v in L.REACH) + " ELSE 'new: ' || substr(target_ref, 1, 2) END"))
def g12_frontier_ranked(spark, sf):
    """Sources that the corpus cites and lacks, the most cited first."""
    miss = citations(spark, sf).filter("target_id is null and citation_type = 'formal'")
    source = T.first_rule(F.col("target_ref"), L.REACH, "", "new")
    named = F.when(source == "new", F.concat(F.lit("new: "), F.substring("target_ref", 1, 2))).otherwise(source)
    return miss.groupBy(named.alias("source")).agg(F.count("*").alias("refs"), F.count_distinct("target_ref").alias("distinct_refs"), F.count_distinct("source_id").alias("documents")).orderBy(F.desc("refs"), "source").limit(20)
