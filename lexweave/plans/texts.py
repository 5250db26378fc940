"""Text, citation, HTML and date functions: on the driver's tables, and with the default lexicons on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import dates as D
from lexweave.functions import html as H
from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.operators.citations import build_citations, canonical_refs, extract_references, known_abbreviations
from lexweave.operators.joins import resolve_titles, two_keys
from lexweave.plans import standins as S
from lexweave.session import text_batches

BOOK = S.Book()
query = BOOK.query


def quoted(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(quoted(v) for v in x) + "]"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(quoted(v) for v in r) + ')' for r in rows)})"


def any_word(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"


BODIES = [
    (1, "按照国发〔2025〕11号和粤府办〔2024〕3号要求，落实《关于加快人工智能产业发展的实施方案》。"),
    (2, "根据财综（2023）5号、深府规〔2022〕8号，参见《深圳市促进人工智能发展行动计划（2024）》和《白皮书报告》。"),
    (3, "没有引用。"),
    (4, ""),
    (5, None),
    (6, "的通知国办发〔2019〕12号；苏州市住房和城乡建设局苏住建规〔2011〕4号；《短名》《国家数据安全管理条例办法》"),
]
_BODIES = "WITH " + values("b", "id, body", BODIES)
_FORMAL = L.FORMAL_REF.replace(r"[\x{4e00}-\x{9fff}]", r"[\x{4e00}-\x{9fff}]")


def bodies(spark):
    return spark.createDataFrame(BODIES, "id int, body string")


@query(_BODIES + f" SELECT id, array_to_string(regexp_extract_all(coalesce(body, ''), {quoted(_FORMAL)}, 1), '|') AS refs FROM b")
def t01_formal_refs(spark, sf):
    return bodies(spark).select("id", F.array_join(T.formal_refs(F.col("body")), "|").alias("refs"))


@query(_BODIES + f" SELECT id, array_to_string(regexp_extract_all(coalesce(body, ''), {quoted(L.NAMED_REF)}, 1), '|') AS refs FROM b")
def t02_named_refs(spark, sf):
    return bodies(spark).select("id", F.array_join(T.named_refs(F.col("body")), "|").alias("refs"))


NAMES = ["关于加快人工智能产业发展的实施方案", "国家数据安全管理条例", "广东省数字经济促进条例", "深圳市促进发展行动计划", "深圳市南山区扶持办法", "龙华区补贴措施", "深圳经济特区规定", "深圳区域发展报告", "人工智能白皮书方案", "随便一个名字", "全国标准清单", "讲话"]
_NAMES = "WITH " + values("n", "name", [(x,) for x in NAMES])


@query(_NAMES + f" SELECT name, {any_word('name', L.POLICY_WORDS)} AND NOT {any_word('name', L.NOT_POLICY_WORDS)} AS policy, CASE WHEN {any_word('name', L.CENTRAL_NAMES)} THEN 'central' WHEN {any_word('name', L.PROVINCIAL_NAMES)} THEN 'provincial' WHEN contains(name, '深圳市') AND NOT {any_word('name', L.DISTRICT_NAMES)} THEN 'municipal' WHEN {any_word('name', L.DISTRICT_NAMES)} THEN 'district' WHEN contains(name, '深圳') AND NOT contains(name, '区') THEN 'municipal' ELSE 'unknown' END AS level FROM n")
def t03_named_policy_and_level(spark, sf):
    n = spark.createDataFrame([(x,) for x in NAMES], "name string")
    return n.select("name", T.is_policy(F.col("name")).alias("policy"), T.named_level(F.col("name")).alias("level"))


NUMBERS = ["国发〔2025〕11号", "国办发明电〔2020〕1号", "依据粤府〔2019〕2号", "依据依照深府〔2019〕2号", "依照依据深府〔2019〕2号", "深府办规〔2021〕3号", "深府办〔2021〕3号", "深坪〔2020〕7号", "苏府〔2020〕7号", "ABC 12", "财综（2023）5号", ""]
_NUMBERS = "WITH " + values("n", "num", [(x,) for x in NUMBERS])
_CLEAN = "regexp_replace(regexp_replace(num, '^依据', ''), '^依照', '')"
_LEVEL = "CASE " + " ".join(f"WHEN {' OR '.join(f'starts_with({_CLEAN}, {quoted(p)})' for p in ps)} THEN {quoted(k)}" for k, ps in L.LEVEL_PREFIXES.items()) + " ELSE 'unknown' END"
_ISSUER = "coalesce((SELECT arg_max(label, length(prefix)) FROM t WHERE starts_with(num, prefix)), nullif(regexp_extract(num, '^([\\x{4e00}-\\x{9fff}]+)', 1), ''), 'Unknown')"


@query(_NUMBERS + f" SELECT num, {_LEVEL} AS level FROM n")
def t05_admin_level(spark, sf):
    return spark.createDataFrame([(x,) for x in NUMBERS], "num string").select("num", T.admin_level(F.col("num")).alias("level"))


@query(_NUMBERS + ", " + values("t", "prefix, label", list(L.ISSUERS.items())) + f" SELECT num, {_ISSUER} AS issuer FROM n")
def t06_issuer(spark, sf):
    return spark.createDataFrame([(x,) for x in NUMBERS], "num string").select("num", T.issuer(F.col("num")).alias("issuer"))


REFS = ["按照财库〔2022〕3号", "根据依据国发〔2020〕1号", "苏州市住房和城乡建设局苏住建规〔2011〕4号", "的通知国发〔2009〕12号", "广东证监〔2010〕1号", "国发〔2009〕12号", "很长很长的前缀文字深府〔2018〕9号", "无核心文本", "苏住建规〔2012〕6号", "证监〔2012〕6号"]
_REFS = "WITH " + values("r", "ref", [(x,) for x in REFS])
_NORM = f"trim(regexp_replace(ref, {quoted(L.LEAD_IN)}, ''))"


@query(_REFS + f" SELECT ref, {_NORM} AS norm, regexp_extract({_NORM}, {quoted(L.FORMAL_CORE)}) AS core FROM r")
def t07_normalized_refs(spark, sf):
    n = T.normalize_ref(F.col("ref"))
    return spark.createDataFrame([(x,) for x in REFS], "ref string").select("ref", n.alias("norm"), T.ref_core(n).alias("core"))


_KNOWN = f""", p AS (SELECT ref, norm, core, CASE WHEN core <> '' THEN left(norm, length(norm) - length(core)) END AS prefix FROM (SELECT ref, {_NORM} AS norm, regexp_extract({_NORM}, {quoted(L.FORMAL_CORE)}) AS core FROM r)),
{values('listed', 'word', [(k,) for k in L.ISSUERS if not k.startswith(('依据', '依照'))])},
known AS (SELECT word FROM listed UNION SELECT prefix FROM p WHERE length(prefix) BETWEEN 2 AND 6 AND NOT regexp_matches(prefix, {quoted(L.HEAD_NOISE)})),
hit AS (SELECT ref, arg_max(word, length(word)) AS word FROM (SELECT p.ref, known.word, left(prefix, length(prefix) - length(word)) AS head, prefix FROM p JOIN known ON length(word) >= 2 AND length(word) < length(prefix) AND ends_with(prefix, word) WHERE prefix NOT IN (SELECT word FROM known))
 WHERE regexp_matches(head, {quoted('[' + L.ORG_MARKERS + ']')}) OR regexp_matches(head, {quoted(L.HEAD_NOISE)}) OR length(prefix) > 8 GROUP BY 1)
"""


@query(_REFS + _KNOWN + "SELECT p.ref, CASE WHEN word IS NOT NULL THEN word || core ELSE norm END AS canonical FROM p LEFT JOIN hit USING (ref)")
def t10_canonical_refs(spark, sf):
    """T8x-T10x and J14: issuer names and sentence pieces in front of a known abbreviation go."""
    r = spark.createDataFrame([(x,) for x in REFS], "ref string")
    none = spark.createDataFrame([], "number string")
    return canonical_refs(r, known_abbreviations(none, r)).select("ref", "canonical")


TITLES = [(3, "《中华人民共和国网络安全法》"), (1, "城市、镇控制性详细规划编制审批办法"), (2, "城市镇控制性详细规划编制审批办法"), (4, "关于促进 数据要素市场发展的若干措施"), (5, "数据要素市场发展的若干措施细则说明"), (6, "短题"), (7, "促进数据要素市场"), (8, "")]
ASKED = ["网络安全法", "城市镇控制性详细规划编制审批办法（试行）", "城市镇控制性详细规划编制审批办法", "要素市场发展的若干", "数据", "毫无关系的一个名称而已", "关于促进数据要素市场发展的若干措施的通知"]
_PUNCT = L.TITLE_PUNCTUATION.replace(r"\x{3000}", "　")
_NT = "regexp_replace(regexp_replace({c}, " + quoted(_PUNCT) + ", '', 'g'), '^" + L.TITLE_PREFIX + "', '')"
_TITLES = "WITH " + values("t0", "id, raw", TITLES) + ", " + values("n0", "raw", [(x,) for x in ASKED]) + f", t AS (SELECT title, min(id) AS id FROM (SELECT {_NT.format(c='raw')} AS title, id FROM t0) WHERE title <> '' GROUP BY 1), n AS (SELECT DISTINCT {_NT.format(c='raw')} AS name FROM n0)"


@query("WITH " + values("t0", "id, raw", TITLES) + f" SELECT id, {_NT.format(c='raw')} AS title FROM t0")
def t11_normalized_titles(spark, sf):
    return spark.createDataFrame(TITLES, "id int, raw string").select("id", T.norm_title(F.col("raw")).alias("title"))


@query(_TITLES + """, e AS (SELECT name, id FROM n JOIN t ON name = title), a AS (SELECT name, arg_max(id, length(title) * 1000 - instr(name, title)) AS id FROM n JOIN t ON contains(name, title) AND length(title) >= 8 WHERE name NOT IN (SELECT name FROM e) GROUP BY 1),
b AS (SELECT name, arg_min(id, length(title) * 1000 + id) AS id FROM n JOIN t ON contains(title, name) AND length(title) >= 8 WHERE length(name) >= 4 AND name NOT IN (SELECT name FROM e) AND name NOT IN (SELECT name FROM a) GROUP BY 1)
SELECT name, id, 'equal' AS how FROM e UNION ALL SELECT name, id, 'title in name' FROM a UNION ALL SELECT name, id, 'name in title' FROM b""")
def j12_resolved_titles(spark, sf):
    t = spark.createDataFrame(TITLES, "id int, raw string").select("id", T.norm_title(F.col("raw")).alias("title"))
    n = spark.createDataFrame([(x,) for x in ASKED], "raw string").select(T.norm_title(F.col("raw")).alias("name"))
    return resolve_titles(n, t)


HELD = [(1, "国发〔2025〕11号"), (2, "国发[2025]11号"), (3, "粤府（2024） 3号"), (4, "国发〔2025〕11号"), (5, "")]
CITED = ["国发〔2025〕11号", "粤府〔2024〕3号", "国发(2025)11号", "深府〔2000〕1号"]
_DN = "regexp_replace({c}, " + quoted(L.DOCNUM_PUNCTUATION.replace(r"\x{3000}", "　")) + ", '', 'g')"


@query("WITH " + values("h", "id, num", HELD) + ", " + values("c", "ref", [(x,) for x in CITED]) + f" SELECT ref, coalesce((SELECT max(id) FROM h WHERE num = ref), (SELECT min(id) FROM h WHERE num <> '' AND {_DN.format(c='num')} = {_DN.format(c='ref')})) AS target_id FROM c")
def j15_two_key_lookup(spark, sf):
    h = spark.createDataFrame(HELD, "id int, number string").withColumn("number_norm", T.norm_docnum(F.col("number")))
    c = spark.createDataFrame([(x,) for x in CITED], "ref string")
    return two_keys(c, h, F.col("ref"), T.norm_docnum(F.col("ref"))).select("ref", "target_id")


@query("WITH " + values("s", "num, site", [("国发〔2025〕11号", "media"), ("", "department"), ("", "central"), ("x", None)]) + f" SELECT num, site, coalesce(nullif({_LEVEL}, 'unknown'), CASE WHEN site = 'department' THEN 'municipal' ELSE coalesce(site, 'unknown') END) AS level FROM s")
def t13_source_level(spark, sf):
    s = spark.createDataFrame([("国发〔2025〕11号", "media"), ("", "department"), ("", "central"), ("x", None)], "num string, site string")
    return s.select("num", "site", T.source_level(F.col("num"), F.col("site")).alias("level"))


CORPUS = [
    (1, "gov", "国务院关于加快人工智能产业发展的实施方案", "国发〔2025〕11号", "全文。", []),
    (2, "gd", "广东省人工智能产业发展行动计划", "粤府〔2025〕5号", "根据国发〔2025〕11号，落实《关于加快人工智能产业发展的实施方案》。", []),
    (3, "sz", "深圳市人工智能行动方案", "深府〔2025〕2号", "按照《广东省人工智能产业发展行动计划》推进。", []),
    (4, "latepost", "大模型观察", "", "媒体文章。", ["广东省人工智能产业发展行动计划", "关于加快人工智能产业发展的实施方案", "短"]),
    (5, "gov", "解读：国务院关于加快人工智能产业发展的实施方案", "", "解读全文。", ["国务院关于加快人工智能产业发展的实施方案"]),
    (6, "sz", "出租车管理通知", "", "无关。", []),
]
SITES4 = [("gov", "central"), ("gd", "provincial"), ("sz", "municipal"), ("latepost", "media")]
EXPECTED = [
    (2, "国发〔2025〕11号", 1, "formal", "provincial", "central"), (2, "关于加快人工智能产业发展的实施方案", 1, "named", "provincial", "unknown"), (3, "广东省人工智能产业发展行动计划", 2, "named", "municipal", "provincial"),
    (4, "广东省人工智能产业发展行动计划", 2, "llm", "media", "provincial"), (4, "关于加快人工智能产业发展的实施方案", 1, "llm", "media", "unknown"), (5, "国务院关于加快人工智能产业发展的实施方案", 1, "llm", "central", "central"),
]


def corpus(spark):
    docs = spark.createDataFrame(CORPUS, "id int, site_key string, title string, number string, body string, references array<string>")
    return docs, spark.createDataFrame(SITES4, "site_key string, admin_level string")


@query("WITH " + values("e", "source_id, target_ref, target_id, citation_type, source_level, target_level", EXPECTED) + " SELECT * FROM e")
def t14_citations(spark, sf):
    """The whole builder on a small corpus; the SQL states the expected edges."""
    return build_citations(*corpus(spark))


@query(_BODIES + f""" SELECT id, r[1] AS ref, CAST(r[2] AS INTEGER) AS pos FROM (SELECT id, unnest(list_transform(l, lambda x, i: [x, CAST(i - 1 AS VARCHAR)])) AS r FROM (SELECT id, list_filter(l0, lambda x, i: list_position(l0, x) = i) AS l FROM (SELECT id, list_concat(regexp_extract_all(coalesce(body, ''), {quoted(L.NAMED_REF)}, 1), regexp_extract_all(coalesce(body, ''), {quoted(_FORMAL)}, 1)) AS l0 FROM b)))""")
def t16_extracted_references(spark, sf):
    return extract_references(bodies(spark))


DOC_TITLES = ["深圳经济特区条例", "关于印发行动计划的通知", "关于印发办法的通知", "人才补贴申报指南", "公示2024年名单", "解读条例", "关于开会的通知", "一图读懂", "行业标准", "某公司对话", None, "", "什么都不是"]


@query("WITH " + values("d", "title", [(x,) for x in DOC_TITLES]) + " SELECT title, CASE WHEN coalesce(title, '') = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches(title, {quoted(p)}) THEN {quoted(v)}" for p, v in L.DOC_TYPES) + " ELSE 'other' END AS kind FROM d")
def t18_doc_types(spark, sf):
    return spark.createDataFrame([(x,) for x in DOC_TITLES], "title string").select("title", T.first_rule(F.col("title"), L.DOC_TYPES, "unknown", "other").alias("kind"))


RELEVANCE = [(1, "人工智能发展规划", "人工智能" * 6 + "算力和GPU" + "文" * 300, "芯片"), (2, "出租车", "无关内容", ""), (3, "", "机器人", None), (4, None, None, None), (5, "数据中心", "算力" * 4 + "5G", "云计算")]


def relevance_sql(terms: dict[str, int], title: str, body: str, keywords: str) -> str:
    head = f"(coalesce({title}, '') || ' ' || coalesce({keywords}, ''))"
    count = lambda c, t: f"(CAST(length({c}) - length(replace({c}, {quoted(t)}, '')) AS DOUBLE) / {len(t)})"
    b = f"coalesce({body}, '')"
    raw = " + ".join(f"{w} * (CASE WHEN {count(b, t)} > 3 THEN 3 + sqrt({count(b, t)} - 3) ELSE {count(b, t)} END + 3 * {count(head, t)})" for t, w in terms.items())
    hits = " + ".join(f"CASE WHEN contains({b}, {quoted(t)}) OR contains({head}, {quoted(t)}) THEN 1 ELSE 0 END" for t in terms)
    adjusted = f"(({raw}) / sqrt(greatest(length({b}), 100)) * (1 + least({hits}, 8) * 0.1::DOUBLE))"
    return f"CAST(round_even({adjusted} / ({adjusted} + 8), 3) AS DOUBLE)"


@query("WITH " + values("d", "id, title, body, keywords", RELEVANCE) + f" SELECT id, {relevance_sql(L.AI_TERMS, 'title', 'body', 'keywords')} AS score FROM d")
def t19_relevance(spark, sf):
    d = spark.createDataFrame(RELEVANCE, "id int, title string, body string, keywords string")
    return d.select("id", T.relevance(F.col("title"), F.col("body"), F.col("keywords")).alias("score"))


ENGLISH = {"license": 8, "the": 1, "tion": 2, "ing": 2, "with": 3, "from": 3, "Apache": 9}


@query(f"SELECT doc_id, {relevance_sql(ENGLISH, 'split_part(text, chr(10), 1)', 'text', 'lang')} AS score FROM documents")
def t19_relevance_of_documents(spark, sf):
    d = S.read(spark, sf, "documents")
    return d.select("doc_id", T.relevance(F.substring_index("text", "\n", 1), F.col("text"), F.col("lang"), ENGLISH).alias("score"))


AMOUNTS = [(1, "给予最高500万元资助，另补2.5亿元。不足0.4万元不计。"), (2, "每家0.5万元；合计20000亿元"), (3, "无金额"), (4, "第一 3 万元，第二 10万元")]


def amounts_sql(pattern: str, number: int) -> str:
    part = lambda k: f"regexp_extract_all(body, {quoted(pattern)}, {k})"
    value = "CAST(z[1] AS DOUBLE) * CASE z[2] WHEN '亿元' THEN 10000 ELSE 1 END"
    return "WITH " + values("d", "id, body", AMOUNTS) + f" SELECT id, CAST({value} AS DOUBLE) AS amount_value, z[1] || z[2] AS amount_raw FROM (SELECT id, unnest(list_transform(list_zip({part(number)}, {part(number + 1)}), lambda x: [x[1], x[2]])) AS z FROM d) WHERE {value} BETWEEN 0.5 AND 10000000"


@query(amounts_sql(L.AMOUNT_IN_CONTEXT, 2))
def t21_amounts(spark, sf):
    d = spark.createDataFrame(AMOUNTS, "id int, body string")
    return d.select("id", F.explode(T.amounts(F.col("body"))).alias("a")).select("id", "a.amount_value", "a.amount_raw")


@query(amounts_sql(r"(\d+(?:\.\d+)?)\s*(万元|亿元)", 1))
def t21_plain_amounts(spark, sf):
    d = spark.createDataFrame(AMOUNTS, "id int, body string")
    return d.select("id", F.explode(T.plain_amounts(F.col("body"))).alias("a")).select("id", "a.amount_value", "a.amount_raw")


@query("WITH " + values("d", "id, body", AMOUNTS + [(9, "支持人工智能、芯片和5G")]) + f" SELECT id, array_to_string(list_filter({quoted(L.SECTORS)}, lambda w: contains(body, w)), ',') AS sectors FROM d")
def t22_sectors(spark, sf):
    d = spark.createDataFrame([*AMOUNTS, (9, "支持人工智能、芯片和5G")], "id int, body string")
    return d.select("id", F.array_join(T.sectors(F.col("body")), ",").alias("sectors"))


@query(_BODIES + f" SELECT id, CASE WHEN starts_with(n, '按照国') THEN n ELSE '' END AS number FROM (SELECT id, regexp_extract(substr(coalesce(body, ''), 1, 140), {quoted(_FORMAL)}, 1) AS n FROM b)")
def t23_masthead(spark, sf):
    return bodies(spark).select("id", T.masthead_number(F.col("body"), F.lit("按照国")).alias("number"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) / 3.0::DOUBLE AS hits, CAST(length(translate(text, '.,', '')) AS INTEGER) AS bare FROM documents")
def t29_term_counts(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", T.occurrences(F.col("text"), "the").alias("hits"), F.length(T.strip_punctuation(F.col("text"), ".,")).alias("bare"))


@query("SELECT doc_id, CASE WHEN instr(text, 'tion') > 0 THEN replace(substr(text, greatest(1, instr(text, 'tion') - 75), 150), 'tion', '<mark>tion</mark>') ELSE replace(substr(text, 1, 150), 'tion', '<mark>tion</mark>') END AS snippet FROM documents")
def t27_snippets(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", T.snippet(F.col("text"), "tion").alias("snippet"))


MIXED = [(1, "人工智能 AI law"), (2, "plain text"), (3, "全中文"), (4, "123"), (5, "??a?")]


@query("WITH " + values("d", "id, t", MIXED) + " SELECT id, round(CASE WHEN c + l > 0 THEN c / (c + l) ELSE 0 END, 6) AS ratio, c > 0 AS chinese, id = 5 AS corrupted FROM (SELECT id, CAST(length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS DOUBLE) AS c, CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS DOUBLE) AS l FROM d)")
def t30_language_ratio(spark, sf):
    t = F.col("t")
    return spark.createDataFrame(MIXED, "id int, t string").select("id", F.round(T.language_ratio(t), 6).alias("ratio"), T.has_chinese(t).alias("chinese"), T.looks_corrupted(t).alias("corrupted"))


@query("WITH " + values("e", "slug, title", [("law-of-the-sea", "Law of the Sea"), ("the-new-act", "The New Act"), ("x", "X")]) + " SELECT * FROM e")
def t31_slug_titles(spark, sf):
    return spark.createDataFrame([("law-of-the-sea",), ("the-new-act",), ("x",)], "slug string").select("slug", T.slug_title(F.col("slug")).alias("title"))


@query("WITH " + values("e", "id, issuer, day", [(1, "Ministry", "2024-01-02"), (2, "", "2020")]) + " SELECT * FROM e")
def t32_key_blocks(spark, sf):
    d = spark.createDataFrame([(1, "Issuer: Ministry\nDate： 2024-01-02\nText"), (2, "date: 2020\nno more")], "id int, t string")
    m = T.key_block(F.col("t"), ["Issuer", "Date"])
    return d.select("id", m["Issuer"].alias("issuer"), m["Date"].alias("day"))


ORGS = ["深圳市发展和改革委员会主任", "在清华大学学习", "广东省人民政府副秘书长，", "某公司", "市长", None, "国务院办公厅秘书局局长"]


@query("WITH " + values("e", "org, key", [(ORGS[0], "深圳市发展和改革委员会"), (ORGS[1], None), (ORGS[2], "广东省人民政府"), (ORGS[3], None), (ORGS[4], None), (ORGS[5], None), (ORGS[6], "国务院办公厅秘书局")]) + " SELECT * FROM e")
def t35_organisations(spark, sf):
    return spark.createDataFrame([(x,) for x in ORGS], "org string").select("org", T.normalize_org(F.col("org")).alias("key"))


@query("WITH " + values("e", "id, kind, n", [(1, "law", 2), (2, "other", None), (3, "other", None)]) + " SELECT * FROM e")
def t43_model_answers(spark, sf):
    d = spark.createDataFrame([(1, '```json\n{"kind": "law", "n": 2}\n```'), (2, 'so: {"kind": "poem"}'), (3, "no answer")], "id int, raw string")
    j = T.llm_json(F.col("raw"), "kind string, n int")
    return d.select("id", T.clamp(j["kind"], ["law", "plan"], "other").alias("kind"), j["n"].alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def t15_json_column(spark, sf):
    return S.read(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("WITH " + values("e", "id, faults", [(1, ""), (2, "length"), (3, "number"), (4, "untranslated")]) + " SELECT * FROM e")
def t39_translation_checks(spark, sf):
    d = spark.createDataFrame([(1, "规定2024年", "Rule of 2024"), (2, "一二三四五六七八九十", "No"), (3, "共有15个", "There are many"), (4, "中" * 16, "中" * 16)], "id int, s string, t string")
    return d.select("id", F.array_join(T.translation_faults(F.col("s"), F.col("t")), ",").alias("faults"))


@query("WITH " + values("e", "text, marked", [("Support ", False), ("AI", True), (" firms", False)]) + " SELECT * FROM e")
def t28_marked_clauses(spark, sf):
    return spark.createDataFrame([("Support {AI} firms",)], "t string").select(F.inline(T.marks(F.col("t"))))


@query("WITH " + values("e", "t, terms", [("the net law", "law,net"), ("nothing", "")]) + " SELECT * FROM e")
def t40_glossary(spark, sf):
    d = spark.createDataFrame([("the net law",), ("nothing",)], "t string")
    return d.select("t", F.array_join(F.array_sort(F.map_keys(T.glossary_subset(F.col("t"), {"law": "法", "net": "网", "tax": "税"}))), ",").alias("terms"))


# Pages


def decoded(c: str) -> str:
    for entity, text in H.ENTITIES.items():
        c = f"replace({c}, {quoted(entity)}, {quoted(text)})"
    return c


@query(f"SELECT page_id, trim({decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS title FROM pages")
def h08_titles(spark, sf):
    return S.read(spark, sf, "pages").select("page_id", H.title(F.col("html")).alias("title"))


_INNER = "regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<br>|</p>|</h1>', chr(10), 'g'), '<[^>]+>', '', 'g')"


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace({decoded(_INNER)}, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), ' ' || chr(10)) AS body FROM pages")
def h01_bodies(spark, sf):
    body = H.body_text(F.col("html"), "<article>", ["</article>", "<footer"], least=0)
    return S.read(spark, sf, "pages").select("page_id", F.trim(body, F.lit(" \n")).alias("body"))


_P = decoded("regexp_replace(regexp_replace(x, '<br>', chr(10), 'g'), '<[^>]+>', '', 'g')")


@query(f"SELECT page_id, CAST(len(p) AS INTEGER) AS paragraphs, coalesce(CAST(list_sum(list_transform(p, lambda x: length(x))) AS BIGINT), 0) AS chars FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<p>(.*?)</p>', 1), lambda x: trim(regexp_replace({_P}, '\\s*\\n\\s*', chr(10), 'g'), ' ')), lambda x: length(x) >= 20) AS p FROM pages)")
def h07_paragraphs(spark, sf):
    p = H.paragraphs(H.container(F.col("html"), "<article>", ["</article>"]), least=20)
    return S.read(spark, sf, "pages").select("page_id", p.alias("p")).select("page_id", F.size("p").alias("paragraphs"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("SELECT page_id, CAST(len(h) AS INTEGER) AS links_n, h[1] AS first_link FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages)")
def h06_links(spark, sf):
    h = H.links(F.col("html"))
    return S.read(spark, sf, "pages").select("page_id", F.size(h).alias("links_n"), F.get(h, F.lit(0)).alias("first_link"))


_HEX = "0123456789abcdef" * 2
# One anchor of each address: (its end with N for the page's number, the day that the row or the address gives).
_ROWS = [
    ("/xw/t20240305_N.html", "2024-03-05"), ("/art/2023/4/9/art_N_1.html", "2023-04-09"), ("/art/2022/art_0aN.html", "2022-01-01"), ("/x/2021-03/04/content_N.shtml", "2021-03-04"), ("/x/20240506/abcdef12N/c.html", "2024-05-06"),
    ("/web/a/202301021234N/index.shtml", "2023-01-02"), ("/2020/02/29/ARTIN.shtml", "2020-02-29"), ("/s/12345N/index.html", None), ("/s/202402301234N/index.html", None), (f"/s/202211/{_HEX}.html", "2022-11-01"), ("/pnidpvN.html", None),
    ("/cN/content.html", None), ("/portal/article/2/abcdef12N", None), ("/p1/3/N.html", None), ("/fabu/xiangqing/N.html", None), ("/a/2019-08-07/N.html", "2019-08-07"), ("/safe/2018/0709/N.html", "2018-07-09"), ("/a/20170605/N.html", "2017-06-05"),
    (f"/a/2016/5/4/{_HEX}.shtml", "2016-05-04"), (f"/columns/{'ab12' * 9}/202306/07/{'cd34' * 9}.html", "2023-06-07"), (f"/a/20150403/{_HEX}.html", "2015-04-03"),
]


@query(
    "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || replace(r.tail, 'N', CAST(page_id % 1000 AS VARCHAR)) AS url, CASE WHEN r.k % 2 = 0 THEN 'Named & ' || r.k ELSE 'Row ' || r.k || ' of ' || page_id END AS title,"
    " CASE WHEN r.k % 5 = 4 THEN DATE '2001-02-03' ELSE CAST(r.day AS DATE) END AS day FROM pages, (SELECT unnest([" + ", ".join(f"{{'k': {k}, 'tail': '{t}', 'day': " + (f"'{d}'" if d else "CAST(NULL AS VARCHAR)") + "}" for k, (t, d) in enumerate(_ROWS)) + "]) AS r)"
)
def h06_list_rows(spark, sf):
    """Every page is followed by a list of articles, each anchor twice, one on another host and one without an article's address."""
    at = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    far, parts = "<p>" + "-" * 300 + "</p>", []
    for k, (tail, _) in enumerate(_ROWS):
        address = F.replace(F.lit(tail), F.lit("N"), (F.col("page_id") % 1000).cast("string"))
        title = F.lit(f' title="Named &amp; {k}"' if k % 2 == 0 else "")
        parts += [F.lit(f'{far}<li><a class="i" href="'), F.concat(at, address) if k % 3 == 0 else address, F.lit('"'), title, F.lit(f">Row <b>{k}</b>\n of "), F.col("page_id").cast("string"), F.lit("</a>" + (" <i>2001-02-03</i>" if k % 5 == 4 else "") + "</li>")]
        parts += [F.lit(far + '<a href="'), address, F.lit('">again</a><a href="http://else.example'), address, F.lit('">else</a><a href="/more/">more</a>')]
    p = S.read(spark, sf, "pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), *parts).alias("html"))
    return p.select("page_id", F.inline(H.list_rows(F.col("html"), F.col("url"))))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS section, NOT contains(url, '/../') AS same FROM pages")
def h14_url_parts(spark, sf):
    u = F.col("url")
    return S.read(spark, sf, "pages").select("page_id", H.host(u).alias("host"), H.section(u).alias("section"), H.same_site(u, u).alias("same"))


@query("SELECT CASE WHEN contains(html, '<nav>') AND contains(html, '<article>') THEN 'semantic' ELSE 'unknown' END AS system, count(*) AS n, CAST(sum(len(regexp_extract_all(html, '<li>'))) AS BIGINT) AS items FROM pages GROUP BY 1")
def h11_page_systems(spark, sf):
    kind = H.cms(F.col("html"), [("wp-content", "wordpress"), (r"(?s)<nav>.*<article>", "semantic")])
    return S.read(spark, sf, "pages").groupBy(kind.alias("system")).agg(F.count("*").alias("n"), F.sum(F.regexp_count("html", F.lit("<li>"))).cast("long").alias("items"))


_PAGE_TEXT = "regexp_replace(html, '(?s)<[^>]+>', ' ', 'g')"


@query(f"SELECT page_id, length(trim(t, ' ' || chr(9) || chr(10) || chr(13))) < 2000 AND regexp_matches(t, '(?i)found|404') AS soft FROM (SELECT page_id, coalesce({_PAGE_TEXT}, '') AS t FROM pages)")
def h10_soft_404(spark, sf):
    text = F.regexp_replace("html", "(?s)<[^>]+>", " ")
    return S.read(spark, sf, "pages").select("page_id", H.soft_404(text, words="(?i)found|404").alias("soft"))


@query("SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS inner_html FROM pages")
def h04_balanced_element(spark, sf):
    """A div with a marker, cut at its own closing tag."""
    text_batches(spark)
    wrapped = F.concat(F.lit("<body><div><div class='main' id='x'>"), F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), F.lit("</div><div>after</div></div>"))
    return S.read(spark, sf, "pages").select("page_id", H.balanced_div(wrapped, F.lit("id='x'")).alias("inner_html"))


@query()
def h03_densest_block(spark, sf):
    text_batches(spark)
    return S.read(spark, sf, "pages").select("page_id", H.densest_div(F.col("html")).alias("body"))


HTML = [(1, '<meta name="PubDate" content="2024-03-05"><table><tr><th>Issuer</th><td>Office</td></tr><tr><td>No.</td><td>12</td></tr></table><a href="/a/b.doc">d</a><a href="/a/c.pdf">p</a> 共 45 条 {"content": "a\\u4e2d\\"b"}'), (2, "<p>nothing</p>")]


@query("WITH " + values("e", "id, day, issuer, file, pages_n, content", [(1, "2024-03-05", "Office", "/a/c.pdf", 3, 'a中"b'), (2, "", None, "", 1, None)]) + " SELECT * FROM e")
def h09_page_metadata(spark, sf):
    """T33x, H2, H9, H15 on a small page."""
    h = F.col("html")
    return spark.createDataFrame(HTML, "id int, html string").select("id", H.meta(h, "PubDate").alias("day"), F.try_element_at(H.table_pairs(h), F.lit("Issuer")).alias("issuer"), H.attachment(h).alias("file"), H.total_pages(h, [r"共\s*(\d+)\s*条"], 20).alias("pages_n"), H.embedded_json(h, "content").alias("content"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def h16_flat_json(spark, sf):
    return S.read(spark, sf, "events").select("event_id", H.flat_json(F.col("props"))["k"].alias("k"))


# Dates


@query("SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS DATE)) - 28800 AS BIGINT) AS stamp, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def d01_epoch_round_trip(spark, sf):
    stamp = D.epoch_of(F.to_date("o_orderdate"))
    return S.read(spark, sf, "orders").select("o_orderkey", stamp.alias("stamp")).select("o_orderkey", "stamp", D.day_of(F.col("stamp")).alias("day"), D.year_of(F.col("stamp")).alias("year"))


RAW_DAYS = [("2024年3月5日", "2024-03-05"), ("2024.3.5", "2024-03-05"), ("2024/12/31", "2024-12-31"), ("2024-03", "2024-03-01"), ("2024年11月", "2024-11-01"), ("2024-02-30", None), ("x", None), ("", None), (None, None), (" 2024-01-02 10:00", "2024-01-02")]


@query("WITH " + values("e", "raw, d", RAW_DAYS) + " SELECT raw, CAST(d AS DATE) AS day FROM e")
def d03_parsed_days(spark, sf):
    return spark.createDataFrame([(r,) for r, _ in RAW_DAYS], "raw string").select("raw", D.parse_day(F.col("raw")).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def d05_compact_days(spark, sf):
    """Numbers that read as YYYYMMDD are days; months out of range aren't."""
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy'99'dd"))
    return S.read(spark, sf, "orders").select("o_orderkey", D.compact_day(raw).alias("day"))


@query("SELECT event_id, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m') AS month FROM events")
def d04_millis_and_months(spark, sf):
    day = D.from_millis(F.unix_millis(F.col("ts").cast("timestamp")))
    return S.read(spark, sf, "events").select("event_id", day.alias("day"), D.month_key(day).alias("month"))


SPANS = [(1, 2000 * 12 + 1, 2004 * 12, 2002 * 12, None), (2, 2000 * 12, None, 2010 * 12, None), (3, 24000, 24012, 24012, 24020)]


@query("WITH " + values("e", "id, shared", [(1, 24), (2, 0), (3, 0)]) + " SELECT * FROM e")
def d06_shared_months(spark, sf):
    s = spark.createDataFrame(SPANS, "id int, a int, b int, c int, d int")
    return s.select("id", D.overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("shared"))
