"""Careers: lines of posts from texts, their places and levels, and repair of birth years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import lexicons as L
from lexweave.functions.text import contains_any


def province(text: Column, names: list[str] = L.PROVINCES) -> Column:
    """T37x: the first name of the list that occurs."""
    return F.get(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(text, n)), F.lit(0))


def post_level(text: Column) -> Column:
    """T37x: central bodies first; then municipalities of provincial rank, cities, districts; any other province last."""
    p = province(text)
    return (
        F.when(contains_any(text, L.CENTRAL_ORGS), "central")
        .when(p.isin("北京", "天津", "上海", "重庆"), "provincial")
        .when(text.contains("市") & ~text.contains("区"), "municipal")
        .when(text.contains("区") | text.contains("县"), "district")
        .when(p.isNotNull(), "provincial")
        .otherwise("unknown")
    )


def career_text(page_text: Column, description: Column) -> Column:
    """T38x: timeline lines, else at most 50 lines with words of office, else the description."""
    lines = F.transform(F.split(page_text, "\n"), lambda x: F.trim(x))
    dated = F.filter(lines, lambda x: x.rlike(r"^\d{4}[.\-年]") & (F.length(x) > 15))
    spoken = F.slice(F.filter(lines, lambda x: x.rlike("|".join(L.CAREER_WORDS)) & (F.length(x) > 20)), 1, 50)
    return F.when(F.size(dated) > 0, F.array_join(dated, "\n")).when(F.size(spoken) > 0, F.array_join(spoken, "\n")).otherwise(F.coalesce(description, F.lit("")))


def career_records(people: DataFrame, text: str = "career_text", key: str = "person_id") -> DataFrame:
    """T36x/W2: posts in the order of lines. An open end is the next post's start."""
    lines = people.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "raw")).withColumn("raw_text", F.trim("raw")).filter("raw_text <> '' and not raw_text rlike '^[（(]'")
    part = lambda p, k: F.nullif(F.regexp_extract("raw_text", p, k), F.lit(""))
    dotted, years = F.col("raw_text").rlike(L.CAREER_DOTTED), F.col("raw_text").rlike(L.CAREER_YEARS)
    choose = lambda d, y, p: F.when(dotted, d).when(years, y).otherwise(p)
    none = F.lit(None).cast("string")
    posts = lines.select(
        key, "pos", "raw_text",
        choose(part(L.CAREER_DOTTED, 1), part(L.CAREER_YEARS, 1), part(L.CAREER_PROSE, 1)).cast("int").alias("start_year"), choose(part(L.CAREER_DOTTED, 2), none, part(L.CAREER_PROSE, 2)).cast("int").alias("start_month"),
        choose(part(L.CAREER_DOTTED, 3), part(L.CAREER_YEARS, 2), none).cast("int").alias("end_year"), choose(part(L.CAREER_DOTTED, 4), none, none).cast("int").alias("end_month"),
        F.trim(choose(part(L.CAREER_DOTTED, 5), part(L.CAREER_YEARS, 3), part(L.CAREER_PROSE, 3))).alias("post"),
    )
    posts = posts.filter(F.col("start_year").isNotNull() & F.length("post").between(2, 200) & ~contains_any(F.col("post"), L.NOT_POSTS))
    org, rest = F.regexp_extract("post", L.ORG_END, 1), F.regexp_extract("post", L.ORG_END, 2)
    split = F.length(rest) > 1
    w = Window.partitionBy(key).orderBy("pos")
    open_end = F.col("end_year").isNull()
    return posts.select(
        key, "pos", F.when(split, rest).otherwise(F.col("post")).alias("position"), F.when(split, org).otherwise(F.col("post")).alias("organization"), province(F.col("post")).alias("province"), post_level(F.col("post")).alias("admin_level"), "start_year", "start_month",
        F.when(open_end, F.lead("start_year").over(w)).otherwise(F.col("end_year")).alias("end_year"), F.when(open_end, F.lead("start_month").over(w)).otherwise(F.col("end_month")).alias("end_month"), "raw_text",
    )


def birth_year_repairs(people: DataFrame, careers: DataFrame, candidates: DataFrame, start_age: int = 22, tolerance: int = 20) -> DataFrame:
    """T42x: (person_id, old_year, new_year) where the recorded year can't fit the first post and another candidate of the
    same name fits better. people: person_id, name, birth_year; candidates: name, birth_year."""
    estimate = careers.filter("start_year > 1900").groupBy("person_id").agg((F.min("start_year") - start_age).alias("estimate"))
    several = candidates.distinct().groupBy("name").agg(F.collect_set("birth_year").alias("years")).filter(F.size("years") > 1)
    far = people.join(estimate, "person_id").filter(F.abs(F.col("birth_year") - F.col("estimate")) > tolerance).join(several, "name")
    best = F.array_min(F.transform("years", lambda y: F.struct(F.abs(y - F.col("estimate")).alias("d"), y.alias("y"))))
    return far.withColumn("b", best).filter(F.col("b.d") < F.abs(F.col("birth_year") - F.col("estimate"))).select("person_id", F.col("birth_year").alias("old_year"), F.col("b.y").alias("new_year"))


def label_level(label: Column) -> Column:
    """T24x: level by an issuer's English label."""
    out, low = None, F.lower(label)
    for level, words in L.LABEL_LEVELS:
        test = contains_any(low, words)
        out = F.when(test, level) if out is None else out.when(test, level)
    return out.otherwise("unknown")
