"""Pages put together from several tables: profiles, collections, annotations, branches of sites, the daily report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as T
from lexweave.operators.graph import closure
from lexweave.operators.joins import overlaps_of, prefix_rule_join


def classified_sites(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """(site_key, leaf, unmapped): the leaf of the rule that equals the key, else of the longest prefix rule, else 'other'.
    A site is unmapped if it fell through, not if a rule places it in 'other'. rules: rule, leaf, exact. A null key falls through."""
    found = prefix_rule_join(sites.select("site_key").distinct(), "site_key", rules.select("rule", "leaf", "exact"), value="leaf", otherwise="other")
    placed = rules.filter(F.col("exact") & (F.col("leaf") == "other")).select(F.col("rule").alias("site_key"), F.lit(True).alias("__placed")).distinct()
    return found.join(placed, "site_key", "left").select("site_key", "leaf", ((F.col("leaf") == "other") & F.col("__placed").isNull()).alias("unmapped"))


def branch_sites(sites: DataFrame, rules: DataFrame, tree: DataFrame, node: str) -> DataFrame:
    """(site_key, inside): whether each site's leaf lies under a node, itself included; an unknown node has no sites.
    Rows with inside are the branch's sites, the others what excludes it. tree: id, parent_id."""
    under = closure(tree).filter(F.col("ancestor") == node).select(F.col("node").alias("leaf"), F.lit(True).alias("inside"))
    return classified_sites(sites, rules).join(under, "leaf", "left").select("site_key", F.coalesce("inside", F.lit(False)).alias("inside"))


def profile(careers: DataFrame, people: DataFrame, who: int, top: int = 50) -> DataFrame:
    """Rows (part, place, other, name, from_m, to_m, n) on one person.

    career: the records. overlap: the `top` longest overlaps (the limit is the page's), n months. government: places of the
    records, the organisation or without one the province; n is the number of colleagues. colleague: everyone else with a
    record in such an organisation or, of records without one, province, however long ago; n is the number of their records.
    careers: person_id, organization, province, start_m, end_m; people: person_id, name. An unknown person has no rows.
    """
    org, province = F.nullif(F.trim("organization"), F.lit("")), F.nullif(F.trim("province"), F.lit(""))
    records = careers.select("person_id", org.alias("org"), province.alias("province"), "start_m", "end_m")
    mine = records.filter(F.col("person_id") == who)
    career = mine.select(F.lit("career").alias("part"), F.coalesce("org", "province").alias("place"), F.lit(None).cast("long").alias("other"), F.lit(None).cast("string").alias("name"), "start_m", "end_m", F.lit(None).cast("long").alias("n"))
    other = F.when(F.col("a") == who, F.col("b")).otherwise(F.col("a"))
    overlaps = overlaps_of(records, who, "org").select("grp", other.alias("person_id"), "from_m", "to_m", "months").orderBy(F.desc("months"), "person_id", "grp", "from_m").limit(top)
    overlap = overlaps.join(people, "person_id", "left").select(F.lit("overlap"), "grp", "person_id", "name", "from_m", "to_m", F.col("months").cast("long"))

    places = mine.groupBy(F.coalesce("org", "province").alias("place")).agg(F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"), F.bool_or(F.col("org").isNotNull()).alias("by_org")).filter("place is not null")
    rest = records.filter(F.col("person_id") != who)
    met = lambda key, by_org: rest.withColumnRenamed(key, "place").join(places.filter(F.col("by_org") == by_org).select("place"), "place").select("place", "person_id", "start_m", "end_m")
    met_at = met("org", True).unionByName(met("province", False)).groupBy("place", "person_id").agg(F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"), F.count("*").alias("n"))
    colleague = met_at.join(people, "person_id", "left").select(F.lit("colleague"), "place", "person_id", "name", "start_m", "end_m", "n")
    met_n = met_at.groupBy("place").agg(F.count("*").alias("n"))
    government = places.join(met_n, "place", "left").select(F.lit("government"), "place", F.lit(None).cast("long"), F.lit(None).cast("string"), "start_m", "end_m", F.coalesce("n", F.lit(0)))
    return career.union(overlap).union(government).union(colleague).withColumnsRenamed({"start_m": "from_m", "end_m": "to_m"})


def collection(docs: DataFrame, sites: DataFrame, overlay: DataFrame, policy: Column, focus: Column, tags: list[tuple[str, str]], china: list[str], otherwise: str) -> DataFrame:
    """Rows of a topic's collection: url, id, site_key, tier, day, title, snippet, in_policy, in_focus, tag, note, china.

    A document belongs to it by the policy condition, the focus condition or both. Of equal addresses the row stays that the
    policy condition takes, of several the smallest id, with the flags of all; rows without an address go. The overlay (url,
    tag, note; one row an address) goes before the title's tag. docs: id, url, site_key, day, title, body.
    """
    named = F.coalesce(policy, F.lit(False)).alias("in_policy"), F.coalesce(focus, F.lit(False)).alias("in_focus")
    rows = docs.filter("url <> ''").select("id", "url", "site_key", "day", "title", T.flatten(F.col("body")).alias("snippet"), *named).filter("in_policy or in_focus")
    fields = F.struct("id", "site_key", "day", "title", "snippet")
    one = rows.groupBy("url").agg(F.min_by(fields, F.struct(~F.col("in_policy"), F.col("id"))).alias("row"), F.bool_or("in_policy").alias("in_policy"), F.bool_or("in_focus").alias("in_focus")).select("url", "row.*", "in_policy", "in_focus")
    full = one.join(overlay.select("url", "tag", "note"), "url", "left").join(sites.select("site_key", F.col("admin_level").alias("tier")), "site_key", "left")
    title = F.col("title")
    tag = F.coalesce(F.nullif(F.col("tag"), F.lit("")), F.when(F.col("in_focus"), T.first_rule(title, tags, otherwise, otherwise)), F.lit(""))
    return full.select("url", "id", "site_key", "tier", "day", "title", "snippet", "in_policy", "in_focus", tag.alias("tag"), F.coalesce("note", F.lit("")).alias("note"), T.contains_any(title, china).alias("china"))


def collection_counts(rows: DataFrame) -> DataFrame:
    """(kind, key, n): a collection's rows by month, by site, and in total by flag, in one pass."""
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    flags = [F.when(F.col(c), pair("total", F.lit(c))) for c in ("in_policy", "in_focus", "china")]
    marks = F.array(pair("month", F.date_format("day", "yyyy-MM")), pair("site", F.col("site_key")), pair("total", F.lit("all")), *flags)
    return rows.select(F.explode(F.array_compact(marks)).alias("m")).filter("m.key is not null").groupBy("m.kind", "m.key").agg(F.count("*").alias("n"))


def annotation_overview(mapping: DataFrame, taxonomy: DataFrame, none: str = "__none__") -> DataFrame:
    """(item_id, category, n, pct, tagged, untagged) for every item of a taxonomy: its documents, their share of the largest
    item's, and over all items the tagged documents and the rows of none. mapping: doc_id, item_id; taxonomy: item_id, category."""
    counts = mapping.groupBy("item_id").agg(F.count("*").alias("n"))
    most = counts.agg(F.coalesce(F.max(F.when(F.col("item_id") != none, F.col("n"))), F.lit(1)).alias("most"), F.coalesce(F.max(F.when(F.col("item_id") == none, F.col("n"))), F.lit(0)).alias("untagged"))
    totals = most.crossJoin(mapping.filter(F.col("item_id") != none).agg(F.count_distinct("doc_id").alias("tagged")))
    n = F.coalesce("n", F.lit(0))
    return taxonomy.join(counts, "item_id", "left").crossJoin(F.broadcast(totals)).select("item_id", "category", n.alias("n"), F.round(n * 100.0 / F.col("most"), 2).alias("pct"), "tagged", "untagged")


def annotation_items(mapping: DataFrame, docs: DataFrame, most: int = 24, none: str = "__none__") -> DataFrame:
    """(item_id, place, doc_id, rank, linked): the `most` highest ranked documents of each item (the limit is the page's;
    ties: smaller id) and the number of all that are linked. A window's limit is applied before its shuffle. docs: doc_id, rank."""
    linked = mapping.filter(F.col("item_id") != none).distinct().join(docs, "doc_id")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc_nulls_last("rank"), "doc_id"))
    best = linked.select("item_id", "doc_id", "rank", place.alias("place")).filter(F.col("place") <= most)
    return best.join(linked.groupBy("item_id").agg(F.count("*").alias("linked")), "item_id").select("item_id", "place", "doc_id", "rank", "linked")


def daily_report(docs: DataFrame, day: str, sites: int = 5, samples: int = 10) -> DataFrame:
    """Rows (part, key, n): counts by importance over all documents, the sites with most documents of the day, and samples
    of the day: n is their place by importance and newest date. Ties: smaller keys. docs: id, site_key, importance, crawled, written."""
    today = docs.filter(F.col("crawled") == F.lit(day).cast("date"))
    importance = docs.filter("importance is not null").groupBy("importance").agg(F.count("*").alias("n")).select(F.lit("importance").alias("part"), F.col("importance").alias("key"), "n")
    top = today.groupBy("site_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site_key").limit(sites).select(F.lit("site"), "site_key", "n")
    order = F.when(F.col("importance") == "high", 0).when(F.col("importance") == "medium", 1).otherwise(2)
    best = today.select("id", "written", order.alias("o")).orderBy("o", F.desc_nulls_last("written"), "id").limit(samples)
    # At most `samples` rows are numbered.
    place = F.row_number().over(Window.orderBy("o", F.desc_nulls_last("written"), "id"))
    return importance.union(top).union(best.select(F.lit("sample"), F.col("id").cast("string"), place.cast("long")))
