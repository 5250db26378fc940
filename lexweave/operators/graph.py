"""Citation neighbourhoods, hubs, chains and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize


def neighbourhood(edges: DataFrame, centre: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, is_centre) and edges of one document's citations in both directions."""
    near = edges.filter((F.col("source_id") == centre) | (F.col("target_id") == centre)).filter("target_id is not null").select("source_id", "target_id").distinct()
    nodes = near.select(F.explode(F.array("source_id", "target_id")).alias("id")).union(edges.sparkSession.createDataFrame([(centre,)], "id long")).distinct()
    return nodes.withColumn("is_centre", F.col("id") == centre), near


def document_citations(edges: DataFrame, docs: DataFrame, centre: int) -> DataFrame:
    """G1: rows (direction, ref, type, level, other_id, title, site_key): what a document cites, with the target where it is
    resolved, and what cites it. docs: id, title, site_key."""
    out = edges.filter(F.col("source_id") == centre).join(docs.withColumnRenamed("id", "other_id"), F.col("target_id") == F.col("other_id"), "left")
    into = edges.filter(F.col("target_id") == centre).join(docs.withColumnRenamed("id", "other_id"), F.col("source_id") == F.col("other_id"))
    row = lambda df, name, level: df.select(F.lit(name).alias("direction"), F.col("target_ref").alias("ref"), F.col("citation_type").alias("type"), F.col(level).alias("level"), "other_id", "title", "site_key")
    return row(out, "cites", "target_level").unionByName(row(into, "cited by", "source_level"))


def chains(edges: DataFrame, levels: DataFrame, top: str) -> DataFrame:
    """(root, middle, leaf, levels): documents of the top level, what cites them and what cites that (null: nothing).
    levels: id, level of each document. Levels and leveled pairs are written, as both are read twice, and meet by merging, since
    their files are far smaller than their rows."""
    levels = materialize(levels.select("id", "level"), "levels")
    pairs = edges.filter("target_id is not null").select("source_id", "target_id").distinct()
    known = pairs.join(levels.select(F.col("id").alias("source_id"), F.col("level").alias("lower")).hint("merge"), "source_id").join(levels.select(F.col("id").alias("target_id"), F.coalesce("level", F.lit("unknown")).alias("upper")).hint("merge"), "target_id")
    known = materialize(known, "leveled-citations")
    first = known.filter(F.col("upper") == top).select(F.col("target_id").alias("root"), F.col("source_id").alias("middle"), "upper", "lower")
    second = known.select(F.col("target_id").alias("via"), F.col("source_id").alias("leaf"), F.col("lower").alias("lowest"))
    # A citation back to the root is no chain; a middle that has no other keeps its row without a leaf.
    both = first.join(second.hint("merge"), (F.col("middle") == F.col("via")) & (F.col("leaf") != F.col("root")), "left")
    return both.select("root", "middle", "leaf", F.concat_ws(" > ", "upper", "lower", "lowest").alias("levels"))


def hub_network(edges: DataFrame, max_hubs: int = 400, max_edges: int = 2500) -> DataFrame:
    """Edges (source_id, target_id, n) of the most cited targets, capped: the caps are the feature. Ties: smaller ids."""
    hubs = edges.filter("target_id is not null").groupBy("target_id").agg(F.count("*").alias("cited")).orderBy(F.desc("cited"), "target_id").limit(max_hubs)
    pairs = edges.groupBy("source_id", "target_id").agg(F.count("*").alias("n"))
    return pairs.join(F.broadcast(hubs), "target_id").orderBy(F.desc("cited"), "target_id", F.desc("n"), "source_id").limit(max_edges).select("source_id", "target_id", "n")


def cascade(edges: DataFrame) -> DataFrame:
    """Two steps: last -> middle -> first."""
    down, up = edges.filter("target_id is not null").alias("d"), edges.filter("target_id is not null").alias("u")
    return down.join(up, F.col("d.target_id") == F.col("u.source_id")).select(F.col("d.source_id").alias("last"), F.col("d.target_id").alias("middle"), F.col("u.target_id").alias("first")).distinct()


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, node, depth) of a tree (id, parent_id), each node its own ancestor at depth 0. A round joins one level;
    rounds end with the tree's depth. A cycle is an error."""
    step = tree.select(F.col("id").alias("node"), F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    out, up = step, tree.filter("parent_id is not null").select(F.col("id").alias("ancestor"), F.col("parent_id").alias("above"))
    depth = 0
    while True:
        depth += 1
        step = step.join(up, "ancestor").select("node", F.col("above").alias("ancestor"), F.lit(depth).alias("depth"))
        rows, back = step.agg(F.count("*"), F.count_if(F.col("node") == F.col("ancestor"))).first()
        if not rows:
            return out.select("ancestor", "node", "depth")
        if back:
            raise ValueError("the tree has a cycle")
        out = out.unionByName(step)


def rollup(facts: DataFrame, key: str, tree: DataFrame, measures: list) -> DataFrame:
    """Measures of each branch with everything below it."""
    return facts.join(closure(tree), facts[key] == F.col("node")).groupBy("ancestor").agg(*measures)


def policy_chain(docs: DataFrame, edges: DataFrame, topic: F.Column) -> DataFrame:
    """Documents of a topic, what they cite and what cites them: (id, role), topic before outbound before inbound."""
    core = docs.filter(topic).select("id")
    out = edges.filter("target_id is not null").join(core.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    into = edges.join(core.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    roles = core.withColumn("r", F.lit(0)).unionByName(out.withColumn("r", F.lit(1))).unionByName(into.withColumn("r", F.lit(2)))
    name = F.element_at(F.array(F.lit("topic"), F.lit("outbound"), F.lit("inbound")), F.min("r") + 1)
    return roles.groupBy("id").agg(name.alias("role"))
