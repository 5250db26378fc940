"""Joins that need more than a key: longest prefix, longest suffix, containment, intervals, positional zip."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from lexweave.session import materialize, text_batches


def prefix_rule_join(rows: DataFrame, key: str, rules: DataFrame, rule_key: str = "rule", value: str = "value", exact: str = "exact", otherwise: str = "other") -> DataFrame:
    """The value of the rule that equals the key, else of the longest prefix rule, else otherwise.

    Prefixes of the key are exploded and equi-joined, so neither side needs to be broadcast.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.length(F.coalesce(F.col(key), F.lit("")))), lambda n: F.struct(n.alias("n"), F.substring(F.col(key), F.lit(1), n).alias("p")))
    keys = rows.select(key).distinct().select(key, F.explode(prefixes).alias("x")).select(key, "x.n", F.col("x.p").alias("__rule"))
    hit = keys.join(rules.select(F.col(rule_key).alias("__rule"), F.col(value).alias("__value"), F.col(exact).alias("__exact")), "__rule").filter(~F.col("__exact") | (F.col("__rule") == F.col(key)))
    best = hit.groupBy(key).agg(F.max_by("__value", F.struct(F.col("__exact").cast("int"), "n")).alias("__best"))
    return rows.join(best, key, "left").withColumn(value, F.coalesce("__best", F.lit(otherwise))).drop("__best")


def longest_suffix(rows: DataFrame, key: str, vocabulary: DataFrame, gate: Column | None = None, least: int = 2) -> DataFrame:
    """Adds suffix, the longest word of vocabulary (word) that ends the key and passes the gate; null if the key is a
    word itself. The gate sees the columns head and key."""
    ends = F.transform(F.sequence(F.lit(least), F.length(key) - 1), lambda n: F.substring(F.col(key), F.length(key) - n + 1, n))
    keys = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    known = keys.join(vocabulary.select(F.col("word").alias(key)).distinct(), key, "left_anti").filter(F.length(key) > least)
    found = known.select(key, F.explode(ends).alias("word")).join(vocabulary.select("word").distinct(), "word")
    found = found.withColumn("head", F.substring(F.col(key), F.lit(1), F.length(key) - F.length("word")))
    found = found.filter(gate) if gate is not None else found
    return rows.join(found.groupBy(key).agg(F.max_by("word", F.length("word")).alias("suffix")).hint("merge"), key, "left")


def _windows(c: str, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda p: F.struct(p.alias("pos"), F.substring(F.col(c), p, F.lit(size)).alias("gram")))


def resolve_titles(names: DataFrame, titles: DataFrame, least_title: int = 8, least_name: int = 4) -> DataFrame:
    """Names (name) against titles (title, id), both normalised -> name, id, how.

    First an equal title; then the longest title of least_title characters that is part of the name, leftmost on ties;
    then the shortest title that the name is part of, the smallest id on ties. Candidates come from seeds: what is part of
    something else is looked up by the rarest of its windows, so openings that many titles share don't pile up, and is then
    verified. Nothing is lost, as all windows of the longer side are looked up. What several steps read is written between them.
    Titles, names and windows meet by merging: Spark goes by the size of the packed files and would send all titles to the driver.
    """

    def windows(df: DataFrame, c: str, size: int) -> DataFrame:
        return df.filter(F.length(c) >= size).select(c, F.explode(_windows(c, size)).alias("w")).select(c, "w.pos", "w.gram")

    def rarest(grams: DataFrame, c: str, frequency: DataFrame) -> DataFrame:
        counted = grams.join(frequency.hint("merge"), "gram", "left")
        return counted.groupBy(c).agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "pos")).alias("gram"))

    t = materialize(titles.filter(F.length("title") > 0).groupBy("title").agg(F.min("id").alias("id")), "titles")
    n = materialize(names.select("name").filter(F.length("name") > 0).distinct(), "names")
    equal = materialize(n.join(t.hint("merge"), n.name == t.title).select("name", "id", F.lit("equal").alias("how")), "names-with-equal")
    rest = materialize(n.join(equal.hint("merge"), "name", "left_anti"), "names-without-equal")
    long_titles = t.filter(F.length("title") >= least_title)
    wide = windows(long_titles, "title", least_title)
    seeds = rarest(wide, "title", wide.groupBy("gram").agg(F.count("*").alias("df"))).join(long_titles.hint("merge"), "title")
    inside = windows(rest, "name", least_title).select("name", "gram").distinct().join(seeds.hint("merge"), "gram").withColumn("at", F.instr("name", F.col("title"))).filter("at > 0")
    inside = materialize(inside.groupBy("name").agg(F.max_by("id", F.struct(F.length("title"), -F.col("at"))).alias("id")).select("name", "id", F.lit("title in name").alias("how")), "titles-in-names")
    rest = rest.join(inside.hint("merge"), "name", "left_anti").filter(F.length("name") >= least_name)
    grams = windows(long_titles, "title", least_name).select("title", "gram").distinct()
    rare = rarest(windows(rest, "name", least_name), "name", grams.groupBy("gram").agg(F.count("*").alias("df")))
    around = rare.join(grams.hint("merge"), "gram").filter(F.col("title").contains(F.col("name"))).join(long_titles.hint("merge"), "title")
    around = around.groupBy("name").agg(F.min_by("id", F.struct(F.length("title"), F.col("id"))).alias("id")).select("name", "id", F.lit("name in title").alias("how"))
    return equal.unionByName(inside).unionByName(around)


#: Characters of a text whose windows are made at once.
BLOCK = 4096


def _finder(found: list[tuple], seed: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """found: (passage_id, passage) pairs -> a function of batches (text_id, text) that gives the pairs of ids."""
    heads: dict[int, dict[str, list[tuple]]] = {}
    for i, passage in found:
        k = min(len(passage), seed)
        heads.setdefault(k, {}).setdefault(passage[:k], []).append((i, passage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids = [], []
            for row, value in enumerate(b["text"]):
                if (text := value.as_py()) is None:
                    continue
                hits = set()
                for k, table in heads.items():
                    for at in range(len(text) - k + 1 if k else 1):
                        if (head := text[at : at + k]) in table:
                            hits.update(i for i, passage in table[head] if text.startswith(passage, at))
                rows += [row] * len(hits)
                ids += hits
            yield pa.RecordBatch.from_arrays([b["text_id"].take(pa.array(rows, pa.int64())), pa.array(ids, id_type)], names=["text_id", "passage_id"])

    return run


def contained_passages(texts: DataFrame, passages: DataFrame, seed: int = 24, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Pairs (text_id, passage_id) where the whole passage occurs in the text, wherever it starts and however short it is.
    Passages are seeded by their first characters, shorter ones by all of theirs, and looked up at every character of a text.

    Passages of at most broadcast_bytes in all are sent to every task, and texts are verified where they are read. More
    are joined by hashes of the windows alone; candidates then meet their texts and passages again to be verified.
    """
    some = passages.filter("passage is not null")
    size = some.agg(F.coalesce(F.sum(F.octet_length("passage") + 64), F.lit(0)).alias("n")).first()["n"]
    types = {c: df.schema[c].dataType for df, c in ((texts, "text_id"), (passages, "passage_id"))}
    if size <= broadcast_bytes:
        text_batches(texts.sparkSession)
        find = _finder([tuple(r) for r in some.select("passage_id", "passage").distinct().collect()], seed, to_arrow_type(types["passage_id"]))
        schema = StructType([StructField(c, t) for c, t in types.items()])
        return texts.select("text_id", "text").mapInArrow(find, schema).distinct()
    head = some.withColumn("k", F.least(F.length("passage"), F.lit(seed))).select("passage_id", "k", F.xxhash64(F.substring(F.col("passage"), F.lit(1), F.col("k"))).alias("gram"))
    grams = texts.select("text_id", F.lit(0).alias("k"), F.xxhash64(F.lit("")).alias("gram"))
    for k in sorted(r["k"] for r in head.filter("k > 0").select("k").distinct().collect()):
        width = F.lit(BLOCK + k - 1)
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(BLOCK)), lambda at: F.substring(F.col("text"), at, width))  # noqa: B023
        windows = texts.select("text_id", F.explode(blocks).alias("block")).select("text_id", F.explode(F.regexp_extract_all("block", F.lit(rf"(?s)(?=(.{{{k}}}))"), F.lit(1))).alias("w"))
        grams = grams.unionByName(windows.select("text_id", F.lit(k).alias("k"), F.xxhash64("w").alias("gram")))
    pairs = grams.join(head, ["k", "gram"]).select("text_id", "passage_id").distinct()
    verified = pairs.join(texts.select("text_id", "text"), "text_id").join(passages.select("passage_id", "passage"), "passage_id")
    return verified.filter(F.col("text").contains(F.col("passage"))).select("text_id", "passage_id").distinct()


#: Intervals of a person that a pairing compares in one expression, people of a group in a block, and comparisons in a task.
WIDTH, CROWD, TASK_PAIRS = 4, 2048, 1 << 25


def overlap_pairs(careers: DataFrame, group: str, person: str = "person_id", start: str = "start_m", end: str = "end_m", open_months: int = 48, least: int = 1, crowd: int = CROWD) -> DataFrame:
    """Pairs (a < b) of one group whose intervals share at least `least` months.

    Intervals of a group that start in one year and have lengths of one power of two make a chunk, of about CROWD at most. An
    interval meets the chunks that have one which overlaps it, and only then is it compared with each of theirs, which are
    close to each other. A group with more than its share of the work is dealt into blocks, and each two blocks meet in a
    task. A share is a quarter of a core's, so blocks grow with the data, and an interval is shuffled once for each block of
    its group: at most 2 * sqrt(cores) + 1 times, whatever the group's size. No pair is shuffled, sorted or held.
    """
    rows = careers.filter(F.col(start).isNotNull() & F.col(group).isNotNull() & F.col(person).isNotNull()).select(F.col(group).alias("grp"), F.col(person).alias("p"), F.col(start).alias("s"), F.coalesce(F.col(end), F.col(start) + open_months).alias("e"))
    rows = rows.filter((F.col("e") > F.col("s")) & (F.col("e") - F.col("s") >= least))
    rows = materialize(rows.withColumn("lot", F.hash(F.monotonically_increasing_id())), "intervals")  # equal intervals are dealt too
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    work = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, min(2000, int(work / TASK_PAIRS)))
    block = max(crowd, math.ceil(math.sqrt(work / (4 * cores))))
    large = materialize(sizes.filter(F.col("n") > crowd).select("grp", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.col("n")), "large-groups")
    parts = F.col("blocks") * F.ceil(F.col("n") / crowd / F.col("blocks"))
    dealt = rows.join(large, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("part", F.coalesce(F.pmod("lot", parts), F.lit(0)).cast("int")).withColumn("own", F.pmod("part", "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    chunk = F.xxhash64("part", F.floor(F.col("s") / 12), F.floor(F.log2(F.col("e") - F.col("s"))))
    a = dealt.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "part", "p", "s", "e").repartition(tasks, "grp", "i", "j").withColumn("chunk", chunk)
    b = a.groupBy("grp", "i", "j", F.col("own").alias("own_b"), F.col("chunk").alias("chunk_b")).agg(F.min("s").alias("lo"), F.max("e").alias("hi"), F.sort_array(F.collect_list(F.struct("s", "e", "p"))).alias("x"))
    # each two chunks meet in one order, those of one number in both. The last test is what keeps Spark from compiling the join
    # together with what follows: compiled, it would hold all pairs of an interval before it passes on the first
    once = (F.col("chunk") <= F.col("chunk_b")) & ((F.col("i") == F.col("j")) | (F.col("own") != F.col("own_b")))
    near = F.least("e", "hi") - F.greatest("s", "lo") >= least
    some = F.exists("x", lambda y: F.least("e", y["e"]) - F.greatest("s", y["s"]) >= least)
    met = a.hint("merge").join(b, ["grp", "i", "j"]).filter(once & near & some).select("grp", (F.col("chunk") == F.col("chunk_b")).alias("same"), "s", "e", "p", F.inline("x").alias("s_b", "e_b", "p_b"))
    from_m, to_m = F.greatest("s", "s_b"), F.least("e", "e_b")
    pairs = met.filter((to_m - from_m >= least) & F.when(F.col("same"), F.col("p") < F.col("p_b")).otherwise(F.col("p") != F.col("p_b")))
    return pairs.select("grp", F.least("p", "p_b").alias("a"), F.greatest("p", "p_b").alias("b"), from_m.alias("from_m"), to_m.alias("to_m"), (to_m - from_m).alias("months"))


def longest_overlaps(careers: DataFrame, group: str, person: str = "person_id", start: str = "start_m", end: str = "end_m", open_months: int = 48, least: int = 1, names: DataFrame | None = None, crowd: int = CROWD) -> DataFrame:
    """(grp, a, b, months): the longest interval that two people (a < b) share in a group, a row a pair and group; with
    names (person, name) also name_a and name_b, of people who have one.

    A person's intervals, WIDTH to a row, stand side by side, so a pair's longest overlap is one expression and no pair is
    shuffled. People are shuffled instead: a group is dealt into blocks of about crowd people, and each two blocks meet in
    a task. Only pairs with somebody of more intervals are grouped afterwards.
    """
    rows = careers.filter(F.col(start).isNotNull() & F.col(group).isNotNull() & F.col(person).isNotNull()).select(F.col(group).alias("grp"), F.col(person).alias("p"), F.col(start).alias("s"), F.coalesce(F.col(end), F.col(start) + open_months).alias("e")).filter("e > s")
    each = rows.groupBy("grp", "p").agg(F.collect_set(F.struct("s", "e")).alias("x"))
    if names is not None:
        each = each.join(names.select(F.col("person").alias("p"), F.col("name")), "p")
    each = materialize(each, "people")
    sizes = each.groupBy("grp").agg(F.sum(F.ceil(F.size("x") / WIDTH)).alias("n"), F.max(F.size("x")).alias("most"))
    work, most = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.max("most")).first()
    width = min(most or 1, WIDTH)
    at = lambda i, c, none: F.coalesce(F.get("x", F.col("k") * width + i)[c], F.lit(none).cast(rows.schema[c].dataType)).alias(f"{c}{i}")
    flat = each.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / width).cast("int")))).withColumn("single", F.size("x") <= width)
    far = 1 << 29
    flat = flat.select("grp", "p", "single", *["name"] * (names is not None), *[at(i, c, none) for i in range(width) for c, none in (("s", far), ("e", -far))])
    flat = flat.join(sizes.select("grp", F.ceil(F.col("n") / crowd).cast("int").alias("blocks")), "grp").withColumn("own", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = max(each.sparkSession.sparkContext.defaultParallelism, min(2000, int((work or 0) / TASK_PAIRS)))

    def side(mark: str, i: str, j: str) -> DataFrame:
        keep = [c for c in flat.columns if c not in ("grp", "blocks", "own", "other")]
        return flat.select("grp", F.col(i).alias("i"), F.col(j).alias("j"), *[F.col(c).alias(f"{c}_{mark}") for c in keep]).repartition(tasks, "grp", "i", "j")

    shared = [F.least(f"e{x}_a", f"e{y}_b") - F.greatest(f"s{x}_a", f"s{y}_b") for x in range(width) for y in range(width)]
    met = side("a", "own", "other").hint("merge").join(side("b", "other", "own"), ["grp", "i", "j"]).filter(F.col("p_a") < F.col("p_b")).withColumn("months", F.greatest(*shared) if len(shared) > 1 else shared[0]).filter(F.col("months") >= least)
    columns = ["grp", F.col("p_a").alias("a"), F.col("p_b").alias("b"), "months", *[f"name_{k}" for k in "ab" if names is not None]]
    pairs = met.filter("single_a and single_b") if most and most > width else met
    pairs = pairs.select(*columns)
    if not most or most <= width:
        return pairs
    many = met.filter("not (single_a and single_b)").select(*columns)
    return pairs.unionByName(many.groupBy([c for c in many.columns if c != "months"]).agg(F.max("months").alias("months")))


def top_overlaps(careers: DataFrame, group: str, top: int, person: str = "person_id", start: str = "start_m", end: str = "end_m", open_months: int = 48) -> DataFrame:
    """(a, b, months): of all pairs of overlap_pairs the top ones by their longest overlap in any group, smaller ids first
    on ties, without all pairs.

    People with the same interval in a group share all of it. Counting those gives, in linear work, a length that the top
    pairs reach at least, and shorter intervals can't take part. Of a pair's rows at most one stands for each two intervals
    of its people, so the top pairs are in that many times as many rows, and only those are grouped.
    """
    rows = materialize(careers.filter(F.col(start).isNotNull() & F.col(group).isNotNull() & F.col(person).isNotNull()).select(F.col(group).alias("grp"), F.col(person).alias("p"), F.col(start).alias("s"), F.coalesce(F.col(end), F.col(start) + open_months).alias("e")).filter("e > s").distinct(), "intervals")
    n = rows.groupBy("grp", "s", "e").agg(F.count("*").alias("n")).groupBy((F.col("e") - F.col("s")).alias("months")).agg(F.sum(F.expr("double(n) * (n - 1) / 2")).alias("n"))
    own = lambda d: d.groupBy("p").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    some, least, most = 0, 1, own(rows)
    for months, pairs in n.orderBy(F.desc("months")).toLocalIterator():
        if (some := some + pairs) >= top * most:
            least = months
            break
    rows = rows.filter(F.col("e") - F.col("s") >= least)
    order = [F.desc("months"), "a", "b"]
    pairs = overlap_pairs(rows, "grp", "p", "s", "e", open_months, least).select("a", "b", "months")
    return pairs.orderBy(*order).limit(top * own(rows) ** 2).groupBy("a", "b").agg(F.max("months").alias("months")).orderBy(*order).limit(top)


def overlap_totals(careers: DataFrame, group: str, person: str = "person_id", start: str = "start_m", end: str = "end_m", open_months: int = 48) -> DataFrame:
    """(grp, person, overlaps, months): how many rows of overlap_pairs a person has in a group, and their months in all,
    without the pairs.

    Of a group's intervals those overlap one from s to e that start before e, without those that end by s; the months are
    what a running sum of the active ones grows by from s to e. Both are read from running sums over the group's distinct
    months, so the work is linear, whatever the size of a group. A person's own intervals are taken off the same way.
    """
    rows = careers.filter(F.col(start).isNotNull() & F.col(group).isNotNull() & F.col(person).isNotNull()).select(F.col(group).alias("grp"), F.col(person).alias("person"), F.col(start).cast("long").alias("s"), F.coalesce(F.col(end), F.col(start) + open_months).cast("long").alias("e")).filter("e > s")
    marks = rows.select("grp", "person", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("e").alias("at"), F.lit(0).alias("opens")))).alias("m")).select("grp", "person", "m.*")
    marks = marks.groupBy("grp", "person", "at").agg(F.sum("opens").alias("opened"), F.sum(1 - F.col("opens")).alias("closed"))

    def sums(keys: list[str]) -> DataFrame:
        points = marks.groupBy(*keys, "at").agg(F.sum("opened").alias("o"), F.sum("closed").alias("c"))
        run = lambda x: F.sum(x).over(Window.partitionBy(*keys).orderBy("at"))
        at = F.col("at")
        active = at * run(F.col("o") - F.col("c")) - run(at * (F.col("o") - F.col("c")))
        return points.select(*keys, "at", (run("o") - F.col("o")).alias("before"), run("c").alias("done"), active.alias("active"))

    def totals(keys: list[str]) -> DataFrame:
        met = marks.join(sums(keys), [*keys, "at"])
        n = F.col("closed") * F.col("before") - F.col("opened") * F.col("done")
        return met.select("grp", "person", n.alias("overlaps"), ((F.col("closed") - F.col("opened")) * F.col("active")).alias("months"))

    own = totals(["grp", "person"]).select("grp", "person", (-F.col("overlaps")).alias("overlaps"), (-F.col("months")).alias("months"))
    return totals(["grp"]).unionByName(own).groupBy("grp", "person").agg(F.sum("overlaps").alias("overlaps"), F.sum("months").alias("months")).filter("overlaps > 0")


def overlaps_of(careers: DataFrame, who: int, group: str, person: str = "person_id", start: str = "start_m", end: str = "end_m", open_months: int = 48, least: int = 1) -> DataFrame:
    """The pairs of overlap_pairs that one person is in. Only that person's intervals meet those of their groups, so the
    work is linear in the groups and no pair of other people is built."""
    rows = careers.filter(F.col(start).isNotNull()).select(F.col(group).alias("grp"), F.col(person).alias("p"), F.col(start).alias("s"), F.coalesce(F.col(end), F.col(start) + open_months).alias("e"))
    mine = rows.filter(F.col("p") == who).select("grp", F.col("s").alias("from_m"), F.col("e").alias("to_m"))
    met = rows.filter(F.col("p") != who).join(mine, "grp").select("grp", F.least("p", F.lit(who)).alias("a"), F.greatest("p", F.lit(who)).alias("b"), F.greatest("s", "from_m").alias("from_m"), F.least("e", "to_m").alias("to_m"))
    return met.withColumn("months", F.col("to_m") - F.col("from_m")).filter(F.col("months") >= least)


def zip_shortest(*arrays: Column) -> Column:
    """Arrays side by side, cut to the shortest."""
    n = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    return F.slice(F.arrays_zip(*arrays), F.lit(1), n)


def two_keys(refs: DataFrame, docs: DataFrame, ref: Column, normal: Column) -> DataFrame:
    """Refs with target_id by the raw document number, else by the normalised one. docs: id, number, number_norm.
    Of equal raw numbers the largest id counts, of equal normalised ones the smallest (T10). All numbers of the corpus take
    part, so neither side is sent to the driver."""
    raw = docs.filter("number <> ''").groupBy("number").agg(F.max("id").alias("__raw"))
    folded = docs.filter("number_norm <> ''").groupBy("number_norm").agg(F.min("id").alias("__norm"))
    out = refs.withColumn("__r", ref).withColumn("__n", normal)
    out = out.join(raw.hint("merge"), F.col("__r") == raw.number, "left").join(folded.hint("merge"), F.col("__n") == folded.number_norm, "left")
    return out.withColumn("target_id", F.coalesce("__raw", "__norm")).drop("__raw", "__norm", "__r", "__n", "number", "number_norm")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
