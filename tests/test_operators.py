"""Properties that a query on one data set doesn't show: brute force, repeated runs, plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexweave.operators import changes as C
from lexweave.operators import citations as CI
from lexweave.operators import graph as G
from lexweave.operators import joins as J


def test_titles_resolve_as_by_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    titles = [(i, word(rng.randint(3, 12))) for i in range(60)]
    names = sorted({word(rng.randint(2, 14)) for _ in range(200)})
    got = {r["name"]: r["id"] for r in J.resolve_titles(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(titles, "id int, title string")).collect()}
    first = {}
    for i, t in titles:
        first[t] = min(i, first.get(t, i))

    def brute(n):
        if n in first:
            return first[n]
        inside = [(len(t), -n.index(t), t) for t in first if len(t) >= 8 and t in n]
        if inside:
            return first[max(inside)[2]]
        around = [(len(t), i) for t, i in first.items() if len(t) >= 8 and len(n) >= 4 and n in t]
        return min(around)[1] if around else None

    assert got == {n: b for n in names if (b := brute(n)) is not None}


def test_overlaps_as_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(p, rng.choice("xy"), s := rng.randint(24000, 24200), None if rng.random() < 0.2 else s + rng.randint(0, 90)) for p in range(40)]
    got = {(r["a"], r["b"], r["months"]) for r in J.overlap_pairs(spark.createDataFrame(rows, "person_id int, org string, start_m int, end_m int"), "org").collect()}
    end = lambda r: r[2] + 48 if r[3] is None else r[3]
    want = {(a[0], b[0], m) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (m := min(end(a), end(b)) - max(a[2], b[2])) >= 1}
    assert got == want


def test_contained_passages_as_by_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("text_id"), "text")
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    got = {tuple(r) for r in J.contained_passages(d, b).collect()}
    assert got == {tuple(r) for r in J.contained_passages(d, b, broadcast_bytes=0).collect()}
    assert got == {(x["text_id"], y["passage_id"]) for x in d.collect() for y in b.collect() if y["passage"] in x["text"]}


def test_short_quoted_and_cjk_passages_are_found(spark):
    long = "a passage of more than twenty-four characters"
    cjk = "国务院关于加强数字政府建设的指导意见和深化改革的若干规定及实施细则"
    texts = [(1, f'he said "{long}" (twice)'), (2, f"x-{long}"), (3, f"根据{cjk}第三条"), (4, "tiny 国发 text"), (5, ""), (6, None), (7, "y" * 4090 + long)]
    passages = [(10, long), (11, cjk), (12, "国发"), (13, "t"), (14, ""), (15, None), (16, "absent"), (17, cjk[:24])]
    d, p = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(passages, "passage_id int, passage string")
    want = {(i, j) for i, t in texts for j, q in passages if t is not None and q is not None and q in t}
    for limit in (32 << 20, 0):
        assert {tuple(r) for r in J.contained_passages(d, p, broadcast_bytes=limit).collect()} == want


def test_deep_trees_are_closed_and_cycles_are_errors(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(31)]
    got = {tuple(r) for r in G.closure(spark.createDataFrame(chain, "id string, parent_id string")).collect()}
    assert got == {(str(a), str(n), n - a) for n in range(31) for a in range(n + 1)}
    with pytest.raises(ValueError, match="cycle"):
        G.closure(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "id string, parent_id string"))


def test_snapshot_taken_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b ", "x")], "id int, name string, note string")
    new = spark.createDataFrame([(2, "b", "y"), (3, "c", "")], "id int, name string, note string")
    events = {tuple(r) for r in C.snapshot_diff(old, new, "id", ["name", "note"]).collect()}
    assert events == {(1, "deleted", None, None, None), (2, "modified", "note", "x", "y"), (3, "added", None, None, None)}
    once = C.upsert(old, new, "id")
    assert C.diff_write(once, C.upsert(once, new, "id"), "id", [], ["name", "note"]).count() == 0


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, body string")
    new = spark.createDataFrame([(1, ""), (2, "c"), (3, None)], "id int, body string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(C.upsert(old, new, "id")) == [(1, "a"), (2, "c"), (3, None)]
    assert rows(C.upsert(old, new, "id", keep_if_empty=False)) == [(1, ""), (2, "c"), (3, None)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, name string")
    assert C.snapshot_diff(empty, empty, "id", ["name"]).count() == 0
    assert C.upsert(empty, empty, "id").count() == 0
    edges = spark.createDataFrame([], "source_id long, target_id long")
    assert G.cascade(edges).count() == 0 and G.hub_network(edges).count() == 0
    assert G.closure(spark.createDataFrame([], "id string, parent_id string")).count() == 0


def test_ids_continue(spark):
    have = spark.createDataFrame([(7, "z")], "id long, name string")
    got = C.allocate_ids(have, spark.createDataFrame([("b",), ("a",), ("c",)], "name string"), "id", ["name"])
    assert [(r["id"], r["name"]) for r in got.orderBy("id").collect()] == [(8, "a"), (9, "b"), (10, "c")]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 480000").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,480000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_stream_of_snapshots(spark, tmp_path):
    from lexweave.streaming.ingest import ingest_stream

    schema = spark.createDataFrame([], "id int, name string, seen int").schema
    for day, rows in enumerate(([(1, "a", 1), (1, "b", 2)], [(1, "c", 3), (2, "d", 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        ingest_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/table", f"file://{tmp_path}/changes", f"file://{tmp_path}/cp", schema, "id", ["name"], "seen").awaitTermination()
        last = day
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/table/v={last}").collect()) == [(1, "c", 3), (2, "d", 3)]
    kinds = {(r["id"], r["change_type"]) for r in spark.read.parquet(f"file://{tmp_path}/changes").collect()}
    assert kinds == {(1, "added"), (1, "modified"), (2, "added")}


def test_sources_and_sinks(spark, tmp_path):
    from lexweave.sources import files, sinks

    assert files.optional(spark, f"file://{tmp_path}/none", "a int").count() == 0
    (tmp_path / "t.yaml").write_text("- id: a\n  children:\n    - {id: b, sites: [x]}\n")
    assert [tuple(r)[:2] for r in files.yaml_dimension(spark, f"file://{tmp_path}/t.yaml").collect()] == [("a", None), ("b", "a")]
    (tmp_path / "p.html").write_bytes(b"<p>\xff ok</p>")
    assert files.raw_html(spark, f"file://{tmp_path}/p.html").first()["html"].endswith(" ok</p>")
    df = spark.createDataFrame([(1, "a,b")], "id int, t string")
    sinks.csv(df, f"file://{tmp_path}/c")
    assert files.csv(spark, f"file://{tmp_path}/c", "id int, t string").collect() == df.collect()
    days = [f"2024-01-{d:02d}" for d in range(1, 32)]
    assert len(set(days) - set(sinks.expired(days))) == 11
    assert sinks.shrunk(100, 98) and not sinks.shrunk(100, 99)


def test_batch_run_twice_changes_nothing(spark, tmp_path):
    from lexweave.plans import batch
    from lexweave.plans.texts import CORPUS, SITES4

    docs = spark.createDataFrame(CORPUS, batch.DOCUMENTS)
    sites = spark.createDataFrame(SITES4, "site_key string, admin_level string")
    root = f"file://{tmp_path}/corpus"
    first = batch.run_batch(spark, docs, sites, root, "r1")
    assert (first["documents"], first["changes"], first["citations"], first["scores_written"]) == (6, 6, 6, 6)
    again = batch.run_batch(spark, docs, sites, root, "r2")
    assert (again["documents"], again["changes"], again["citations"], again["scores_written"], again["shrunk"]) == (6, 0, 6, 0, 0)
    rank = {r["id"]: r["citation_rank"] for r in spark.read.parquet(f"{root}/scores").collect()}
    assert rank[1] == 2.0 + 2.0 + 0.5 + 3.0 and rank[6] == 0.0


def test_arrow_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from lexweave.session import TEXT_BATCH_BYTES, text_batches

    text_batches(spark)
    rows = spark.range(60).repartition(1).selectExpr("id", "repeat('x', 2000000) AS t")
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert len(sizes) > 5 and max(r["n"] for r in sizes) < TEXT_BATCH_BYTES + 4_000_000


def test_ids_are_gapless_over_many_ranges(spark):
    names = [f"n{(i * 7919) % 1000:04d}" for i in range(1000)] + ["same"] * 50
    have = spark.createDataFrame([(7, "x")], "id long, name string")
    got = C.allocate_ids(have, spark.createDataFrame([(n,) for n in names], "name string"), "id", ["name"], bin_rows=90).collect()
    assert [r["name"] for r in sorted(got, key=lambda r: r["id"])] == sorted(names) and sorted(r["id"] for r in got) == list(range(8, 8 + len(names)))
    none = spark.createDataFrame([], "name string")
    assert C.allocate_ids(have, none, "id", ["name"]).count() == 0


def test_versions_survive_a_dead_writer(spark, tmp_path):
    from lexweave.sources.sinks import Versions

    table = Versions(spark, f"file://{tmp_path}", "t")
    assert table.read("x int").count() == 0
    table.replace(spark.createDataFrame([(1,)], "x int"))
    # A writer that died: a version without its marker. The table is the version before it, and the next one goes on.
    dead = tmp_path / "t" / "v=2"
    dead.mkdir()
    (dead / "part-0.parquet").write_bytes(b"half")
    assert [r["x"] for r in table.read("x int").collect()] == [1]
    # The next version may be made of the current one.
    table.replace(table.read("x int").selectExpr("x + 1 AS x"))
    assert [r["x"] for r in Versions(spark, f"file://{tmp_path}", "t").read("x int").collect()] == [2]
    # A writer that died after its table was whole, before the old one went.
    (tmp_path / "t" / "v=1").mkdir()
    assert [r["x"] for r in table.read("x int").collect()] == [2]


def test_batch_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    from lexweave.plans import batch, texts

    docs, sites = texts.corpus(spark)
    root = f"file://{tmp_path}"

    def broken(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(batch, "scores", broken)
    with pytest.raises(RuntimeError):
        batch.run_batch(spark, docs, sites, root, "r1")
    monkeypatch.undo()
    report = batch.run_batch(spark, docs, sites, root, "r1")
    assert report["documents"] == 6 and report["citations"] == 6 and report["scores_written"] == 6


def test_stored_index(spark, tmp_path):
    from lexweave.operators import search as Q

    docs = spark.createDataFrame([(1, "red fox", "the fox", 5), (2, "dog", "the dog and the fox", 6), (3, "", "", 7), (4, None, None, 8)], "doc_id long, title string, body string, day int")
    index = Q.StoredIndex.build(docs, f"file://{tmp_path}/i", ["title", "day"], buckets=4)
    again = Q.StoredIndex(spark, f"file://{tmp_path}/i")
    assert (again.total, again.tokens) == (index.total, index.tokens) == (4, 10)
    assert sorted(r["doc_id"] for r in again.bm25(["fox"]).collect()) == [1, 2] and again.bm25(["fox", "dog"]).count() == 1 and again.bm25(["cat"]).count() == 0 and again.bm25([]).count() == 0
    assert len({f.split("/")[-2] for f in again.postings(["fox"]).inputFiles()}) == 1
    assert Q.search(docs, f"file://{tmp_path}/none", "the fox", ["fox"], ["body"])[0] == "trigram"
    assert Q.search(docs, again, "fox", ["fox"], ["body"])[0] == "bm25"
    empty = Q.StoredIndex.build(docs.limit(0), f"file://{tmp_path}/e", ["title", "day"])
    assert empty.bm25(["fox"]).count() == 0 and Q.search(docs.limit(0), empty, "fox", ["fox"], ["body"])[0] == "like"


def test_titles_that_share_their_opening_resolve(spark):
    from lexweave.operators.joins import resolve_titles

    titles = [(i, f"the common opening of all titles number {i:04d}") for i in range(300)]
    names = [f"see {titles[7][1]} (draft)", "number 0123", titles[9][1], "nothing of it", "titles"]
    got = {(r["name"], r["id"], r["how"]) for r in resolve_titles(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(titles, "id long, title string")).collect()}
    assert got == {(names[0], 7, "title in name"), (names[1], 123, "name in title"), (names[2], 9, "equal"), (names[4], 0, "name in title")}


def test_list_rows_of_odd_pages(spark):
    from lexweave.functions.html import list_rows

    base = "http://a.cn/x/"
    pages = [
        (1, None, base), (2, "", base), (3, '<a href="t20240101_1.html">', base), (4, '<a href="t20240101_1.html"><b></b></a><a href="t20240101_1.html">late</a>', base),
        (5, '<a class=x href="t20241301_1.html"> a\n&amp; b</a><a href="/y/t20240102_2.html" title="T">z</a>', base), (6, '<a href="http://[/t20240101_1.html">q</a>', base), (7, '<a href="t20240101_1.html">x</a>', None),
        (8, "<a " * 20000 + '<a href="' * 3000, base),
    ]
    d = spark.createDataFrame(pages, "id int, html string, url string").select("id", list_rows(F.col("html"), F.col("url")).alias("r"))
    found = {r["id"]: [(x["url"], x["title"], str(x["day"])) for x in r["r"]] for r in d.collect()}
    assert found == {
        1: [], 2: [], 3: [], 4: [], 5: [("http://a.cn/x/t20241301_1.html", "a & b", "None"), ("http://a.cn/y/t20240102_2.html", "T", "2024-01-02")], 6: [],
        7: [("t20240101_1.html", "x", "2024-01-01")], 8: [],
    }


def test_balanced_values(spark):
    from lexweave.functions.html import balanced

    rows = [(1, 'v = {"a": {"b": "};"}, "c": [1]}; {'), (2, "v = [[1], ']'] x"), (3, "v = {{}"), (4, None), (5, ""), (6, "w = {}"), (7, "v = {'it\\'s }': 1}")]
    d = spark.createDataFrame(rows, "id int, t string").select("id", balanced(F.col("t"), F.lit(r"\bv\s*=\s*")).alias("v"))
    assert {r["id"]: r["v"] for r in d.collect()} == {1: '{"a": {"b": "};"}, "c": [1]}', 2: "[[1], ']']", 3: None, 4: None, 5: None, 6: None, 7: "{'it\\'s }': 1}"}


def test_soft_404(spark):
    from lexweave.functions.html import soft_404

    rows = [(1, None), (2, ""), (3, "Page Not Found"), (4, "fine"), (5, "not found " + "x" * 3000), (6, " " * 3000 + "404")]
    d = spark.createDataFrame(rows, "id int, t string").select("id", soft_404(F.col("t")).alias("s"))
    assert {r["id"]: r["s"] for r in d.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_overlaps_of_one_person_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 12), rng.choice(["a", "b", None]), s, rng.choice([None, s - 3, s, s + rng.randint(1, 80)])) for s in (rng.choice([None, rng.randint(24000, 24200)]) or 24100 for _ in range(80))]
    careers = spark.createDataFrame(rows, "person_id int, org string, start_m int, end_m int")
    columns = ["grp", "a", "b", "from_m", "to_m", "months"]
    every = J.overlap_pairs(careers, "org").filter("a = 5 or b = 5").select(columns)
    assert sorted(map(tuple, J.overlaps_of(careers, 5, "org").select(columns).collect())) == sorted(map(tuple, every.collect()))


def test_pages_of_empty_and_null_rows(spark):
    from lexweave.operators import assembly as A

    careers = spark.createDataFrame([(1, None, None, None, None), (1, " ", "p", 10, None), (2, "o", "p", 5, 9), (None, None, "p", None, None)], "person_id long, organization string, province string, start_m int, end_m int")
    people = spark.createDataFrame([(2, "two")], "person_id long, name string")
    found = {(r["part"], r["place"], r["other"], r["n"]) for r in A.profile(careers, people, 1).collect()}
    assert found == {("career", None, None, None), ("career", "p", None, None), ("government", "p", None, 1), ("colleague", "p", 2, 1)}
    assert A.profile(careers, people, 9).count() == 0

    docs = spark.createDataFrame([(1, "u", "s", None, None, None), (2, "u", "s", None, "pol", "b  b"), (3, None, "s", None, "pol", ""), (4, "v", None, None, "foc", None), (5, "w", "s", None, "none", None)], "id int, url string, site_key string, day date, title string, body string")
    sites, overlay = spark.createDataFrame([], "site_key string, admin_level string"), spark.createDataFrame([("v", "", "x")], "url string, tag string, note string")
    rows = A.collection(docs, sites, overlay, F.col("title") == "pol", F.col("id").isin(1, 4), [("foc", "F")], ["ol"], "else")
    assert {r["url"]: (r["id"], r["tier"], r["in_policy"], r["in_focus"], r["tag"], r["note"], r["china"], r["snippet"]) for r in rows.collect()} == {"u": (2, None, True, True, "else", "", True, "b b"), "v": (4, None, False, True, "F", "x", False, "")}
    assert {(r["kind"], r["key"]): r["n"] for r in A.collection_counts(rows).collect()} == {("site", "s"): 1, ("total", "all"): 2, ("total", "in_policy"): 1, ("total", "in_focus"): 2, ("total", "china"): 1}
    assert A.collection_counts(rows.limit(0)).count() == 0

    mapping, taxonomy = spark.createDataFrame([], "doc_id int, item_id string"), spark.createDataFrame([("t", "g")], "item_id string, category string")
    assert [tuple(r) for r in A.annotation_overview(mapping, taxonomy).collect()] == [("t", "g", 0, 0.0, 0, 0)]
    again = spark.createDataFrame([(1, "t"), (1, "t"), (2, "t"), (3, "__none__")], "doc_id int, item_id string")
    ranked = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "doc_id int, rank double")
    assert [(r["place"], r["doc_id"], r["linked"]) for r in A.annotation_items(again, ranked).orderBy("place").collect()] == [(1, 2, 2), (2, 1, 2)]

    report = spark.createDataFrame([], "id int, site_key string, importance string, crawled date, written timestamp")
    assert A.daily_report(report, "2024-01-15").count() == 0


def test_sites_of_branches(spark):
    from lexweave.operators import assembly as A

    rules = spark.createDataFrame([("ab", "x", False), ("a", "y", False), ("a", "z", True), ("q", "other", True)], "rule string, leaf string, exact boolean")
    sites = spark.createDataFrame([("a",), ("a",), ("abc",), ("ac",), ("q",), ("r",), ("",)], "site_key string")
    assert {r["site_key"]: (r["leaf"], r["unmapped"]) for r in A.classified_sites(sites, rules).collect()} == {"a": ("z", False), "abc": ("x", False), "ac": ("y", False), "q": ("other", False), "r": ("other", True), "": ("other", True)}
    tree = spark.createDataFrame([("top", None), ("x", "top"), ("y", "top"), ("z", None), ("other", None)], "id string, parent_id string")
    inside = lambda node: {r["site_key"] for r in A.branch_sites(sites, rules, tree, node).filter("inside").collect()}
    assert (inside("top"), inside("z"), inside("nosuch")) == ({"abc", "ac"}, {"a"}, set())


def test_item_limit_comes_before_the_shuffle(spark, sf_dir):
    from lexweave.plans import assembly

    plan = assembly.BOOK.queries["g14_annotation_items"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan[plan.index("WindowGroupLimit") :]


def test_overlap_totals_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(1, 9)]), rng.choice(["a", "b", None]), s, rng.choice([None, s - 3, s, s + rng.randint(1, 80)])) for s in (rng.randint(24000, 24150) for _ in range(120))]
    careers = spark.createDataFrame([*rows, rows[0], (3, "a", None, 24100)], "person_id int, org string, start_m int, end_m int")
    pairs = J.overlap_pairs(careers, "org").select("grp", F.explode(F.array("a", "b")).alias("person"), "months")
    expected = {tuple(r) for r in pairs.groupBy("grp", "person").agg(F.count("*"), F.sum("months")).collect()}
    assert expected == {tuple(r) for r in J.overlap_totals(careers, "org").select("grp", "person", "overlaps", "months").collect()}
    assert J.overlap_totals(careers.limit(0), "org").count() == 0


def test_densest_block_is_the_innermost_of_the_largest(spark):
    from lexweave.functions.html import densest_div

    page = "<div id=out><p>" + "n" * 5 + "</p><div id=in><p>" + "a" * 60 + "<p>" + "b" * 40 + "</p></div></div><div><p>side</p></div>"
    pages = [(1, page), (2, None), (3, ""), (4, "<p>alone</p>"), (5, "<div>" * 3000 + "<p>x</p>" * 3000)]
    found = {r["id"]: r["t"] for r in spark.createDataFrame(pages, "id int, html string").select("id", densest_div("html").alias("t")).collect()}
    assert found == {1: "a" * 60 + "\n" + "b" * 40, 2: "", 3: "", 4: "alone", 5: "\n".join("x" * 3000)}


def test_other_files_come_back(spark, tmp_path):
    from lexweave.sources import files, sinks

    at = f"file://{tmp_path}"
    (tmp_path / "c.json").write_text('{"a":\n [1, 2], "b": {"c": "x"}}')
    assert files.json_config(spark, f"{at}/c.json").select("a", "b.c").first() == ([1, 2], "x")
    (tmp_path / "l.jsonl").write_text('{"a": 1, "t": "x"}\nbad\n{"a": null}\n')
    assert [tuple(r) for r in files.json_lines(spark, f"{at}/l.jsonl", "a int, t string").collect()] == [(1, "x"), (None, None), (None, None)]

    df = spark.createDataFrame([(1, "x\ny", "s"), (2, None, "t"), (3, "", "t")], "id int, t string, g string")
    rows = sorted(map(tuple, df.collect()), key=repr)
    sinks.json(df, f"{at}/j")
    assert sorted(map(tuple, files.json_lines(spark, f"{at}/j", df.schema).collect()), key=repr) == rows
    for parts in (None, ["g"]):
        sinks.overwrite(df, f"{at}/p", parts)
        assert sorted(map(tuple, files.parquet(spark, f"{at}/p").select("id", "t", "g").collect()), key=repr) == rows
    sinks.append(df, f"{at}/a")
    sinks.append(df.limit(1), f"{at}/a")
    assert files.optional(spark, f"{at}/a", df.schema).count() == 4
    assert sorted(map(tuple, files.parquet(spark, sinks.snapshot(df, f"{at}/s", "2024-01-05")).collect()), key=repr) == rows

    sinks.html_files(spark.createDataFrame([("s", "<p>a\nb</p>")], "site_key string, html string"), f"{at}/h")
    assert files.raw_html(spark, f"{at}/h/site_key=s").first()["html"].rstrip("\0") == "<p>a\nb</p>"


def test_counted_pages(spark):
    from lexweave.sources import files

    pages = lambda rows: sorted(r["page"] for r in files.counted_pages(spark.createDataFrame(rows, "page int, body string"), 2).collect())
    assert pages([(0, '{"total": 3}'), (1, "x"), (2, "again"), (3, None)]) == [0, 1]
    assert pages([(0, "bad"), (1, None)]) == [0, 1]
    assert pages([(0, '{"total": 0}')]) == []
    assert pages([]) == []


def test_citations_are_planned_in_steps(spark):
    """F1-F8: one plan with everything from texts to edges took the driver's memory."""
    rows = [(i, "s", f"国务院关于第{i}期海洋经济的实施方案", f"国发〔2020〕{i}号", f"按照国发〔2020〕{i + 1}号，落实《国务院关于第{i + 2}期海洋经济的实施方案》。", ["第9期海洋经济的实施方案"]) for i in range(5)]
    docs = spark.createDataFrame(rows, "id long, site_key string, title string, number string, body string, references array<string>")
    edges = CI.build_citations(docs, spark.createDataFrame([("s", "central")], "site_key string, admin_level string"))
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 8
    assert {(r["source_id"], r["target_id"], r["citation_type"]) for r in edges.collect()} == {*((i, i + 1 if i < 4 else None, "formal") for i in range(5)), *((i, i + 2 if i < 3 else None, "named") for i in range(5)), *((i, None, "llm") for i in range(5))}


def test_citations_are_not_broadcast(spark, monkeypatch):
    """What grows with the corpus went through the driver's memory; only the table of sites may be sent to all tasks."""
    plans = []

    def written(df, label, write=CI.materialize):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]))
        return write(df, label)

    monkeypatch.setattr(CI, "materialize", written)
    monkeypatch.setattr(J, "materialize", written)
    rows = [(i, "s", f"国务院关于第{i}期海洋经济的实施方案", f"国发〔2020〕{i}号", f"按照国发〔2020〕{i + 1}号，落实《国务院关于第{i + 2}期海洋经济的实施方案》。", ["第9期海洋经济的实施方案"]) for i in range(5)]
    schema = "id long, site_key string, title string, number string, body string, references array<string>"
    root = files_of(spark, rows, schema)
    edges = CI.build_citations(root, files_of(spark, [("s", "central")], "site_key string, admin_level string"))
    assert {"formal-references", "named-references", "titles-in-names", "resolved-titles", "citations"} <= {label for label, _ in plans}
    assert not [label for label, p in plans if "Broadcast" in p and label not in ("extracted", "canonical-references")]
    assert "Join" not in edges._jdf.queryExecution().executedPlan().toString()


def test_chains_are_not_broadcast(spark):
    """chains as by brute force, in one join of written pairs; citations back and lone middles among them."""
    rng = random.Random(12)
    pairs = sorted({(12, 0), *((rng.randrange(12), rng.choice([None, *range(12), 13])) for _ in range(40))}, key=str)
    level = {0: "central", **{i: rng.choice(["central", "district", None]) for i in range(1, 13)}}
    edges, levels = files_of(spark, pairs, "source_id long, target_id long"), files_of(spark, list(level.items()), "id long, level string")
    found = G.chains(edges, levels, "central")
    known = [p for p in pairs if p[1] in level]
    want = [(t, s, f, " > ".join(x for x in ("central", level[s], level.get(f)) if x)) for s, t in known if level[t] == "central" for f in [x for x, via in known if via == s and x != t] or [None]]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str) and any(w[2] is None for w in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def files_of(spark, rows, schema):
    from lexweave.session import materialize

    return materialize(spark.createDataFrame(rows, schema), "rows")


@pytest.mark.parametrize("crowd", [5, 2048])
def test_longest_overlaps_are_those_of_all_pairs(spark, crowd):
    """with up to 12 intervals of a person in a group, one block and several; no pair of people with few is shuffled."""
    rng = random.Random(9)
    some = [(rng.choice([None, *range(1, 30)]), rng.choice(["a", "b", None]), s, rng.choice([None, s - 3, s, s + rng.randint(1, 40)])) for s in (rng.choice([None, rng.randint(24000, 24300)]) for _ in range(90)) if s]
    for rows in (some, [*some, *((7, "a", 24000 + 11 * k, 24006 + 12 * k) for k in range(12))]):
        careers = spark.createDataFrame(rows, "person_id int, org string, start_m int, end_m int")
        names = spark.createDataFrame([(p, f"n{p}" if p % 5 else None) for p in range(1, 29)], "person int, name string")
        want = J.overlap_pairs(careers, "org").groupBy("grp", "a", "b").agg(F.max("months").alias("months"))
        want = {tuple(r) for r in want.collect()}
        got = J.longest_overlaps(careers, "org", crowd=crowd).select("grp", "a", "b", "months").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        named = J.longest_overlaps(careers, "org", names=names, crowd=crowd).select("grp", "a", "b", "months", "name_a", "name_b").collect()
        assert {tuple(r) for r in named} == {(*w, *(f"n{p}" if p % 5 else None for p in w[1:3])) for w in want if 29 not in w[1:3]} and len(named) == len({r[:4] for r in map(tuple, named)})
    few = J.longest_overlaps(careers.filter("person_id <> 7"), "org")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in few[: few.index("SortMergeJoin")]
    assert J.longest_overlaps(careers.limit(0), "org").count() == 0


@pytest.mark.parametrize("top", [1, 7, 60, 100000])
def test_top_overlaps_are_those_of_all_pairs(spark, top):
    """the top list comes before the grouping, also where a pair meets in several groups and intervals."""
    rng = random.Random(10)
    rows = [(rng.choice([None, *range(1, 25)]), rng.choice(["a", "b", "c", None]), s, rng.choice([None, s - 3, s, s + 24, s + 30])) for s in (24000 + 6 * rng.randint(0, 12) for _ in range(200))]
    careers = spark.createDataFrame([*rows, *rows[:20]], "person_id int, org string, start_m int, end_m int")
    order = [F.desc("months"), "a", "b"]
    want = J.overlap_pairs(careers, "org").groupBy("a", "b").agg(F.max("months").alias("months")).orderBy(*order).limit(top).collect()
    found = J.top_overlaps(careers, "org", top)
    assert found.collect() == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.rindex("GlobalLimit") < plan.index("Join")
    assert J.top_overlaps(careers.limit(0), "org", top).count() == 0


def test_overlaps_of_a_large_group_are_dealt(spark):
    """one group, in blocks of three intervals and in one block; blocks are keys of the join."""
    rng = random.Random(11)
    careers = spark.createDataFrame([(p % 30, "x", s := rng.randint(24000, 24060), s + rng.randint(0, 40)) for p in range(60)], "person_id int, org string, start_m int, end_m int")
    dealt = J.overlap_pairs(careers, "org", crowd=3)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, J.overlap_pairs(careers, "org").collect()))
    sizes = sorted(r["n"] for r in J.overlap_pairs(careers, "org", crowd=3).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    assert len(sizes) > 1 and sizes[-1] < dealt.count()


def shuffled_records(spark, run):
    """Rows that run() wrote to shuffles."""
    spark_context = spark.sparkContext
    none = spark_context._gateway.new_array(spark_context._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (x.apply(i) for x in [spark_context._jsc.sc().statusStore().stageList(None, False, False, none, None)] for i in range(x.size()))}
    before = stages()
    result = run()
    return sum(n for i, n in stages().items() if i not in before), result


def test_overlaps_of_a_large_group_shuffle_no_pairs(spark):
    """an interval is shuffled a bounded number of times, however many blocks of crowd its group has, repeated rows come
    as often as they are, and the join passes its pairs on one by one (it isn't compiled together with what follows)."""
    rng = random.Random(12)
    rows = [(rng.choice([None, *range(90)]), rng.choice(["x"] * 20 + ["y", None]), s, rng.choice([None, s - 2, s, s + 1, s + rng.randint(2, 30), s + 200])) for s in (rng.randint(24000, 24070) for _ in range(700))]
    rows += [(91, "x", 24010, 24020)] * 12 + rows[:30]
    careers = spark.createDataFrame(rows, "person_id int, org string, start_m int, end_m int")
    end = lambda r: r[2] + 48 if r[3] is None else r[3]
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    for crowd in (4, 50, 5000):
        n, got = shuffled_records(spark, lambda: (found := J.overlap_pairs(careers, "org", crowd=crowd)) and found.collect())  # noqa: B023
        want = [(a[1], a[0], b[0], f, t, t - f) for a in known for b in known if a[0] < b[0] and a[1] == b[1] and (t := min(end(a), end(b))) > (f := max(a[2], b[2]))]
        assert sorted(map(tuple, got)) == sorted(want)
        assert n < 6 * len(rows), (crowd, n)
    found = J.overlap_pairs(careers, "org", least=7)
    assert sorted(map(tuple, found.collect())) == sorted(w for w in want if w[5] >= 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"\*\(\d+\) SortMergeJoin", plan)
