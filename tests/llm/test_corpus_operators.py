"""Operators that compare documents, and the pipeline."""

import gzip
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexweave.llm import exact_dedup, packing, queries, sharding, simhash, warc
from lexweave.llm.common import fresh_path

SCHEMA = "doc_id long, text string, keep_id string, key long, shard int, fp long"
ROWS = [(5, "a  b", "x", 1, 1, 1), (2, "a\tb", "x", 1, 1, 1), (2, "a\tb", "y", 2, 2, 2), (9, None, None, None, None, None), (8, "", None, None, None, None), (None, "a b", None, None, None, None), (4, "word " * 50_000, None, None, None, None), (7, "single", None, None, None, None), (None, "only null", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    result = c.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[k] for k in sorted(names)) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[k] for k in sorted(df.columns)) for r in df.collect()), key=repr) == want


def test_only_local_masters_write_to_the_machine(spark, monkeypatch):
    class Remote:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        fresh_path(Remote, "x")


def test_intermediates_can_be_removed(spark, docs):
    from lexweave.llm.common import materialize, remove_intermediates, shared_dir

    materialize(docs, "some")
    remove_intermediates(spark)
    assert not os.path.exists(shared_dir(spark).removeprefix("file://") + "/lexweave")


# Exact dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_cases(docs, none):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()), key=repr)
    assert got == sorted([(2, 2, 4, True), (2, 2, 4, False), (5, 2, 4, False), (None, 2, 4, False), (8, 8, 2, True), (9, 8, 2, False), (4, 4, 1, True), (7, 7, 1, True), (None, None, 1, True)], key=repr)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_against_history(spark, docs):
    digest = bytearray(hashlib.sha256(b"a b").digest())
    history = spark.createDataFrame([(digest, -3, 10)], "digest binary, winner long, group_size long")
    got = {(r["doc_id"], r["keep_id"], r["kept"], r["seen_before"]) for r in exact_dedup.exact_dedup(docs, history).collect()}
    assert {(2, -3, False, True), (5, -3, False, True), (None, -3, False, True), (8, 8, True, False), (7, 7, True, False)} <= got


def test_history_with_repeats_and_nulls(spark, docs):
    digest = bytearray(hashlib.sha256(b"a b").digest())
    rows = [(digest, -3, 10), (digest, -8, 5), (None, 1, 1), (bytearray(b"short"), 1, 1), (bytearray(hashlib.sha256(b"other").digest()), 4, None)]
    history = spark.createDataFrame(rows, "digest binary, winner long, group_size long")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["seen_before"]) for r in exact_dedup.exact_dedup(docs, history).collect())
    want = [(2, -8, 15, False, True)] * 2 + [(5, -8, 15, False, True), (None, -8, 15, False, True), (8, 8, 2, True, False), (9, 8, 2, False, False), (4, 4, 1, True, False), (7, 7, 1, True, False), (None, None, 1, True, False)]
    assert got == Counter(want)
    none = spark.createDataFrame([], "digest binary, winner long, group_size long")
    assert exact_dedup.exact_dedup(docs, none).filter("not seen_before").count() == len(ROWS)


def test_null_and_repeated_ids_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 10)
    rows = [(None, "hot")] * 120 + [(7, "again")] * 80 + [(None, "x")]
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, None, 120, True): 1, (None, None, 120, False): 119, (7, 7, 80, True): 1, (7, 7, 80, False): 79, (None, None, 1, True): 1})


def test_hot_digest_is_dealt_over_copies(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 10)
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 5)
    rows = [(i, "same" if i % 3 else f"text {i // 6}") for i in range(300)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t in rows}


def test_hash_is_minimal_and_perfect():
    digest = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    shard = exact_dedup.Shard(exact_dedup.pack_shard(digest[:4000], np.arange(4000), np.ones(4000, bool), np.ones(4000, np.int64), np.arange(4000)))
    slots = shard.lookup(digest)
    assert sorted(slots[:4000]) == list(range(4000)) and (slots[4000:] == -1).all() and (shard.winner[slots[:4000]] == np.arange(4000)).all()
    clash = digest[:1].copy()
    clash[0, 31] ^= 1
    assert shard.lookup(clash)[0] == -1
    assert exact_dedup.MinimalPerfectHash.build(digest[:0]).slots(digest[:3]).tolist() == [-1] * 3


# Sharding


def least_capacity(sizes, shards):
    def fits(c):
        n, room = 0, -1
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    low, high = 0, sum(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def expected_loads(groups, shards):
    """groups: key -> bytes. Loads of the groups that fill a shard alone, and the others' sizes in order."""
    alone, total = [], sum(groups.values())
    for key, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        if shards - len(alone) > 1 and size * (shards - len(alone)) >= total:
            alone.append(key)
            total -= size
        else:
            break
    return [groups[k] for k in sorted(alone)], [groups[k] for k in sorted(groups) if k not in alone]


@pytest.mark.parametrize("seed", range(5))
def test_shards_are_near_equal(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "STEP_BITS", 2)
    monkeypatch.setattr(sharding, "RANGE_LIMIT", 4 if seed % 2 else 2048)
    rng = random.Random(seed)
    rows = [(i, "x" * rng.choice([1, 5, 50, 400 if seed > 1 else 20]) + str(rng.randint(0, 60))) for i in range(400)]
    if seed == 4:  # a group of a third of all bytes, and one that fills a shard of what is left
        rows += [(400 + i, "hot" * 30) for i in range(sum(len(t) + 16 for _, t in rows) // 2 // 106)] + [(9000 + i, "warm" * 20) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed, text_of = sharding.shard_documents(docs, 7), dict(rows)
    groups = Counter()
    for r in docs.select(F.xxhash64("text").alias("key"), (F.octet_length("text") + 16).alias("size")).collect():
        groups[r["key"]] += r["size"]
    got = placed.collect()
    loads, shard_of = Counter(), {}
    for r in got:
        loads[r["shard"]] += r["size"]
        assert shard_of.setdefault(text_of[r["doc_id"]], r["shard"]) == r["shard"]
    alone, rest = expected_loads(groups, 7)
    others = [loads[k] for k in range(len(alone), 7)]
    assert [loads[k] for k in range(len(alone))] == alone and len(got) == len(rows) and set(loads) == set(range(7))
    assert max(others) <= least_capacity(rest, len(others))
    assert max(others) - min(others) <= max(rest) and (seed < 4 or len(alone) > 0)
    for s in loads:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


@pytest.mark.parametrize("seed", range(150))
def test_cuts_under_the_smallest_capacity(seed):
    rng = random.Random(seed)
    shards = rng.randint(1, 20)
    sizes = [rng.choice([1, 5, 20, 100]) * rng.randint(1, 5) for _ in range(rng.randint(shards, 200))]
    ranges = sharding.Ranges([(i, 64, s, 1) for i, s in enumerate(sizes)], max(sizes))
    capacity = ranges.bounds(shards)[1]
    ends, open_ranges = ranges.cuts(capacity, shards)
    edges = [0, *ends, sum(sizes)]
    loads = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    assert capacity == least_capacity(sizes, shards) and not open_ranges and set(edges) <= set(ranges.sums)
    assert max(loads) <= capacity and max(abs(x - sum(sizes) / shards) for x in loads) <= max(sizes)


def test_sharding_cases(docs, none):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] in (9, 8):
            assert (r["size"], r["text_crc32"]) == (16, 0)
        if r["doc_id"] == 7:
            assert (r["size"], r["text_crc32"]) == (22, zlib.crc32(b"single"))
    assert len({r["shard"] for r in got if r["doc_id"] in (9, 8)}) == 1
    assert sharding.shard_documents(none).count() == 0


def test_sharding_runs_no_python(spark, sf_dir):
    plan = sharding.op4_sharding(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# SimHash


def print_of(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_of(prints, radius=2):
    """prints: [(id, fingerprint)] -> id -> smallest id reachable."""
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, f in prints:
        for b, g in prints:
            if a < b and (f ^ g).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def near_rows():
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(120)] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(120)] = "CHANGED"
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return [*rows, (150, ""), (151, None), (152, "one"), (153, "ONE"), (154, "one two")]


@pytest.mark.parametrize("bucket_rows", [20_000, 2])
def test_links_as_by_brute_force(spark, bucket_rows):
    rows = near_rows()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=bucket_rows).collect()}
    prints = [(i, print_of(t)) for i, t in rows]
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == dict(prints)
    assert {i: r["component_id"] for i, r in got.items()} == component_of(prints)


def test_simhash_cases(docs, none, monkeypatch):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and {r["component_id"] for r in got if r["fp"] == 0} == {8}
    assert [r["component_id"] for r in got if r["fp"] % 2**64 == print_of("only null")] == [None]
    assert simhash.near_duplicates(none).count() == 0 and simhash.similar_documents(none).count() == 0
    text = " ".join(str(i) for i in range(3000))
    want = print_of(text)
    monkeypatch.setattr(simhash, "WINDOW", 100)
    assert simhash.fingerprint(text) == want == simhash.fingerprint("  " + text + "\n")


def test_long_words_after_blanks_stay_whole(monkeypatch):
    monkeypatch.setattr(simhash, "WINDOW", 100)
    for text in (" " + "x" * 250, "  " + "x" * 250 + " y", "a b " + "x" * 99 + " " + "y" * 300 + "\nz"):
        assert [w for run in simhash._words(text.encode()) for w in run] == text.encode().split()
        assert simhash.fingerprint(text) == print_of(text)


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (30, 4), dtype=np.uint64)
    flips = lambda f, k: f ^ np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in range(4)], np.uint64)
    fps = np.array([flips(base[rng.integers(0, 30)], int(rng.integers(0, 9))) for _ in range(200)])
    for radius in (0, 2, 5, 12, 46):
        sizes = np.array([1, 70, 129])
        root = simhash.bucket_links(fps, sizes, radius)
        at = 0
        for n in sizes:
            ints = [(i, sum(int(x) << 64 * k for k, x in enumerate(fps[i]))) for i in range(at, at + n)]
            assert {i: int(root[i]) for i, _ in ints} == component_of(ints, radius)
            at += n


def test_groups_that_are_linked_already_lose_nothing():
    rng = np.random.default_rng(3)
    one, other = rng.integers(0, 2**63, (2, 1), dtype=np.uint64)
    fps = np.array([(one if i < 200 or i % 50 else other) ^ np.uint64(1 << int(rng.integers(0, 63))) for i in range(400)])
    ints = [(i, int(f[0])) for i, f in enumerate(fps)]
    assert dict(enumerate(simhash.bucket_links(fps, np.array([400]), 2).tolist())) == component_of(ints, 2)


def test_wide_distances_tell_similarities_apart():
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    distance = lambda a, b: (int.from_bytes(simhash.wide_fingerprint(" ".join(a))[0], "little") ^ int.from_bytes(simhash.wide_fingerprint(" ".join(b))[0], "little")).bit_count()
    for extra, linked in ((60, True), (120, True), (400, False)):  # similarities 0.91, 0.83, 0.6
        longer = words + [f"x{rng.randrange(10**6)}" for _ in range(extra)]
        assert (distance(words, longer) <= simhash.WIDE_RADIUS) is linked


def test_hot_keys_join_like_others(spark):
    from lexweave.llm.common import join_hot_keys

    rows = spark.createDataFrame([(i, i % 700 if i % 3 else 5) for i in range(3000)], "doc_id long, fp long")
    counts = rows.groupBy("fp").count().withColumnRenamed("count", "n")
    named = counts.select("fp", (F.col("fp") * 2).alias("component_id"))
    got = sorted((r["doc_id"], r["fp"], r["component_id"]) for r in join_hot_keys(rows, named, counts, "fp").collect())
    assert got == [(i, f, 2 * f) for i in range(3000) for f in [i % 700 if i % 3 else 5]]


def test_components_of_long_chains(spark):
    chain = [(i + 1, i) for i in range(60)] + [(101, 100), (102, 100), (103, 102)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in (101, 102, 103)}}


def test_similar_documents(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(400)] for _ in range(5)]
    rows = []
    for k, words in enumerate(base):
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 4):
            copy = list(words)
            for _ in range(3):
                copy[rng.randrange(400)] = "x"
            rows.append((10 * k + j, " ".join(copy)))
    for bucket_rows in (20_000, 2):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=bucket_rows).collect()}
        assert got == {i: i // 10 * 10 for i, _ in rows}


def shingles_of(text, n=5):
    words = text.lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def components_by_sets(rows, least=0.8):
    parent, sets = {i: i for i, _ in rows}, [(i, shingles_of(t)) for i, t in rows]

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, x in sets:
        for b, y in sets:
            if a < b and len(x & y) >= least * len(x | y) - 1e-9:
                i, j = find(a), find(b)
                parent[max(i, j)] = min(i, j)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_links_are_verified_around_the_threshold(spark, bucket_rows):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for group in range(16):  # a text with 76 to 100 new words after its 304 has a similarity of 0.8 to 0.75
        words = fresh(304)
        rows.append((10 * group, " ".join(words)))
        rows += [(10 * group + j, " ".join(words + fresh(extra))) for j, extra in enumerate((70, 75, 76, 84, 92, 100), 1)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=bucket_rows).collect()}
    assert got == components_by_sets(rows)


def test_short_texts_of_the_threshold_link(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for group in range(60):  # four shingles against the same and one more: 0.8
        words = fresh(8)
        rows += [(2 * group, " ".join(words)), (2 * group + 1, " ".join(words + fresh(1)))]
    distance = lambda a, b: (int.from_bytes(simhash.wide_fingerprint(a)[0], "little") ^ int.from_bytes(simhash.wide_fingerprint(b)[0], "little")).bit_count()
    apart = [distance(a[1], b[1]) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert max(apart) > simhash.WIDE_RADIUS and max(apart) <= simhash.SHORT_RADIUS
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = sum(got[i] == got[i + 1] for i in range(0, 120, 2))
    assert linked >= 59 and all(got[i] == i for i in range(0, 120, 2))  # minima name the buckets: 99.8 %


def test_all_similar_pairs_of_the_documents_are_linked(spark):
    """Every pair of documents at sf 0.01 by an inverted index of all shingles, hot ones included."""
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {i: shingles_of(t) for i, t in rows}
    by_set = defaultdict(list)
    for i, s in sorted(sets.items()):
        by_set[frozenset(s)].append(i)
    first = {ids[0]: s for s, ids in by_set.items()}
    holders, parent = defaultdict(list), {i: i for i in first}
    for i, s in first.items():
        for x in s:
            holders[x].append(i)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in first.items():
        shared = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(first[j]) - n) - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(ids[0]) for ids in by_set.values() for i in ids}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 50 and sum(got[i] == want[i] for i in linked) >= 0.998 * len(linked)
    assert all(want[got[i]] == want[i] for i in got)


def test_repeated_lines_count_once(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    words, line, menu = fresh(204), fresh(20), fresh(30)
    rows = [(1, " ".join(words)), (2, " ".join(words + line * 30))]
    rows += [(k, " ".join(menu * 60 + fresh(40))) for k in range(10, 40)]  # one repeated menu, different bodies
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_sets(rows) and got[2] == 1


def test_failed_pairs_hide_no_verified_link():
    fps = np.zeros((200, 1), np.uint64)
    root = simhash.bucket_links(fps, np.array([200]), 2, same=lambda a, b: a % 3 == b % 3)
    assert root.tolist() == [i % 3 for i in range(200)]


# Packing


def check_plan(histogram, plan, capacity):
    ranks = defaultdict(list)
    for n, rank, count, *_ in plan.entries().tolist():
        ranks[n].append((rank, rank + count))
    for n, count in histogram.items():
        spans = sorted(ranks[n])
        assert spans[0][0] == 0 and spans[-1][1] == count and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(sum(n for n, _ in content) <= capacity for _, content in plan.runs)


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    high = rng.choice([10, 600, 2048])
    histogram = Counter()
    for _ in range(rng.choice([1, 2, 5, 50, 500])):
        histogram[rng.randint(1, high)] += rng.choice([1, 1, 7, 1000])
    plan = packing.best_plan(dict(histogram))
    check_plan(histogram, plan, 2048)
    rooms, used = [], 0
    import bisect

    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else 2048
        used += i >= len(rooms) + 1 or room == 2048
        bisect.insort(rooms, room - n)
    assert plan.sequences <= len(rooms) * 1.02 + 1


def test_plan_grows_with_counts_only():
    histogram = {n: 3 + n % 5 for n in range(100, 2049, 7)}
    small, large = packing.Plan(histogram), packing.Plan({n: c * 1_000_003 for n, c in histogram.items()})
    assert len(large.runs) < 3 * len(small.runs) + 1000
    check_plan({n: c * 1_000_003 for n, c in histogram.items()}, large, 2048)


def test_pieces_of_documents(spark, docs, none, monkeypatch):
    path = packing.vocabulary_path()
    reference = Tokenizer.from_file(path)
    special = spark.createDataFrame([(20, "a <|endoftext|> b"), (21, "\x1c \x85 tail  ")], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(special)
    monkeypatch.setattr(packing, "BIN_ROWS", 5)
    got = packing.pack(frame, path).collect()
    texts = [*((r[0], r[1]) for r in ROWS), (20, "a <|endoftext|> b"), (21, "\x1c \x85 tail  ")]
    want = Counter()
    for doc_id, text in texts:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        at = n = 0
        while at < len(ids):
            size = 2048 if at else len(ids) % 2048 or 2048
            want[doc_id, n, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at, n = at + size, n + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, path).count() == 0


def test_portions_give_the_same_ids(monkeypatch):
    path = packing.vocabulary_path()
    text = " ".join(f"wörd{i}\n\n  x" for i in range(400))
    want = packing.encoder(path)(text)
    monkeypatch.setattr(packing, "PORTION", 50)
    assert packing.encoder(path)(text) == want == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# WARC


@pytest.mark.parametrize("broadcast_bytes", [warc.BROADCAST_BYTES, -1])
def test_archives_round_trip(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(warc, "ROLL", 10_000)
    same, big = "z" * 5000, "".join(map(chr, range(97, 123))) * 120_000
    rows = [(1, "u", same), (5, "v", same), (3, None, same), (None, "w\r\nx", same), (7, "q", None), (8, "q", ""), (9, "big", big), (5, "v", same), (10, "s", "short"), (11, "s", "short"), (12, "t", big), (None, "n", "n" * 2000), (None, "n", "n" * 2000)]
    frame = spark.createDataFrame([(*r, "c", 0) for r in rows], "page_id long, url string, html string, sha1 string, payload int")
    listing = warc.write_archives(warc.decide(frame, broadcast_bytes=broadcast_bytes), fresh_path(spark, "warc"))
    chunks = warc.read_archives(listing).collect()
    last = [r for r in chunks if r["last"]]
    assert len(last) == len(rows) == sum(r["records"] for r in listing.collect())
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in last)
    assert kinds == Counter([(1, "revisit", 5), (5, "response", None), (5, "response", None), (3, "revisit", 5), (None, "revisit", 5), (7, "response", None), (8, "response", None), (9, "revisit", 12), (10, "response", None), (11, "response", None), (12, "response", None), (None, "response", None), (None, "response", None)])
    pieces = sorted((r["chunk_no"], bytes(r["data"])) for r in chunks if r["page_id"] == 12)
    assert len(pieces) == 3 and b"".join(d for _, d in pieces) == big.encode()
    bare = warc.read_archives(listing, with_data=False).collect()
    assert Counter(r["sha1"] for r in bare) == Counter(r["sha1"] for r in chunks) and {r["data"] for r in bare if r["page_id"] == 12} == {None}
    for r in last:
        html = next(c or "" for a, u, c in rows if a == r["page_id"] and (a is not None or (c or "")[:1] == ("z" if r["refers_to"] else "n")))
        assert (r["payload_bytes"], r["sha1"]) == (len(html), hashlib.sha1(html.encode()).hexdigest())
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.decide(empty), fresh_path(spark, "warc"))).count() == 0


def test_revisits_refer_to_their_response(spark):
    frame = spark.createDataFrame([(1, "u", "z" * 5000), (2, "v", "z" * 5000), (3, "w", "y")], "page_id long, url string, html string")
    listing = warc.write_archives(warc.decide(frame), fresh_path(spark, "warc"))
    found = {}
    for path in (r["path"] for r in listing.collect()):
        with gzip.open(path.removeprefix("file://")) as f:
            for record in f.read().split(b"WARC/1.1\r\n")[1:]:
                fields = warc._fields(b"WARC/1.1\r\n" + record.split(b"\r\n\r\n")[0])
                found[fields["x-page-id"]] = fields
    assert found["1"]["warc-refers-to"] == found["2"]["warc-record-id"] and found["1"]["warc-refers-to-target-uri"] == "v"
    assert len({f["warc-record-id"] for f in found.values()}) == 3


def test_payloads_are_not_shuffled(spark, sf_dir):
    plan = warc.decide(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"Exchange hashpartitioning", plan)


def test_damaged_payload_is_reported(tmp_path):
    import pyarrow as pa

    writer = warc.ArchiveWriter(f"file://{tmp_path}", "p", "0")
    writer.begin(1, "u", 7, hashlib.sha1(b"other").hexdigest(), False, None, None)
    writer.put(b"payload")
    writer.end()
    writer.close()
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(pa.OSFile(str(tmp_path / "p-0000.warc.gz"))))


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline as P
    from lexweave.llm.common import materialize

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("digest", F.lit(1)).withColumn("KEPT", F.lit("x"))
    docs = docs.unionByName(docs.filter("doc_id = 3")).unionByName(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    columns, counts = docs.columns, [docs.count()]
    for _, stage in P.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2]
    assert before.count() == docs.count() and not [r for r in docs.collect() if re.search(r"AKIA[0-9A-Z]{16}", r["text"] or "")]
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(ids) == len(set(ids)) and None not in ids
    texts = [norm(r["text"]) for r in before.collect()]
    assert len(texts) == len(set(texts))
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == set(ids)
    assert P.run(spark, sf).count() > 0
    nothing = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, nothing, sf).count() == 0
