"""SimHash near-dedup by bit-sliced comparison.

Fingerprints: majority bits over the XXH64 (seed 42) of all word shingles. Copies collapse first: the rest works on
distinct fingerprints, each with the smallest id that has it. Two fingerprints that differ in at most two bits agree on
two of four 16-bit blocks, so each fingerprint goes into six buckets of 32 equal bits, where no link can be missed. A
bucket above BUCKET_ROWS is dealt again by two of the four 8-bit blocks of its other 32 bits; what then shares 48 bits is
at most 2**16 distinct fingerprints, so no bucket needs a cap.

In a bucket, 64 fingerprints form a word: their bits are stored as 64 vertical planes. One step compares 64 queries with
such a word: each plane is XORed with the query's bit and added to the 64 running distances by carry-save logic on
words. A block whose distances are all above the radius is abandoned. A bucket emits a tree and not all its pairs.
Components of the links come from alternating large-star and small-star rounds, each written to the shared folder.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like any other. A null id
never is a component's id unless no row of its fingerprint has one; such fingerprints get no links and a null component.
Repeated rows share their component. Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import join_hot_keys, materialize, table, text_batches, text_or_empty

RADIUS = 2
#: Distinct fingerprints in a bucket before it is dealt again.
BUCKET_ROWS = 20_000
#: Bytes of a text whose shingles are held at once.
WINDOW = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANKS = b" \t\n\x0b\x0c\r"
#: Tile pairs compared in one numpy step.
STEP = 256


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words in runs that hold about WINDOW bytes of text."""
    at = 0
    while at < len(text):
        end = min(len(text), at + WINDOW)
        if end < len(text):
            cut = max(text.rfind(bytes([c]), at, end) for c in BLANKS)
            if cut <= at:  # a word longer than the window, perhaps after a blank
                following = [x for c in BLANKS if (x := text.find(bytes([c]), end)) >= 0]
                cut = min(following, default=len(text))
            end = cut
        yield text[at:end].split()
        at = end if end == len(text) else end + 1


def shingle_hashes(text: str, words_each: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles; of the whole word sequence if it is shorter; nothing without words."""
    carry: list[bytes] = []
    hashed, seed, any_yet = xxhash.xxh64_intdigest, 42, False
    for words in _words(text.encode("utf-8", "surrogatepass").translate(LOWER)):
        words = carry + words
        if len(words) < words_each:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - words_each] + 1).tolist()]
        yield np.array([hashed(joined[a:b], seed) for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=True)], "<u8")
        any_yet = True
        carry = words[len(words) - words_each + 1 :] if words_each > 1 else []
    if not any_yet and carry:
        yield np.array([hashed(b" ".join(carry), seed)], "<u8")


def fingerprint(text: str, words_each: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text."""
    ones, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words_each):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), words_each) for t in b["text"]], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(f)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# Bit-sliced comparison


def planes_of(fps: np.ndarray) -> np.ndarray:
    """fps (64 * words, lanes) -> (64 * lanes, words): bit k of word w in plane b is bit b of fingerprint 64 * w + k."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near(planes: np.ndarray, queries: np.ndarray, tiles: np.ndarray, radius: int) -> np.ndarray:
    """queries (t, 64, lanes) against the words tiles (t,): a bit for each of the 64 x 64 pairs within the radius, as words (t, 64)."""
    width = (radius + 1).bit_length()
    out = np.zeros((len(tiles), 64), "<u8")
    alive = np.arange(len(tiles))
    counters = [np.zeros((len(tiles), 64), "<u8") for _ in range(width)]
    over = np.zeros((len(tiles), 64), "<u8")
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(len(planes)):
        carry = planes[b][tiles[alive]][:, None] ^ (np.uint64(0) - (queries[alive, :, b >> 6] >> np.uint64(b & 63) & np.uint64(1)))
        for k in range(width):  # add the plane to all distances at once
            carry, counters[k] = counters[k] & carry, counters[k] ^ carry
        above = full.copy()
        for k in range(width):
            above = above & (counters[k] if (radius + 1) >> k & 1 else ~counters[k])
        over |= above | carry
        if b % 8 == 7:
            left = (over != full).any(axis=1)
            if not left.all():
                alive, over, counters = alive[left], over[left], [c[left] for c in counters]
                if not len(alive):
                    return out
    out[alive] = ~over
    return out


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Let linked positions share the smallest label of theirs; label[x] <= x always."""
    while True:
        a, b = label[i], label[j]
        if (apart := a != b).any():
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (label[label] != label).any():
                label[:] = label[label]
        else:
            return


def _merge_verified(label: np.ndarray, i: np.ndarray, j: np.ndarray, same: Callable[[int, int], bool]) -> None:
    """_merge of those pairs that same() confirms. Each group tries a few of its pairs with smaller labels a round, twice as
    many in the next; pairs that other links connect by then need no test. No other pair is left out."""
    tries = 1
    while True:
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return
        larger = np.maximum(label[i], label[j])
        order = np.argsort(larger, kind="stable")
        i, j, larger = i[order], j[order], larger[order]
        new = np.concatenate([[True], larger[1:] != larger[:-1]])
        take = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0)) < tries
        good = np.fromiter((same(a, b) for a, b in zip(i[take].tolist(), j[take].tolist(), strict=True)), bool)
        _merge(label, i[take][good], j[take][good])
        i, j, tries = i[~take], j[~take], tries * 2


def bucket_links(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, same: Callable[[int, int], bool] | None = None) -> np.ndarray:
    """fps (n, lanes): buckets of the given sizes, one after another -> for each position the smallest linked position of its
    bucket. With same, pairs of positions within the radius are links only if it says so."""
    words = -(-sizes // 64)
    first_word = np.concatenate([[0], np.cumsum(words)])
    lane = np.arange(len(fps)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(first_word[:-1] * 64, sizes) + lane
    padded, used = np.zeros((first_word[-1] * 64, fps.shape[1]), "<u8"), np.zeros(first_word[-1] * 64, bool)
    padded[place], used[place] = fps, True
    planes, queries = planes_of(padded), padded.reshape(-1, 64, fps.shape[1])
    valid = np.packbits(used.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    label = np.arange(len(padded))
    back = np.full(len(padded), -1)
    back[place] = np.arange(len(fps))

    def compare(left: np.ndarray, right: np.ndarray) -> None:
        bits = near(planes, queries[left], right, radius) & valid[right][:, None]
        bits[~used.reshape(-1, 64)[left]] = 0
        t, q = np.nonzero(bits)
        if len(t):
            hit = np.unpackbits(bits[t, q].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, k = np.nonzero(hit)
            i, j = left[t[row]] * 64 + q[row], right[t[row]] * 64 + k
            if same is None:
                _merge(label, i, j)
            else:
                _merge_verified(label, i, j, lambda a, b: same(int(back[a]), int(back[b])))

    pending: list[np.ndarray] = []
    held = 0
    for w, n in zip(first_word[:-1].tolist(), words.tolist(), strict=True):
        for i in range(n):  # each word of the bucket with itself and the later ones
            right = np.arange(w + i, w + n)
            if i:  # what is one group already needs no further link
                mine = label[(w + i) * 64 : (w + n) * 64].reshape(-1, 64)
                one = ((mine == mine[0, 0]) | ~used[(w + i) * 64 : (w + n) * 64].reshape(-1, 64)).all(axis=1)
                right = right[~one] if one[0] else right
                if not len(right):
                    continue
            pending.append(np.stack([np.full(len(right), w + i), right]))
            held += len(right)
            if held >= STEP:
                both = np.concatenate(pending, axis=1)
                for s in range(0, both.shape[1], STEP):
                    compare(both[0, s : s + STEP], both[1, s : s + STEP])
                pending, held = [], 0
    if pending:
        both = np.concatenate(pending, axis=1)
        compare(both[0], both[1])
    return back[label[place]]


def shingle_set(text: str, words_each: int) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted."""
    parts = list(shingle_hashes(text, words_each))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def set_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return float(not len(large))
    shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return shared / (len(a) + len(b) - shared)


def _similar(texts: np.ndarray, words_each: int, similarity: float) -> Callable[[int, int], bool]:
    """Whether the texts at two positions have the similarity; a text's shingles are made when first asked for."""
    sets: dict[int, np.ndarray] = {}

    def of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingle_set(texts[k], words_each)
        return sets[k]

    return lambda a, b: set_similarity(of(a), of(b)) >= similarity


def _linker(radius: int, words_each: int = 0, similarity: float = 0.0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """With words_each, rows have a text, and links are verified by the similarity of the texts' shingle sets."""
    names = ["major", "minor", "fp", "rep", *(["text"] if words_each else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket. Whole buckets are compared; the last one of a batch waits for the next."""
        held: list[np.ndarray] | None = None

        def column(values: pa.Array) -> np.ndarray:
            """Fingerprints as (n, lanes)."""
            if pa.types.is_integer(values.type):
                return values.to_numpy().view("<u8").reshape(-1, 1)
            return np.frombuffer(b"".join(values.to_pylist()), "<u8").reshape(len(values), -1)

        def work(columns: list[np.ndarray]) -> pa.RecordBatch:
            major, minor, fp, rep = columns[:4]
            new = np.flatnonzero(np.concatenate([[True], (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])]))
            sizes = np.diff(np.concatenate([new, [len(fp)]]))
            keep = np.repeat(sizes > 1, sizes)
            fp, rep, sizes = fp[keep], rep[keep], sizes[sizes > 1]
            same = _similar(columns[4][keep], words_each, similarity) if words_each else None
            root = bucket_links(fp, sizes, radius, same) if len(fp) else np.zeros(0, np.int64)
            linked = np.flatnonzero(root != np.arange(len(fp)))
            a, b = rep[linked], rep[root[linked]]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [column(batch[c]) if c == "fp" else batch[c].to_numpy(zero_copy_only=False) for c in names]
            now = now if held is None else [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [c[cut:].copy() for c in now]
            if cut:
                yield work([c[:cut] for c in now])
        if held is not None and len(held[0]):
            yield work(held)

    return run


def _blocks(bits: int, value: str, tag: str) -> F.Column:
    """The six keys that join two of the four blocks of `bits` bits each, as an array of longs."""
    mask = (1 << bits) - 1
    block = [F.shiftrightunsigned(F.col(value), bits * k).bitwiseAND(F.lit(mask)) for k in range(4)]
    pairs = [(a, b) for a in range(4) for b in range(a)]
    return F.array(*[F.lit(n << (2 * bits)) + F.shiftleft(block[a], bits) + block[b] for n, (a, b) in enumerate(pairs)]).alias(tag)


def links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """distinct (fp long, rep long), a written table -> links (u, v), u > v, that connect what the radius connects."""
    if radius > 2:
        raise ValueError("the blocks find every pair up to a radius of 2")
    keyed = distinct.select(F.explode(_blocks(16, "fp", "k")).alias("major"), "fp", "rep")
    counts = keyed.groupBy("major").agg(F.count("*").alias("n")).filter("n > 1")
    # Blocks of the other 32 bits, packed together, for buckets that are dealt again.
    pairs = [(a, b) for a in range(4) for b in range(a)]
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    rest = F.lit(0).cast("long")
    for n, (a, b) in enumerate(pairs):
        c, d = (x for x in range(4) if x not in (a, b))
        rest = F.when(F.shiftrightunsigned("major", 32) == n, F.shiftleft(block[d], 16) + block[c]).otherwise(rest)
    shared = keyed.join(counts, "major").withColumn("rest", rest)
    cold = shared.filter(F.col("n") <= bucket_rows).select("major", F.lit(-1).cast("long").alias("minor"), "fp", "rep")
    hot = shared.filter(F.col("n") > bucket_rows).select("major", F.explode(_blocks(8, "rest", "m")).alias("minor"), "fp", "rep")
    dealt = cold.unionByName(hot).repartition("major", "minor").sortWithinPartitions("major", "minor", "fp")
    return dealt.mapInArrow(_linker(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): the smallest node that each node reaches, by large-star and small-star rounds."""

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = materialize(edges.distinct(), "links")
    before = state(current)
    while before[0]:
        current = materialize(small_star(large_star(current)), "links")
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fp (signed long), component_id of every row."""
    prints = materialize(fingerprints(docs, id_col, text_col, words_each), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct-fingerprints")
    found = links(distinct.filter("rep is not null"), radius, bucket_rows)
    roots = components(found)
    named = materialize(distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "named")
    return join_hot_keys(prints, named, distinct.select("fp", "n"), "fp").select("doc_id", "fp", "component_id")


# Wide fingerprints, for similarities that 64 bits can't tell apart

LANES, MINIMA = 16, 6
#: Bits of 1024 that may differ in candidates: a Jaccard similarity of 0.8 is a cosine of 0.89, for which 155 bits are
#: expected to differ, give or take 11; for 0.7 it is 197.
WIDE_RADIUS = 200
#: Sets of few shingles differ in more bits at the same similarity: 4 of 5 shingles in 192, give or take 12.5. Texts of up to
#: SHORT shingles are compared among themselves at this radius as well.
SHORT_RADIUS, SHORT = 256, 80
#: Least share of common shingles, of all shingles of two texts, that makes a link.
SIMILARITY = 0.8
#: Bytes of text in a bucket before it is cut into parts.
BUCKET_BYTES = 64 << 20
#: Pairs and rows that are compared in a task, about, and the most tasks.
TASK_PAIRS, TASK_ROWS, MAX_TASKS = 10_000_000, 5_000, 100_000


def _mix(h: np.ndarray, lanes: int) -> np.ndarray:
    """An independent hash for each lane, from one hash: (n,) -> (n, lanes)."""
    x = h[:, None] + np.array([(0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF for k in range(lanes)], "<u8")
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(text: str, words_each: int = 5, lanes: int = LANES, minima: int = MINIMA) -> tuple[bytes, list[int]]:
    """64 * lanes majority bits of the distinct shingles of the whole text, and the smallest hash of them for each of several
    hash functions. How often a shingle occurs doesn't count."""
    return wide_fingerprint_of(shingle_set(text, words_each), lanes, minima)


def wide_fingerprint_of(shingles: np.ndarray, lanes: int = LANES, minima: int = MINIMA) -> tuple[bytes, list[int]]:
    ones, low = np.zeros(64 * lanes, np.int64), np.full(minima, 2**64 - 1, "<u8")
    for at in range(0, len(shingles), 255):  # so many bits are counted in bytes
        mixed = _mix(shingles[at : at + 255], max(lanes, minima))
        bits = np.unpackbits(np.ascontiguousarray(mixed[:, :lanes]).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
        low = np.minimum(low, mixed[:, :minima].min(axis=0))
    return np.packbits(ones * 2 > len(shingles), bitorder="little").tobytes(), low.view("<i8").tolist()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, radius: int = WIDE_RADIUS, bucket_rows: int = BUCKET_ROWS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, component_id of every row; links are pairs of texts whose sets of shingles have the similarity.

    Two of six smallest hashes name a bucket; texts of similarity 0.8 share one in 99.8 % of cases. In a bucket wide
    fingerprints are compared bit-sliced, and pairs within the radius (short texts: the larger of it and SHORT_RADIUS) are
    verified by their texts' shingle sets before they link. A bucket above bucket_rows or BUCKET_BYTES of text is cut into parts of about that size, and each two
    parts are compared in a task of their own, so its pairs are all compared as well.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words_each) for t in b["text"]]
            made = [wide_fingerprint_of(s) for s in sets]
            digests = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], digests, pa.array([f for f, _ in made], pa.binary()), pa.array([m for _, m in made], pa.list_(pa.int64())), pa.array([len(s) <= SHORT for s in sets]), b["bytes"]], names=["doc_id", "text_hash", "shingles", "fp", "low", "short", "bytes"])

    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    prints = texts.withColumn("bytes", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, text_hash long, shingles binary, fp binary, low array<long>, short boolean, bytes long")
    prints = materialize(prints, "wide-fingerprints")
    # Texts with the same set of shingles are one; the row with the smallest id stands for it.
    one = F.min_by(F.struct("text_hash", "fp", "low", "short", "bytes"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    distinct = prints.groupBy("shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), one.alias("x")).select("shingles", "rep", "n", "x.*")
    distinct = materialize(distinct, "distinct-fingerprints")
    pairs = [(a, b) for a in range(MINIMA) for b in range(a)]
    major = F.array(*[F.xxhash64(F.lit(n), F.col("low")[a], F.col("low")[b]) for n, (a, b) in enumerate(pairs)])
    # Fingerprints and texts are long: they join only what shares a bucket with another.
    keyed = distinct.filter("rep is not null").select(F.explode(major).alias("major"), "rep", "text_hash", "bytes")
    counts = materialize(keyed.groupBy("major").agg(F.count("*").alias("size"), F.sum("bytes").alias("total")).filter("size > 1"), "buckets")
    parts = F.least("size", F.greatest(F.ceil(F.col("size") / F.lit(bucket_rows)), F.ceil(F.col("total") / F.lit(BUCKET_BYTES)))).cast("long")
    shared = keyed.join(counts, "major").select("major", "rep", "text_hash", parts.alias("parts"), F.pmod(F.xxhash64("text_hash", "rep"), parts).alias("part"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: p != F.col("part"))
    two = F.transform(others, lambda p: F.least(p, F.col("part")) * F.col("parts") + F.greatest(p, F.col("part")))
    minor = F.when(F.col("parts") == 1, F.array(F.lit(-1).cast("long"))).otherwise(two)
    dealt = shared.select("major", F.explode(minor).alias("minor"), "rep", "text_hash").join(distinct.select("fp", "short", "rep", "text_hash"), ["rep", "text_hash"])
    held = texts.filter("doc_id is not null").withColumnRenamed("doc_id", "rep").groupBy("rep", "text_hash").agg(F.first("text").alias("text"))
    dealt = dealt.join(held, ["rep", "text_hash"])
    short = dealt.filter("short")

    # Comparing costs by pairs and not by bytes, so the number of tasks comes from the counts.
    copies = F.greatest(parts - 1, F.lit(1))
    compared, rows = counts.agg(F.sum(F.col("size") * F.col("size") / 2), F.sum(F.col("size") * copies)).first()
    tasks = int(min(MAX_TASKS, max(1, (compared or 0) // TASK_PAIRS, (rows or 0) // TASK_ROWS)))

    def found(rows: DataFrame, within: int) -> DataFrame:
        rows = rows.select("major", "minor", "fp", "rep", "text").repartition(tasks, "major", "minor").sortWithinPartitions("major", "minor", "fp")
        return rows.mapInArrow(_linker(within, words_each, similarity), "u long, v long")

    roots = components(found(dealt, radius).unionByName(found(short, max(radius, SHORT_RADIUS))))
    named = materialize(distinct.join(roots, distinct.rep == roots.node, "left").select("shingles", F.coalesce("root", "rep").alias("component_id")), "named")
    return join_hot_keys(prints.select("doc_id", "text_hash", "shingles"), named, distinct.select("shingles", "n"), "shingles").select("doc_id", "text_hash", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
