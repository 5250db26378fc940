"""Exact dedup through a minimal perfect hash over known distinct digests.

The history is a table (digest, winner, group_size); digests that come several times are added up first (smallest winner,
sum of the sizes), and rows without a 32-byte digest are left out. It is split into shards of bounded size; each shard becomes one
row that holds a minimal perfect hash whose slots carry the full digest, the winner's id and the group's size. Rows look
their digest up in the shard's index and compare all 32 bytes, so a digest that isn't in the history is never taken
for one that is. Rows without a match are grouped among themselves: of their digests only those that repeat get an index.

Shards hold SHARD_DIGESTS digests each, up to MAX_SHARDS shards (16 billion digests); with more they grow in proportion.

Defined cases: a null text counts as empty. A null id never wins against another id; if all ids of a group are null,
the winner is null. Rows that repeat both id and text are one document: one of them is kept, the rest are not.
Other columns of the input are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, text_or_empty

#: Distinct digests in a shard (48 bytes each) and rows that look up one copy of a shard.
SHARD_DIGESTS, SHARD_ROWS = 250_000, 500_000
#: Bound on the number of shards, and so on the broadcast table of salts (12 bytes a shard).
MAX_SHARDS = 65_536
#: Runs of white space. A single blank is its own replacement, so only other runs are matched.
BLANK_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
LEVELS, GAMMA = 40, 2.0


def normalized(text: Column) -> Column:
    """Each run of ASCII white space becomes one blank."""
    return F.regexp_replace(text, BLANK_RUN, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest and a number of the row, which is fixed once this is written."""
    digest = F.unhex(F.sha2(normalized(text_or_empty(text_col)), 256))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest")).withColumn("row", F.monotonically_increasing_id())


# The hash itself: levels of bit arrays, as in BBHash. A key is placed in the first level where no other key has its bit.


def _words(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.ascontiguousarray(digest).view("<u8").reshape(-1, 4)
    return w[:, 0], w[:, 1] | np.uint64(1)


def _positions(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    x = a + b * np.uint64(level)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class MinimalPerfectHash:
    """Maps n distinct 32-byte digests onto 0..n-1; other digests to any slot or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.late = {bytes(d): int(self.ranks[-1]) + i for i, d in enumerate(rest)}

    @classmethod
    def build(cls, digest: np.ndarray) -> "MinimalPerfectHash":
        sizes, levels, left = [], [], np.arange(len(digest))
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            at = _positions(*_words(digest[left]), level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), bits, digest[left])

    def slots(self, digest: np.ndarray) -> np.ndarray:
        out = np.full(len(digest), -1, np.int64)
        left = np.arange(len(digest))
        a, b = _words(digest)
        for level, size in enumerate(self.sizes):
            if not len(left):
                return out
            at = self.starts[level] + _positions(a[left], b[left], level, int(size))
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        if self.late:
            for i in left:
                out[i] = self.late.get(bytes(digest[i]), -1)
        return out


def _fixed(column: pa.Array) -> np.ndarray:
    """A column of 32-byte values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def pack_shard(digest: np.ndarray, winner: np.ndarray, known: np.ndarray, size: np.ndarray, row: np.ndarray) -> bytes:
    """The hash of distinct digests, and what their slots hold: digest, winner's id (unless it is null), group size, winner's row."""
    mph = MinimalPerfectHash.build(digest)
    order = np.empty(len(digest), np.int64)
    order[mph.slots(digest)] = np.arange(len(digest))
    out = io.BytesIO()
    np.savez(out, sizes=mph.sizes, bits=np.packbits(mph.bits), n_bits=len(mph.bits), rest=mph.rest, digest=digest[order], winner=winner[order], known=known[order], size=size[order], row=row[order])
    return out.getvalue()


class Shard:
    def __init__(self, blob: bytes):
        z = np.load(io.BytesIO(blob))
        self.mph = MinimalPerfectHash(z["sizes"], np.unpackbits(z["bits"], count=int(z["n_bits"])).astype(bool), z["rest"])
        self.digest, self.winner, self.known, self.size, self.row = (z[k] for k in ("digest", "winner", "known", "size", "row"))

    def lookup(self, digest: np.ndarray) -> np.ndarray:
        """Slot of each digest after comparing all its bytes, or -1."""
        slot = self.mph.slots(digest)
        found = np.flatnonzero(slot >= 0)
        same = (self.digest[slot[found]] == digest[found]).all(axis=1)
        slot[found[~same]] = -1
        return slot


def _build(group: pa.Table) -> pa.Table:
    winner = group["winner"].combine_chunks()
    blob = pack_shard(_fixed(group["digest"]), winner.fill_null(0).to_numpy(zero_copy_only=False), winner.is_valid().to_numpy(zero_copy_only=False), group["group_size"].to_numpy(), group["row"].to_numpy())
    return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard and salt, the index before the rows that look it up."""
    shard, owner = None, None
    for batch in batches:
        index_rows = np.flatnonzero(batch["blob"].is_valid().to_numpy(zero_copy_only=False))
        starts = [0, *(int(i) for i in index_rows)]
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            part = batch.slice(start, end - start)
            if part.num_rows and part["blob"][0].is_valid:
                shard, owner = Shard(part["blob"][0].as_py()), part["shard"][0].as_py()
                part = part.slice(1)
            if not part.num_rows:
                continue
            n = part.num_rows
            digest = _fixed(part["digest"])
            slot = np.full(n, -1, np.int64)
            mine = part["shard"].to_numpy() == owner
            if shard is not None and mine.any():
                slot[mine] = shard.lookup(digest[mine])
            member, wins = slot >= 0, np.zeros(n, bool)
            winner, known, size = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
            if member.any():
                s = slot[member]
                winner[member], known[member], size[member] = shard.winner[s], shard.known[s], shard.size[s]
                wins[member] = shard.row[s] == part["row"].to_numpy()[member]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["digest"], part["row"], pa.array(member), pa.array(winner, pa.int64(), mask=~known), pa.array(size, pa.int64(), mask=~member), pa.array(wins)], names=["doc_id", "digest", "row", "member", "winner", "group_size", "wins"])


def lookup(rows: DataFrame, history: DataFrame) -> DataFrame:
    """rows (doc_id, digest, row) against history (distinct digest, winner, group_size, row of the winner), both written tables.

    A shard that many rows ask for is copied, and its rows are dealt over the copies by their numbers, so a digest or an id
    that a third of all rows share doesn't land in one task.
    """
    spark = rows.sparkSession
    shards = max(1, min(MAX_SHARDS, -(-history.count() // SHARD_DIGESTS)))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    asked = {r["shard"]: r["n"] for r in rows.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}
    salts = spark.createDataFrame([(s, -(-asked.get(s, 0) // SHARD_ROWS) or 1) for s in range(shards)], "shard int, salts int")
    index = history.withColumn("shard", shard).groupBy("shard").applyInArrow(_build, "shard int, blob binary")
    copies = index.join(F.broadcast(salts), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("row"), "blob")
    asking = rows.withColumn("shard", shard).join(F.broadcast(salts), "shard").select("shard", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "digest", "row", F.lit(None).cast("binary").alias("blob"))
    dealt = copies.unionByName(asking).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return dealt.mapInArrow(_probe, "doc_id long, digest binary, row long, member boolean, winner long, group_size long, wins boolean")


def grouped(rows: DataFrame) -> DataFrame:
    """Winner, its row and size of each distinct digest; counted before the shuffle, so hot digests cost one row a task."""
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("group_size"), first.alias("row"))


def distinct_history(history: DataFrame) -> DataFrame:
    known = history.select(F.col("digest").cast("binary").alias("digest"), F.col("winner").cast("long").alias("winner"), F.coalesce(F.col("group_size").cast("long"), F.lit(1)).alias("group_size"))
    return known.filter(F.octet_length("digest") == 32).groupBy("digest").agg(F.min("winner").alias("winner"), F.sum("group_size").alias("group_size"), F.lit(-1).cast("long").alias("row"))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, seen_before.

    history (digest binary, winner long, group_size long): digests of earlier corpora. A document found there is a
    repeat: keep_id is the historical winner and it isn't kept. The others are grouped by their own digests.
    """
    rows = materialize(digests(docs, id_col, text_col), "digests")
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    repeats = None
    if history is not None:
        found = materialize(lookup(rows, materialize(distinct_history(history), "history")), "history-hits")
        repeats = found.filter("member").select("doc_id", F.col("winner").alias("keep_id"), "group_size", F.lit(False).alias("kept"), sha, F.lit(True).alias("seen_before"))
        rows = found.filter("not member").select("doc_id", "digest", "row")
    repeating = materialize(grouped(rows).filter("group_size > 1"), "repeating")
    found = lookup(rows, repeating)
    out = found.select(
        "doc_id",
        F.when(F.col("member"), F.col("winner")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~F.col("member") | F.col("wins")).alias("kept"),
        sha,
        F.lit(False).alias("seen_before"),
    )
    return out if repeats is None else out.unionByName(repeats)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents")).drop("seen_before")


ORACLE = """
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
