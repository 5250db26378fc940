"""Minimax contiguous sharding of atomic groups, on DataFrame functions alone.

Groups are equal texts. Their order: first the groups that fill a shard alone (at least the average of what is left for the
other shards), then all others by a 64-bit hash of the text. The former get a shard each. For the others the smallest
capacity with which a greedy walk needs no more than the shards that are left is found by binary search. Cuts are then made
under that capacity, each where a group ends nearest to an even share, so that the smallest shard is large as well: no
shard of these is further from the even share than the largest of their groups.

The driver never sees the groups: it holds sums over ranges of the hash. A walk that ends inside a range gives an upper and
a lower bound instead of an answer; where the bounds differ, or a cut falls inside a range, the ranges in doubt are split
further. Each round fetches at most RANGE_LIMIT * 2**STEP_BITS sums, whatever the input's size.

Defined cases: null and empty text are one group. Ties of the hash share a group. Null and repeated ids are placed like
others. With fewer groups than shards the last shards stay empty. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import materialize, table, text_or_empty

FIRST_BITS, STEP_BITS, RANGE_LIMIT = 14, 6, 2048
#: Rows that are numbered in one task.
SLOT_ROWS = 20_000


class Ranges:
    """Ordered ranges of the hash, as (first key, bits of its prefix, bytes, groups)."""

    def __init__(self, rows: list[tuple[int, int, int, int]], largest: int):
        self.rows, self.largest = sorted(rows), largest
        self.sums = [0]
        for r in self.rows:
            self.sums.append(self.sums[-1] + r[2])

    @property
    def total(self) -> int:
        return self.sums[-1]

    def walk(self, capacity: int, shards: int, hopeful: bool) -> tuple[list[int], bool, set[int]]:
        """Ends of the shards, whether all fits, and the undecided ranges that were met.

        hopeful: a shard may end anywhere inside an undecided range (no true walk gets further); else it ends before it.
        """
        at, ends, met = 0, [], set()
        for _ in range(shards):
            if at >= self.total:
                break
            target = at + capacity
            if target >= self.total:
                at = self.total
                ends.append(at)
                break
            j = bisect_right(self.sums, target) - 1
            reached = self.sums[j]
            if reached != target and self.rows[j][3] > 1:
                met.add(j)
                reached = target if hopeful else reached
            if reached <= at:
                return ends, False, met
            at = reached
            ends.append(at)
        return ends, at >= self.total, met

    def bounds(self, shards: int) -> tuple[int, int]:
        """(largest capacity that can't do, smallest that surely does)."""

        def least(hopeful: bool) -> int:
            low, high = max(self.largest, -(-self.total // shards)) - 1, self.total
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if self.walk(mid, shards, hopeful)[1] else (mid, high)
            return high

        return least(True) - 1, least(False)

    def cuts(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """Ends of all shards but the last under a capacity that can do, and the undecided ranges that were met: while there
        are any, the ends are not final."""
        sums, total, met = self.sums, self.total, set()

        def open_at(x: int) -> bool:
            """Whether x falls inside an undecided range."""
            j = bisect_right(sums, x) - 1
            if j >= len(self.rows) or sums[j] == x or self.rows[j][3] == 1:
                return False
            met.add(j)
            return True

        # The last places at which the rest still fits: a greedy walk from the end.
        least, at = [total], total
        for _ in range(shards - 1):
            at = max(0, at - capacity)
            open_at(at)
            at = sums[bisect_left(sums, at)]
            least.append(at)
        ends, at = [], 0
        for k in range(1, shards):
            even, most = total * k / shards, at + capacity
            open_at(int(even))
            j = bisect_right(sums, even)
            end = min((sums[i] for i in (j - 1, j) if i < len(sums)), key=lambda x: abs(x - even))
            end = max(end, least[shards - k], at)
            if end > most:
                open_at(most)
                end = sums[bisect_right(sums, most) - 1]
            at = max(end, at)
            ends.append(at)
        return ends, met

    def doubtful(self, low: int, high: int, shards: int) -> set[int]:
        """Undecided ranges that a walk with a capacity in (low, high] may end in: all of them, or the ones met if they are many."""
        near, _, met = self.walk(low + 1, shards, False)
        far, _, more = self.walk(high, shards, True)
        spans = {j for a, b in zip(near, far, strict=False) for j in range(bisect_right(self.sums, min(a, b)) - 1, min(len(self.rows), bisect_right(self.sums, max(a, b))))}
        wide = {j for j in spans | met | more if self.rows[j][3] > 1}
        if len(wide) <= RANGE_LIMIT:
            return wide
        out = met | more
        for c in (low + 1, (low + high) // 2, high):
            out |= self.walk(c, shards, True)[2] | self.walk(c, shards, False)[2]
        return out


def _prefix(bits: int) -> Column:
    return F.shiftright("key", 64 - bits)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int], list[int]]:
    """groups (key long, bytes long, rows long), a written table -> (capacity of the walk, keys of the groups that have a
    shard of their own, first keys of the shards after the first of the others; a key may repeat where shards are empty)."""
    sums = [F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("m")]
    total, alone, left = groups.agg(F.sum("bytes")).first()[0] or 0, [], shards
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards - 1).collect():
        if left > 1 and r["bytes"] * left >= total:
            alone.append(r["key"])
            total, left = total - r["bytes"], left - 1
        else:
            break
    rest = groups.filter(~F.col("key").isin(alone)) if alone else groups
    got = rest.groupBy(_prefix(FIRST_BITS).alias("p")).agg(*sums).collect()
    if not got:
        return 0, sorted(alone), []
    ranges = Ranges([(r["p"] << (64 - FIRST_BITS), FIRST_BITS, r["b"], r["n"]) for r in got], max(r["m"] for r in got))
    while True:
        low, high = ranges.bounds(left)
        doubt = ranges.doubtful(low, high, left) if high - low > 1 else set()
        if not doubt:
            ends, doubt = ranges.cuts(high, left)
        if not doubt:
            break
        rows = [r for j, r in enumerate(ranges.rows) if j not in doubt]
        by_bits: dict[int, list[int]] = {}
        for j in doubt:
            by_bits.setdefault(ranges.rows[j][1], []).append(ranges.rows[j][0])
        for bits, keys in by_bits.items():
            finer = min(64, bits + STEP_BITS)
            wanted = groups.sparkSession.createDataFrame([(k >> (64 - bits),) for k in keys], "p long")
            part = rest.withColumn("p", _prefix(bits)).join(F.broadcast(wanted), "p", "left_semi").groupBy(_prefix(finer).alias("p")).agg(*sums)
            rows += [(r["p"] << (64 - finer), finer, r["b"], 1 if finer == 64 else r["n"]) for r in part.collect()]
        ranges = Ranges(rows, ranges.largest)
    first_of = {s: r[0] for s, r in zip(ranges.sums, ranges.rows, strict=False)}
    return high, sorted(alone), [first_of[e] for e in ends if e < ranges.total]


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; equal texts share a shard, slots are gapless in each."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    # Where a row was read decides its bin, so rows that repeat both id and text are dealt as well. Written, it stays.
    rows = materialize(rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "shard-rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    _, alone, cuts = minimax_cuts(groups, shards)
    number = F.lit(len(alone))
    for cut in cuts:
        number = number + (F.col("key") >= F.lit(cut)).cast("int")
    for k, key in enumerate(alone):
        number = F.when(F.col("key") == F.lit(key), k).otherwise(number)
    placed = rows.withColumn("shard", number)
    # Slots: rows are dealt into bins, the bins of a shard are laid end to end, and rows are numbered inside their bin.
    bins = max(1, rows.count() // SLOT_ROWS)
    placed = placed.withColumn("bin", F.pmod(F.col("deal"), F.lit(bins)))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("shard", "bin").agg(F.count("*").alias("n")).select("shard", "bin", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "key", "deal"))
    numbered = placed.withColumn("inside", inside).join(starts, ["shard", "bin"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside") - 1).cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
