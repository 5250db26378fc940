"""Packing of token sequences by linear grouping and best fit.

Texts become token ids, an end id is added, and what is longer than a sequence is cut into whole sequences with the rest
as the first piece. Packing itself only needs how many pieces of each length there are: at most `capacity` counts, so the
plan is made on the driver from a histogram, whatever the corpus's size, and consists of runs of like sequences.

Plan: lengths above a part of the capacity are large (of the parts in SMALL_PARTS the one that needs the fewest
sequences, each tried on the histogram). They are split into groups of equal cardinality and rounded up to
their group's largest. For these few sizes the best mix of configurations (multisets that fit a sequence) is found by
linear programming with column generation; whole multiples are kept. Then each configuration's slots take actual
lengths of its groups, largest first, which frees what rounding had added. Large pieces that are left and all small ones
go, largest first, to the fullest sequence that still has room, or else to a new one.

Rows get their rank among pieces of their length from counts of hashed bins, and the plan maps (length, rank) onto
sequence and offset. The ids themselves are never shuffled.

Defined cases: a null text counts as empty and gives a piece that holds the end id alone. Null and repeated ids are
packed like others. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import logging
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import materialize, table, text_batches, text_or_empty

CAPACITY, END_ID = 2048, 0
GROUPS, SMALL_PARTS, PIVOTS = 32, (4, 3, 2), 1500
#: Rows whose ranks are counted together.
BIN_ROWS = 10_000
#: Characters of a text that are encoded at once; longer ones are cut where tokens never join.
PORTION = 1 << 20
CUT = re.compile(r"(?<=\S)(?=\s\S)")


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """The ids of a text by the vocabulary (a tokenizers file). Its byte-level ranks drive tiktoken, which gives the same
    ids in less time; texts that hold an added token go to tokenizers itself."""
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary)
    added = re.compile("|".join(re.escape(t.content) for t in reference.get_added_tokens_decoder().values()) or r"(?!)")
    with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if added.search(text):
            return reference.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + PORTION) if len(text) - at > PORTION else None
            end = cut.start() if cut else len(text)
            ids += fast.encode_ordinary(text[at:end])
            at = end
        return ids

    return encode


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            row, piece, start, length, crc = (array("q") for _ in range(5))
            for i, text in enumerate(b["text"]):
                ids = array("I", encode(text.as_py()))
                ids.append(END_ID)
                view, at, n = memoryview(np.frombuffer(ids, np.uint32).astype("<u4")), 0, 0
                while at < len(ids):
                    size = capacity if at else len(ids) % capacity or capacity
                    for column, value in zip((row, piece, start, length, crc), (i, n, at, size, zlib.crc32(view[at : at + size])), strict=True):
                        column.append(value)
                    at, n = at + size, n + 1
            ids_of = b["doc_id"].take(pa.array(np.frombuffer(row, np.int64)))
            made = [pa.array(np.frombuffer(x, np.int64)) for x in (piece, start, length, crc)]
            yield pa.RecordBatch.from_arrays([ids_of, made[0].cast(pa.int32()), *made[1:]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits and is worth most, by dynamic programming over the room."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, w = sizes[order], worth[order]
    for room in range(int(s[0]), capacity + 1):
        n = int(np.searchsorted(s, room, "right"))
        gain = best[room - s[:n]] + w[:n]
        k = int(gain.argmax())
        best[room], choice[room] = (gain[k], k) if gain[k] > best[room - 1] else (best[room - 1], -1)
    taken, room = np.zeros(len(sizes)), capacity
    while room >= s[0]:
        if choice[room] < 0:
            room -= 1
        else:
            taken[order[choice[room]]] += 1
            room -= int(s[choice[room]])
    return float(best[capacity]), taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """How often to use which configuration: the linear optimum over all of them, rounded down."""
    k = len(sizes)
    basis, cost = np.diag(np.floor(capacity / sizes)), np.ones(k)
    for _ in range(PIVOTS):
        amount = np.linalg.solve(basis, demand.astype(float))
        price = np.linalg.solve(basis.T, cost)
        if (low := int(price.argmin())) is not None and price[low] < -1e-9:  # more than is asked for costs nothing
            column, its_cost = -np.eye(k)[low], 0.0
        else:
            value, column = best_configuration(sizes, np.maximum(price, 0), capacity)
            its_cost = 1.0
            if value <= 1 + 1e-7:
                break
        change = np.linalg.solve(basis, column)
        can = change > 1e-9
        if not can.any():
            break
        ratio = np.where(can, np.maximum(amount, 0) / np.where(can, change, 1), np.inf)
        leaving = int(ratio.argmin())
        basis[:, leaving], cost[leaving] = column, its_cost
    else:
        logging.getLogger(__name__).warning("column generation stopped after %d pivots, perhaps before the optimum", PIVOTS)
    amount = np.linalg.solve(basis, demand.astype(float))
    return [(int(a + 1e-9), basis[:, j]) for j, a in enumerate(amount) if cost[j] and a >= 1 - 1e-9]


class Plan:
    """Runs of like sequences. entries: (length, first rank, count, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_part: int = SMALL_PARTS[0]):
        self.capacity, self.left = capacity, {n: c for n, c in sorted(histogram.items(), reverse=True) if c > 0}
        self.next_rank: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, list[tuple[int, int]]]] = []  # (sequences, [(length, first rank)])
        self.room: dict[int, list[int]] = defaultdict(list)  # room left -> runs
        self._large([n for n in self.left if n > capacity // small_part], groups)
        for n in list(self.left):
            self._best_fit(n)

    def _take(self, length: int, count: int) -> int:
        rank = self.next_rank[length]
        self.next_rank[length] += count
        self.left[length] -= count
        return rank

    def _add(self, count: int, content: list[tuple[int, int]]) -> None:
        self.runs.append((count, content))
        room = self.capacity - sum(n for n, _ in content)
        bisect.insort(self.room[room], len(self.runs) - 1)

    def _large(self, lengths: list[int], groups: int) -> None:
        total = sum(self.left[n] for n in lengths)
        if not total:
            return
        # Groups of equal cardinality, from the longest down. A length is never split between groups.
        wanted = max(1, min(groups, len(lengths), total // 20))
        members: list[list[int]] = [[]]
        held = 0
        for n in lengths:
            if members[-1] and held >= len(members) * total / wanted:
                members.append([])
            members[-1].append(n)
            held += self.left[n]
        sizes, demand = np.array([m[0] for m in members]), np.array([sum(self.left[n] for n in m) for m in members])
        for times, config in configurations(sizes, demand, self.capacity):
            slots = [g for g, c in enumerate(config) for _ in range(int(round(c)))]
            while times and slots:
                heads = []
                for g in slots:
                    heads.append(next((n for n in members[g] if self.left[n]), None))
                used = {n: heads.count(n) for n in heads if n is not None}
                if None in heads or not used:
                    break
                step = min(times, *(self.left[n] // c for n, c in used.items()))
                if step:
                    self._add(step, [(n, self._take(n, step)) for n in heads])
                else:  # the last ones of a length: this sequence takes the next length as well
                    content = []
                    for g in slots:
                        n = next((x for x in members[g] if self.left[x]), None)
                        if n is not None:
                            content.append((n, self._take(n, 1)))
                    self._add(1, content)
                    step = 1
                times -= step

    def _best_fit(self, n: int) -> None:
        rooms = sorted(r for r, runs in self.room.items() if runs and r >= n)
        while self.left[n]:
            while rooms and not self.room[rooms[0]]:
                rooms.pop(0)
            if rooms:
                room = rooms[0]
                index = self.room[room].pop()
                count, content = self.runs[index]
            else:
                room, index, content = self.capacity, None, []
                count = -(-self.left[n] // (room // n))
            each = min(room // n, self.left[n])
            step = min(count, self.left[n] // each)
            added = [(n, self._take(n, step)) for _ in range(each)]
            if index is None:
                self._add(step, added)
            elif step == count:
                self.runs[index] = (count, content + added)
                bisect.insort(self.room[room - each * n], index)
            else:  # part of the run gets the pieces, the rest stays as it was
                self.runs[index] = (count - step, [(m, rank + step) for m, rank in content])
                bisect.insort(self.room[room], index)
                self._add(step, content + added)

    @property
    def sequences(self) -> int:
        return sum(count for count, _ in self.runs)

    def entries(self) -> np.ndarray:
        rows, sequence = [], 0
        for count, content in self.runs:
            offset = 0
            for n, rank in content:
                rows.append((n, rank, count, sequence, offset))
                offset += n
            sequence += count
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences; no plan needs fewer than all tokens fill."""
    least, best = -(-sum(n * c for n, c in histogram.items()) // capacity), None
    for part in SMALL_PARTS:
        plan = Plan(histogram, capacity, small_part=part)
        best = plan if best is None or plan.sequences < best.sequences else best
        if best.sequences == least:
            break
    return best


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """Adds rank (from 0) among the rows of each length, written rows with a column deal; a common length is counted in many
    bins, and where a row was written decides its bin, so null and repeated ids are dealt as well."""
    bins = max(1, total // BIN_ROWS)
    binned = rows.withColumn("bin", F.pmod(F.col("deal"), F.lit(bins)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = binned.groupBy("length", "bin").agg(F.count("*").alias("n")).select("length", "bin", F.coalesce(before, F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("length", "bin").orderBy("doc_id", "piece", "ids_crc32", "deal"))
    return binned.withColumn("inside", inside).join(starts, ["length", "bin"]).withColumn("rank", (F.col("first") + F.col("inside") - 1).cast("long")).drop("bin", "inside", "first", "deal")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = materialize(pieces(docs, vocabulary, capacity, id_col, text_col).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_plan(histogram, capacity).entries()
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(plan)  # its size depends on the capacity, not on the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = shipped.value
        keys = (entry[:, 0] << 44) + entry[:, 1] if len(entry) else np.zeros(0, np.int64)
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            sequence, offset = entry[at, 3] + rank - entry[at, 1], entry[at, 4]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(rows, sum(histogram.values())).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
