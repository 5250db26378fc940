"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (character classes, words, lines, repetition) are numbers that know neither language nor
source. Trees grow on binned statistics of a bounded sample of labelled rows, SAMPLE_ROWS at most, taken in the order of
a hash of the id. The fitted trees are flattened into arrays, and a batch walks all trees at once, a level a step.

Defined cases: a null text counts as empty and is scored from its statistics. A null id counts as held out and is never
learned from. If labels of one id differ, the smallest counts; null labels are ignored. Without labels of both kinds
every score is the share of label 1, or 0.5 without labels. Repeated rows get equal scores; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import table, text_batches, text_or_empty

#: Labelled rows that are learned from at most.
SAMPLE_ROWS = 10_000
FOLDS, THRESHOLD = 5, 0.3
TREES, DEPTH, RATE, BINS, L2, LEAST_HESSIAN = 80, 4, 0.15, 64, 1.0, 1.0
#: Bytes of a text that are looked at in one step.
WINDOW = 1 << 22

_CLASSES = {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "blank": b" \t\x0b\x0c\r",
    "newline": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "exclaim": b"!",
    "pipe": b"|",
    "symbol": b"#$%&*+<=>@^~_\\/`",
    "bracket": b"()[]{}\"'",
    "dash": b"-",
    "control": bytes([*range(9), *range(14, 32), 127]),
    "high": bytes(range(128, 256)),
}
CLASS_OF = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    CLASS_OF[list(_members), _k] = 1
STATISTICS = [
    "log_bytes", *(f"share_{name}" for name in _CLASSES), "entropy", "log_words", "mean_word", "spread_word", "longest_word",
    "distinct_words", "shouted_words", "capital_words", "odd_ends", "plain_words", "digit_words", "log_lines", "mean_line", "distinct_lines", "ended_lines", "blank_lines",
]


def statistics(text: str) -> list[float]:
    """The numbers in STATISTICS for one text."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    counts = np.zeros(256)
    for at in range(0, n, WINDOW):
        counts += np.bincount(np.frombuffer(data, np.uint8, min(WINDOW, n - at), at), minlength=256)
    p = counts[counts > 0] / max(n, 1)
    words, lines = text.split(), text.split("\n")
    w, ln = max(len(words), 1), len(lines)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    distinct = set(words)
    # Shares over distinct words cost less and say the same as over all.
    d = max(len(distinct), 1)
    ends = sum(not (x[-1].isalnum() or x[-1] in ".,;:!?)\"'") for x in distinct)
    return [
        np.log1p(n), *(counts @ CLASS_OF / max(n, 1)), float(-(p * np.log2(p)).sum()), np.log1p(len(words)), float(sizes.mean()), float(sizes.std()), float(sizes.max()),
        len(distinct) / w, sum(map(str.isupper, distinct)) / d, sum(map(str.istitle, distinct)) / d, ends / d, sum(map(str.isalpha, distinct)) / d, sum(any(c.isdigit() for c in x) for x in distinct if not x.isalpha()) / d,
        np.log(ln), len(text) / ln, len(set(lines)) / ln, sum(x.rstrip()[-1:] in (".", "!", "?", ":") for x in lines if x) / ln, sum(not x for x in lines) / ln,
    ]


class Forest(NamedTuple):
    """Trees in flat arrays: node i asks for column[i] <= edge[i] and goes to left[i] or left[i] + 1; leaves point at themselves."""

    roots: np.ndarray
    column: np.ndarray
    edge: np.ndarray
    left: np.ndarray
    value: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if len(self.roots) and len(x):
            at = np.tile(self.roots, (len(x), 1))
            row = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                inner = self.left[at] != at
                at = np.where(inner, self.left[at] + (x[row, self.column[at]] > self.edge[at]), at)
            total = total + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for log loss on histograms of at most BINS bins a column."""
    empty = np.zeros(0)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Forest(empty.astype(int), empty.astype(int), empty, empty.astype(int), empty, float(odds))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m) * BINS
    start = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(n, start)
    roots, column, edge, left, value = [], [], [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        roots.append(len(column))

        def leaf(rows: np.ndarray) -> int:
            column.append(0)
            edge.append(0.0)
            left.append(len(left))
            value.append(float(-RATE * g[rows].sum() / (h[rows].sum() + L2)))  # noqa: B023
            return len(column) - 1

        level = [(leaf(np.arange(n)), np.arange(n))]
        for _ in range(DEPTH):
            following = []
            for node, rows in level:
                f = flat[rows].ravel()
                hist_g = np.bincount(f, np.repeat(g[rows], m), m * BINS).reshape(m, BINS).cumsum(axis=1)
                hist_h = np.bincount(f, np.repeat(h[rows], m), m * BINS).reshape(m, BINS).cumsum(axis=1)
                all_g, all_h = hist_g[0, -1], hist_h[0, -1]
                rest_g, rest_h = all_g - hist_g, all_h - hist_h
                gain = hist_g**2 / (hist_h + L2) + rest_g**2 / (rest_h + L2) - all_g**2 / (all_h + L2)
                gain[(hist_h < LEAST_HESSIAN) | (rest_h < LEAST_HESSIAN)] = 0
                j, b = divmod(int(gain.argmax()), BINS)
                if gain[j, b] <= 1e-9 or b >= len(edges[j]):
                    continue
                low = binned[rows, j] <= b
                column[node], edge[node] = j, float(edges[j][b])
                left[node] = leaf(rows[low])
                leaf(rows[~low])
                following += [(left[node], rows[low]), (left[node] + 1, rows[~low])]
            level = following
        done = Forest(np.array(roots[-1:]), np.array(column), np.array(edge), np.array(left), np.array(value), 0.0)
        at = np.full(n, roots[-1])
        for _ in range(DEPTH):
            at = np.where(done.left[at] != at, done.left[at] + (x[np.arange(n), done.column[at]] > done.edge[at]), at)
        total = total + done.value[at]
    return Forest(np.array(roots), np.array(column), np.array(edge), np.array(left), np.array(value), start)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _statistics_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], float).reshape(-1, len(STATISTICS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on labelled rows outside the held-out fold; only their statistics and labels reach the driver."""
    text_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("double").alias("y"))
    sample = known.filter(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], b["y"], pa.array(list(_statistics_of(b["text"])), pa.list_(pa.float64()))], names=["id", "y", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    found = texts.join(F.broadcast(sample), "id").select("id", "y", "text").mapInArrow(run, "id long, y double, x array<double>")
    # An id that comes several times counts once, with the smallest statistics; at most sample_rows rows reach the driver.
    rows = sorted(found.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect(), key=lambda r: r["id"])
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in rows]))


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = forest.scores(_statistics_of(b["text"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_rows(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least the threshold, with all their columns."""
    text_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = forest.scores(_statistics_of(b.column(at).cast(pa.string()).fill_null("")))
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
