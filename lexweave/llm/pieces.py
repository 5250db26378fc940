"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read directly. A text gets its dummy prefix, and is split where no piece reaches across: before runs
of blanks and at characters that no piece joins. Distinct words are encoded together as one flat symbol array. In a
round every word finds the smallest rank among its pairs and merges all its pairs of that rank, leftmost first; then the
array is compacted and only pairs next to a merge get new ranks, until no pair is left. The reference order merges one
pair at a time. Both agree unless a merge makes a pair with a smaller rank than its own; such merges are found when the
model is read, and a word does only the leftmost of them in a round. Blank runs, whose pieces share one score, are cut as
that order does it, from the left.

Words above LONG_WORD symbols (text without blanks) don't wait for their smallest rank: a pair is merged as soon as its rank
is the smallest within as many symbols on either side as the longest piece has characters. No merge beyond them can reach the
pair before, as the symbol that it would have to make is longer than any piece. Of equal ranks those are merged together
that come after no merge within this window that makes a pair of a smaller or equal rank.

Words are cached per worker up to CACHE_WORDS. Texts are handled in portions of PORTION characters.

Defined cases: a null text counts as empty and has no ids. Characters outside the model become their bytes. U+2581 is
the model's blank and decodes to a blank. Repeated rows give repeated results; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import table, text_batches, text_or_empty

BLANK = "▁"
CACHE_WORDS, CACHED_LENGTH, PORTION = 200_000, 64, 1 << 20
LONG_WORD = 128
NONE = np.int32(2**31 - 1)
#: Symbols from here on are characters outside the model.
FOREIGN = 1 << 20
#: Symbols are smaller than 2**SHIFT; the last of them stands between words and makes no piece.
SHIFT = 22
BARRIER = (1 << SHIFT) - 1


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """A BPE model with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        kinds, scores = [], []
        for field, value in _fields(data):
            if field == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry.get(1, b"").decode())
                scores.append(struct.unpack("<f", entry.get(2, bytes(4)))[0])
                kinds.append(entry.get(3, 1))
        normal = [i for i, k in enumerate(kinds) if k == 1]
        ids = {self.pieces[i]: i for i in normal}
        self.bytes_ids = [next((i for i, p in enumerate(self.pieces) if kinds[i] == 6 and p == f"<0x{b:02X}>"), 0) for b in range(256)]
        # What an id decodes to; control pieces to nothing.
        self.surface = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace(BLANK, " ").encode() if k == 1 else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        self.text_of = [str(i).encode() for i in range(len(self.pieces))]
        inner = {c for i in normal if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        self.symbol = np.arange(0x110000, dtype=np.int64) + FOREIGN
        for i in normal:
            if len(self.pieces[i]) == 1:
                self.symbol[ord(self.pieces[i])] = i
        self.blank = ids.get(BLANK, FOREIGN + ord(BLANK))
        # Blank runs: pieces of 2, 3, ... blanks that share the worst score.
        runs = {len(p): i for p, i in ids.items() if len(p) > 1 and not p.strip(BLANK)}
        worst = min((scores[i] for i in runs.values()), default=None)
        self.most = max(runs, default=1)
        self.cut = {n: self._cut_run(n, set(runs)) for n in range(1, self.most + 1)}
        if runs and (self.cut[self.most] != [self.most] or any(scores[i] != worst for i in runs.values()) or any(scores[i] <= worst for i in normal if i not in runs.values() and len(self.pieces[i]) > 1)):
            raise ValueError("unsupported model: pieces of blank runs must share the lowest score and the longest must be reachable")
        self.runs = {1: self.blank} | runs
        if any(BLANK in p.lstrip(BLANK) or p.startswith(BLANK * 2) and p.strip(BLANK) for p in ids):
            raise ValueError("unsupported model: pieces reach across words")
        # Every way to make a piece of two symbols, with the piece's rank.
        symbol = lambda s: ids.get(s, int(self.symbol[ord(s)]) if len(s) == 1 else -1)
        made = [(a, b, int(-scores[i]), i) for p, i in ids.items() if i not in runs.values() for k in range(1, len(p)) if (a := symbol(p[:k])) >= 0 and (b := symbol(p[k:])) >= 0]
        rank_of = {i: int(-scores[i]) for i in normal}
        joined = [rank_of[i] for i in normal if i not in runs.values() and len(self.pieces[i]) > 1]
        if len(set(joined)) != len(joined):
            raise ValueError("unsupported model: scores must be distinct")
        self.reach = max((len(self.pieces[i]) for i in normal if i not in runs.values()), default=1)
        self.careful = np.zeros(len(self.pieces), bool)
        for a, b, rank, _ in made:
            for part in (a, b):
                if part < FOREIGN and rank <= rank_of[part] and len(self.pieces[part]) > 1:
                    self.careful[part] = True
        keys = np.array([(a << SHIFT) + b for a, b, _, _ in made], np.int64)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        place = np.arange(len(keys)) - np.searchsorted(bucket[order], bucket[order])
        self.table = np.full((1 << 18, int(place.max()) + 1), -1, np.int64)
        self.value = np.zeros(self.table.shape, np.int32)
        self.table[bucket[order], place] = keys[order]
        self.value[bucket[order], place] = np.array([i for *_, i in made], np.int32)[order]
        self.rank = np.zeros(len(self.pieces), np.int32)
        self.rank[normal] = [min(rank_of[i], int(NONE) - 1) for i in normal]
        # Characters that end a word whatever comes next.
        self.lone = [c for c in "\n\t\r" if c not in inner]
        lone = "".join(map(re.escape, self.lone))
        self.words = re.compile(f" *[^ {lone}]+|[{lone}]| +" if lone else " *[^ ]+| +")
        self.cache_ids: dict[str, bytes] = {}
        self.cache_text: dict[str, bytes] = {}

    @staticmethod
    def _cut_run(n: int, sizes: set[int]) -> list[int]:
        """What a run of n blanks becomes if always the leftmost pair that makes a piece is merged."""
        run = [1] * n
        while (at := next((i for i in range(len(run) - 1) if run[i] + run[i + 1] in sizes), None)) is not None:
            run[at : at + 2] = [run[at] + run[at + 1]]
        return run

    @staticmethod
    def _bucket(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = (a << SHIFT) + b
        bucket = self._bucket(keys)
        out = np.full(len(keys), -1, np.int32)
        for k in range(self.table.shape[1]):
            hit = self.table[bucket, k] == keys
            out[hit] = self.value[bucket[hit], k]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, whose blanks are written as blanks."""
        out: list[list[int]] = [[] for _ in words]
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        if len(short) < len(words):
            for k, found in zip(short, self.encode_words([words[k] for k in short]), strict=True):
                out[k] = found
            long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
            for k, found in zip(long, self.encode_long([words[k] for k in long]), strict=True):
                out[k] = found
            return out
        if not words:
            return out
        points = np.frombuffer("".join(words).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), "<u4")
        sym = self.symbol[points]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        made = np.full(len(sym), -1, np.int32)
        made[:-1] = np.where(word[1:] == word[:-1], self.pair(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.concatenate([starts, [len(sym)]]))
            if (done := least == NONE).any():
                ended = np.repeat(done, sizes)
                self._finish(sym[ended], word[ended], out)
                sym, word, made, rank = sym[~ended], word[~ended], made[~ended], rank[~ended]
                least, sizes = least[~done], sizes[~done]
                starts = np.cumsum(sizes) - sizes
                if not len(sym):
                    break
            here = rank == np.repeat(least, sizes)
            at = np.flatnonzero(here)
            # Of overlapping pairs the first, third, ... are merged.
            first = np.concatenate([[True], np.diff(at) != 1])
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            chosen = (np.arange(len(at)) - run) % 2 == 0
            careful = self.careful[made[at]]
            if careful.any():
                leftmost = np.concatenate([[True], word[at][1:] != word[at][:-1]])
                chosen &= ~careful | leftmost
            at = at[chosen]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            now = np.cumsum(keep)[at] - 1
            sym, word, made = sym[keep], word[keep], made[keep]
            stale = np.unique(np.concatenate([now, now[now > 0] - 1]))
            made[stale] = -1
            stale = stale[stale < len(sym) - 1]
            stale = stale[word[stale] == word[stale + 1]]
            made[stale] = self.pair(sym[stale], sym[stale + 1])
        return out

    def encode_long(self, words: list[str]) -> list[list[int]]:
        """Ids of long words, by rounds that merge every pair whose neighbourhood can't change before it is merged."""
        sym = self.symbol[np.frombuffer("\0".join(words).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), "<u4")]
        sym[np.cumsum([len(w) + 1 for w in words[:-1]], dtype=np.int64) - 1] = BARRIER
        made = self.pair(sym[:-1], sym[1:])
        while (live := np.flatnonzero(made >= 0)).size:
            rank = np.full(len(made), NONE)
            rank[live] = self.rank[made[live]]
            at = live[rank[live] == self._least_around(rank)[live]]
            # Of overlapping pairs of one rank the first, third, ... are merged; all of a run must have the smallest rank.
            first = np.concatenate([[True], np.diff(at) != 1])
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            cut = first & (at > 0) & (rank[np.maximum(at - 1, 0)] == rank[at])  # the run begins before the window
            chosen = ((np.arange(len(at)) - run) % 2 == 0) & ~cut[run]
            at = at[chosen]
            # What a merge makes with its neighbours when all merges to its left are done and none to its right.
            piece, r = made[at], rank[at]
            before = np.where((at > 1) & np.isin(at - 2, at, assume_unique=True), made[np.maximum(at - 2, 0)], sym[np.maximum(at - 1, 0)])
            left, right = self.pair(before.astype(np.int64), piece.astype(np.int64)), self.pair(piece.astype(np.int64), sym[np.minimum(at + 2, len(sym) - 1)])
            left[at == 0], right[at + 2 >= len(sym)] = -1, -1
            turns = (left >= 0) & (self.rank[left] <= r) | (right >= 0) & (self.rank[right] <= r)
            if turns.any():  # what follows such a merge within reach has to wait
                latest = np.maximum.accumulate(np.where(turns, at, -1 - 2 * self.reach))
                latest = np.concatenate([[-1 - 2 * self.reach], latest[:-1]])
                at = at[at - latest > self.reach + 1]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))
            sym = sym[keep]
            made = made[keep[:-1]][: len(sym) - 1]
            stale = np.unique(np.concatenate([now, now[now > 0] - 1]))
            stale = stale[stale < len(made)]
            made[stale] = self.pair(sym[stale], sym[stale + 1])
        ends = [*np.flatnonzero(sym == BARRIER).tolist(), len(sym)]
        symbols = sym.tolist()
        return [self._expand(symbols[a:b]) for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)]

    def _least_around(self, rank: np.ndarray) -> np.ndarray:
        """The smallest rank within reach on either side of each pair, by doubling windows."""
        reach = self.reach + 1
        padded = np.concatenate([np.full(reach, NONE), rank, np.full(reach, NONE)])
        size, least = 1, padded
        while 2 * size <= 2 * reach + 1:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = 2 * reach + 1 - size
        return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least

    def _finish(self, sym: np.ndarray, word: np.ndarray, out: list[list[int]]) -> None:
        ends = np.concatenate([np.flatnonzero(word[1:] != word[:-1]) + 1, [len(sym)]]).tolist()
        odd = (sym >= FOREIGN) | (sym == self.blank)
        odd = np.add.reduceat(odd, [0, *ends[:-1]]) > 0
        ids, a = sym.tolist(), 0
        for b, w, strange in zip(ends, word[[0, *ends[:-1]]].tolist(), odd.tolist(), strict=True):
            out[w] = self._expand(ids[a:b]) if strange else ids[a:b]
            a = b

    def _expand(self, symbols: list[int]) -> list[int]:
        """Blank runs to their longest pieces, characters outside the model to bytes."""
        out, blanks, of = [], 0, self.bytes_ids
        for s in [*symbols, -1]:
            if s == self.blank and s < FOREIGN:
                blanks += 1
                continue
            if blanks:
                out += [self.runs[self.most]] * (blanks // self.most)
                out += [self.runs[n] for n in self.cut.get(blanks % self.most, [])]
                blanks = 0
            if s >= FOREIGN:
                out += [of[x] for x in chr(s - FOREIGN).encode("utf-8", "replace")]
            elif s >= 0:
                out.append(s)
        return out

    def _portions(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PORTION and (cut := re.compile(r"(?<=[^ ]) ").search(text, at + PORTION)):
                end = cut.start()
            yield text[at:end]
            at = end

    def portions(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in runs of bounded length."""
        if text:
            for part in self._portions(" " + text.replace(BLANK, " ")):
                yield self.words.findall(part)

    def learn(self, words: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Comma-joined ids and decoded bytes of words, those from the cache included."""
        missing = [w for w in words if w not in self.cache_ids]
        if len(self.cache_ids) + len(missing) > CACHE_WORDS:
            self.cache_ids, self.cache_text = {}, {}
            missing = list(words)
        surface, text_of = self.surface, self.text_of
        ids, text = self.cache_ids, self.cache_text
        if any(len(w) > CACHED_LENGTH for w in missing):
            ids, text = dict(ids), dict(text)
        for w, found in zip(missing, self.encode_words(missing), strict=True):
            ids[w] = b",".join([text_of[i] for i in found])
            text[w] = b"".join([surface[i] for i in found])
        return ids, text

    def encode(self, text: str) -> list[int]:
        return [i for words in self.portions(text) for found in self.encode_words(words) for i in found]

    def decode(self, ids: list[int]) -> str:
        return self.undummy(b"".join([self.surface[i] for i in ids])).decode("utf-8", "replace")

    @staticmethod
    def undummy(decoded: bytes) -> bytes:
        """Without the blank that encoding put in front."""
        return decoded[1:] if decoded.startswith(b" ") else decoded


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (comma-joined), decoded."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            ids, decoded = zip(*encode_batch(m, b["text"].to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([b",".join(x).decode() for x in ids], pa.string()), pa.array([m.undummy(b"".join(x)).decode("utf-8", "replace") for x in decoded], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, ids string, decoded string")


def encode_batch(m: PieceModel, texts: list[str]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """For each text the comma-joined ids and the decoded bytes of its portions. Texts share rounds up to PORTION characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PORTION):
            size += len(texts[end])
            end += 1
        if end == at + 1 and size > PORTION:
            ids, decoded = [], []
            for words in m.portions(texts[at]):
                of_ids, of_text = m.learn(set(words))
                ids.append(b",".join(map(of_ids.__getitem__, words)))
                decoded.append(b"".join(map(of_text.__getitem__, words)))
            yield ids, decoded
        else:
            lists = [[w for words in m.portions(t) for w in words] for t in texts[at:end]]
            of_ids, of_text = m.learn(set().union(*lists))
            for words in lists:
                yield ([b",".join(map(of_ids.__getitem__, words))] if words else []), [b"".join(map(of_text.__getitem__, words))]
        at = end


def digest_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode_documents() makes, hashed where it is made."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for ids, decoded in encode_batch(m, b["text"].to_pylist()):
                h, count = hashlib.sha256(), 0
                for k, part in enumerate(ids):
                    h.update(b"," + part if k else part)
                    count += part.count(b",") + 1
                n.append(count)
                of_ids.append(h.hexdigest())
                of_text.append(hashlib.sha256(m.undummy(b"".join(decoded))).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), model_path())
