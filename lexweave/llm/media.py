"""Media columns: signature sniffing of binary values.

One Aho-Corasick automaton holds the magic bytes of all known formats and the end marks of those that are read from their
end. A pass over the bytes gives all places; a validator of the format then walks the structure from a candidate and must
confirm it and its length. Walks of one value share what they have found (Structure), so bytes that are full of magics cost
no more than a few passes. What starts at byte 0 and is valid corrects the declared type; other confirmed spans are embedded
media, and are carved. Magic bytes that the structure doesn't confirm are ignored.

The query stores each payload as 8-bit samples of a WAVE file that is declared as text, reads the stored bytes back by
sniffing, corrects the type, carves the file and computes features of its samples.

Defined cases: a null value counts as empty and has no media type. Values of any length are scanned whole, in windows
that overlap by the longest magic. A PDF ends at its last end mark before the next PDF's header, so updates belong to it.
Spans may nest or overlap; inside a confirmed gzip stream, whose bytes are compressed, no other gzip stream is looked for.
Repeated rows give repeated results, other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import table, text_batches, text_or_empty

WINDOW = 1 << 20
UNKNOWN = "application/octet-stream"
RATE = 8000


class Span(NamedTuple):
    start: int
    end: int
    media_type: str


class Structure:
    """One value and what its validators share. A validator gets the place of a format's first byte and gives the end of the
    format, or None."""

    def __init__(self, data: bytes):
        self.data = data
        #: Places of each magic and end mark, ascending.
        self.places: dict[str, list[int]] = {k: [] for k in (*(f[0] for f in FORMATS), *MARKS)}
        longest = max(map(len, (*MAGICS, *MARKS.values()))) - 1
        for at in range(0, len(data), WINDOW):
            begin = max(0, at - longest)
            for end, (kind, size) in _automaton().iter(data[begin : at + WINDOW].decode("latin-1")):
                if begin + end >= at:
                    self.places[kind].append(begin + end + 1 - size)
        #: Ends of chains of chunks or blocks by the place where a link begins; None where the chain breaks.
        self.ends: dict[tuple[str, int], int | None] = {}
        #: RIFF chunks: the path that visits a place and the place's number in it, where each path goes on, and the next chunk of a
        #: kind from a place on.
        self.path_of: dict[int, tuple[int, int]] = {}
        self.paths: list[int] = []
        self.next_chunk: dict[tuple[bytes, int], int] = {}

    def chain(self, kind: str, at: int, step: Callable[[int], tuple[int | None, bool]]) -> int | None:
        """Where a chain ends that goes on at a place. step: place -> (next place or None, whether it ends there)."""
        passed = []
        while (kind, at) not in self.ends:
            passed.append(at)
            following, last = step(at)
            if last or following is None:
                self.ends[kind, at] = following
                break
            at = following
        end = self.ends[kind, at]
        for p in passed:
            self.ends[kind, p] = end
        return end

    def wave(self, at: int) -> int | None:
        data = self.data
        if data[at + 8 : at + 12] != b"WAVE":
            return None
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        if end > len(data):
            return None
        start = at + 12
        self.walk_chunks(start)
        first = [self.next_chunk.get((kind, start), end) for kind in (b"fmt ", b"data")]
        # A last chunk of odd length may lack its padding.
        whole = self.reaches(start, end) or self.reaches(start, end + 1) and not self.reaches(start, end - 7)
        return end if max(first) < end and whole else None

    def walk_chunks(self, start: int) -> None:
        """Follow the chunks from a place until they end or meet a path that is known; places are visited once."""
        data, path, here = self.data, [], start
        while here not in self.path_of and here + 8 <= len(data):
            self.path_of[here] = (len(self.paths), len(path))
            path.append(here)
            size = struct.unpack_from("<I", data, here + 4)[0]
            here += 8 + size + (size & 1)
        self.path_of.setdefault(here, (len(self.paths), len(path)))
        self.paths.append(here)
        for p in reversed(path):
            for kind in (b"fmt ", b"data"):
                if data[p : p + 4] == kind:
                    self.next_chunk[kind, p] = p
                elif (kind, here) in self.next_chunk:
                    self.next_chunk[kind, p] = self.next_chunk[kind, here]
            here = p

    def reaches(self, at: int, end: int) -> bool:
        """Whether the chunks from a place have one that begins or ends at another."""
        while at < end:
            path, k = self.path_of[at]
            other = self.path_of.get(end, (-1, 0))
            if other[0] == path and other[1] >= k:
                return True
            after = self.paths[path]
            if after == at or self.path_of[after] == (path, k):
                return False
            at = after
        return at == end

    def png(self, at: int) -> int | None:
        data = self.data
        if data[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
            return None

        def step(here: int) -> tuple[int | None, bool]:
            if here + 12 > len(data):
                return None, True
            size = struct.unpack_from(">I", data, here)[0]
            if here + 12 + size > len(data) or zlib.crc32(memoryview(data)[here + 4 : here + 8 + size]) != struct.unpack_from(">I", data, here + 8 + size)[0]:
                return None, True
            return here + 12 + size, data[here + 4 : here + 8] == b"IEND"

        return self.chain("png", at + 8, step)

    def gif(self, at: int) -> int | None:
        data = self.data
        if at + 13 > len(data):
            return None

        def sub(here: int) -> tuple[int | None, bool]:
            if here >= len(data):
                return None, True
            return here + 1 + data[here], not data[here]

        def step(here: int) -> tuple[int | None, bool]:
            if here >= len(data):
                return None, True
            if data[here] == 0x3B:
                return here + 1, True
            if data[here] == 0x21:
                return self.chain("gif blocks", here + 2, sub), False
            if data[here] == 0x2C and here + 10 <= len(data):
                local = data[here + 9]
                return self.chain("gif blocks", here + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0), sub), False
            return None, True

        flags = data[at + 10]
        return self.chain("gif", at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), step)

    @cached_property
    def markers(self) -> np.ndarray:
        """Places of JPEG markers that aren't part of entropy-coded bytes."""
        x = np.frombuffer(self.data, np.uint8)
        after = x[1:]
        return np.flatnonzero((x[:-1] == 0xFF) & (after != 0) & ((after < 0xD0) | (after > 0xD7)))

    def jpeg(self, at: int) -> int | None:
        data = self.data

        def step(here: int) -> tuple[int | None, bool]:
            """Places after a scan are negative: only there the image may end."""
            here, scanned = abs(here), here < 0
            if here + 2 > len(data) or data[here] != 0xFF:
                return None, True
            marker = data[here + 1]
            if marker == 0xD9:
                return (here + 2 if scanned else None), True
            if here + 4 > len(data) or not 0xC0 <= marker <= 0xFE or (size := struct.unpack_from(">H", data, here + 2)[0]) < 2:
                return None, True
            here += 2 + size
            if marker == 0xDA:
                k = int(np.searchsorted(self.markers, here))
                return (-int(self.markers[k]), False) if k < len(self.markers) else (None, True)
            return (-here if scanned else here), False

        return self.chain("jpeg", at + 2, step)

    def bmp(self, at: int) -> int | None:
        data = self.data
        if at + 30 > len(data):
            return None
        size, zero, offset, header = struct.unpack_from("<IIII", data, at + 2)
        planes, depth = struct.unpack_from("<HH", data, at + 26)
        good = zero == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + header <= offset <= size
        return at + size if good and at + size <= len(data) else None

    def pdf(self, at: int) -> int | None:
        data, headers, ends, tables = self.data, self.places["application/pdf"], self.places["pdf end"], self.places["pdf table"]
        if not (data[at + 5 : at + 8].replace(b".", b"").isdigit() and data[at + 6 : at + 7] == b"."):
            return None
        k = bisect_right(headers, at)
        last = bisect_left(ends, headers[k] if k < len(headers) else len(data)) - 1
        if last < 0 or ends[last] < at:
            return None
        table = bisect_right(tables, at)
        return ends[last] + 5 if table < len(tables) and tables[table] < ends[last] else None

    @cached_property
    def directories(self) -> dict[int, int]:
        """Where ZIP archives begin by their central directories, and where they end."""
        data, out = self.data, {}
        for end in self.places["zip end"]:
            if end + 22 > len(data):
                continue
            count, size, offset, comment = struct.unpack_from("<HIIH", data, end + 10)
            start, whole = end - size - offset, end + 22 + comment
            if count and start >= 0 and whole <= len(data) and data[start + offset : start + offset + 4] == b"PK\x01\x02":
                out.setdefault(start, whole)
        return out

    def zip(self, at: int) -> int | None:
        return self.directories.get(at)

    def gzip(self, at: int) -> int | None:
        data = self.data
        if at + 18 > len(data) or data[at + 3] & 0xE0 or at < self.ends.get(("gzip", -1), 0):
            return None
        z, rest = zlib.decompressobj(31), memoryview(data)[at:]
        try:
            while not z.eof:
                if not rest:
                    return None
                block = rest[:65536]
                made = z.decompress(block, 1 << 20)
                used = len(block) - len(z.unconsumed_tail) - len(z.unused_data)
                if not made and not used and not z.eof:
                    return None
                rest = rest[used:]
        except zlib.error:
            return None
        self.ends["gzip", -1] = len(data) - len(rest)
        return self.ends["gzip", -1]


#: Media type, validator, and magic bytes.
FORMATS: list[tuple[str, Callable[[Structure, int], int | None], tuple[bytes, ...]]] = [
    ("audio/wav", Structure.wave, (b"RIFF",)),
    ("image/png", Structure.png, (b"\x89PNG\r\n\x1a\n",)),
    ("image/gif", Structure.gif, (b"GIF87a", b"GIF89a")),
    ("image/jpeg", Structure.jpeg, (b"\xff\xd8\xff",)),
    ("image/bmp", Structure.bmp, (b"BM",)),
    ("application/pdf", Structure.pdf, (b"%PDF-",)),
    ("application/zip", Structure.zip, (b"PK\x03\x04",)),
    ("application/gzip", Structure.gzip, (b"\x1f\x8b\x08",)),
]
MAGICS = [m for *_, magics in FORMATS for m in magics]
#: Marks that lead to a format's end.
MARKS = {"pdf end": b"%%EOF", "pdf table": b"startxref", "zip end": b"PK\x05\x06"}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, marks in [*((kind, magics) for kind, _, magics in FORMATS), *((k, (m,)) for k, m in MARKS.items())]:
        for mark in marks:
            found.add_word(mark.decode("latin-1"), (kind, len(mark)))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[Span]:
    """Confirmed media by their start, of those that start together the longest first."""
    value = Structure(data)
    spans = [Span(start, end, kind) for kind, validator, _ in FORMATS for start in value.places[kind] if (end := validator(value, start)) is not None]
    return sorted(spans, key=lambda s: (s.start, -s.end))


def corrected(spans: list[Span], declared: str | None) -> str:
    """The type that the bytes have; the declared one if they show none and it isn't one that they would show."""
    if spans and spans[0].start == 0:
        return spans[0].media_type
    return declared if declared and declared not in {f[0] for f in FORMATS} else UNKNOWN


def true_type(data: bytes, declared: str | None) -> str:
    return corrected(sniff(data), declared)


def carve(data: bytes, spans: list[Span] | None = None) -> list[tuple[Span, bytes]]:
    """The bytes of each confirmed span, nested ones included."""
    return [(s, data[s.start : s.end]) for s in (sniff(data) if spans is None else spans)]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("media_type", pa.string())]))


def sniff_column(values: DataFrame, id_col: str, data_col: str, declared_col: str | None = None) -> DataFrame:
    """id, media_type and embedded: array of (start, end, media_type)."""
    text_batches(values.sparkSession)
    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types, inner = [], []
            for data, said in zip(b["data"], b["declared"], strict=True):
                spans = sniff(data.as_py() or b"")
                types.append(corrected(spans, said.as_py()))
                inner.append([s._asdict() for s in spans if s.start])
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(types, pa.string()), pa.array(inner, SPANS)], names=["id", "media_type", "embedded"])

    source = values.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).cast("binary").alias("data"), declared.alias("declared"))
    return source.mapInArrow(run, "id long, media_type string, embedded array<struct<start: long, end: long, media_type: string>>")


def carve_column(values: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """A row for each medium in a value, whole values included: id, start, media_type, media (binary)."""
    text_batches(values.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for id_, data in zip(b["id"], b["data"], strict=True):
                found = carve(data.as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array([id_.as_py()] * len(found), pa.int64()), pa.array([s.start for s, _ in found], pa.int64()), pa.array([s.media_type for s, _ in found], pa.string()), pa.array([m for _, m in found], pa.binary())], names=["id", "start", "media_type", "media"])

    source = values.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).cast("binary").alias("data"))
    return source.mapInArrow(run, "id long, start long, media_type string, media binary")


# 8-bit samples


def padded(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples as a WAVE file. The length is even, so no padding byte is due."""
    return b"".join([b"RIFF", struct.pack("<I", 36 + len(samples)), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8), b"data", struct.pack("<I", len(samples)), samples])


def wave_samples(stored: bytes) -> tuple[bytes, int]:
    """Samples and rate, from the chunks of a stored file."""
    here, rate = 12, 0
    while here + 8 <= len(stored):
        kind, size = stored[here : here + 4], struct.unpack_from("<I", stored, here + 4)[0]
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", stored, here + 12)[0]
        if kind == b"data":
            return stored[here + 8 : here + 8 + size], rate
        here += 8 + size + (size & 1)
    raise ValueError("no samples")


def features(media_type: str, samples: bytes, rate: int, inner: int) -> str:
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"{media_type};rate={rate};samples={len(x)};mean={counts @ np.arange(256) / len(x):.6f};peak={int(x.max())};zero={int(counts[0])};crossings={turns};entropy={-(p * np.log2(p)).sum():.6f};embedded={inner}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (binary), declared: each whole text as a WAVE file that is declared as the text it was."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([to_wave(padded(t)) for t in texts], pa.binary()), pa.array(["text/plain"] * len(texts))], names=["doc_id", "n_bytes", "media", "declared"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary, declared string")


READ_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(stored: DataFrame) -> DataFrame:
    """Digests and features of stored media. The type and the span come from the bytes, not from what was declared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in range(6)]
            for media, declared in zip(b["media"], b["declared"], strict=True):
                data = media.as_py()
                spans = sniff(data)
                [(_, whole)] = carve(data, spans[:1])
                samples, rate = wave_samples(whole)
                row = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(corrected(spans, declared.as_py()), samples, rate, len(spans) - 1))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[f.split()[0] for f in READ_SCHEMA.split(", ")])

    return stored.mapInArrow(run, READ_SCHEMA)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_texts(table(spark, sf_dir, "documents")))
