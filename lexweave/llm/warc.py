"""WARC archives as a chunked record table.

Writing: which payloads repeat is decided on digests and ids alone. Payloads become chunk rows of CHUNK bytes before they
leave the JVM, and every task streams its rows into gzip archives of the shared folder, a member a record, under a temporary
name that is renamed at the end, so a repeated task replaces its own file. Equal payloads of at least MIN_REVISIT bytes are
stored once: the row with the largest id is the response, the others are revisits with headers alone.

The decisions (a row for each digest that repeats) are broadcast up to BROADCAST_BYTES, which is measured first, so payloads
aren't shuffled. Beyond, rows and decisions are joined by digest and one of SALTS salts, and payloads are shuffled once.

Reading: archives are decompressed in blocks. A record becomes one row for each CHUNK bytes of payload, with record and
chunk number, the offset, the bytes (unless they aren't asked for) and the SHA-1 of all payload bytes so far, so no record is
held whole and the row of the last chunk has the record's digest, which is compared with the one in its header.

Defined cases: null html is an empty payload. Null ids are kept and are smaller than all others. Rows that repeat id and
payload of a response are responses as well (and share the record id that revisits refer to). Other columns are ignored. An
empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import fresh_path, materialize, table, text_batches, text_or_empty

MIN_REVISIT = 1000
#: Payload bytes in a chunk row, raw bytes read at once, and the size at which a task begins another archive.
CHUNK, BLOCK, ROLL = 1 << 20, 1 << 18, 1 << 28
#: Bytes of decisions that are broadcast at most, and salts of the join beyond.
BROADCAST_BYTES, SALTS = 32 << 20, 32
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, payload, sha1, length, referred (whether others revisit it) and, for revisits, refers_to and refers_url."""
    payload = text_or_empty(html_col).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("length", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    digests = rows.filter(F.col("length") >= min_revisit).groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
    first = materialize(digests.filter("n > 1 and first_id is not null").select(F.col("sha1").alias("first_sha1"), "first_id", "first_url"), "warc-repeated")
    size = first.agg(F.sum(F.octet_length("first_url") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(first), rows.sha1 == first.first_sha1, "left")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("with_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, (dealt.sha1 == salted.first_sha1) & (dealt.with_salt == salted.salt), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "sha1", "length", (F.col("first_id").isNotNull() & ~again).alias("referred"), F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def payload_chunks(decided: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of a payload, in order, and one without bytes for revisits and empty payloads."""
    bare = F.col("refers_to").isNotNull() | (F.col("length") == 0)
    count = F.when(bare, F.lit(1)).otherwise(F.ceil(F.col("length") / F.lit(chunk)).cast("int"))
    numbered = decided.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1)))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk_no") * F.lit(chunk) + 1, F.lit(chunk)))
    return numbered.select("page_id", "url", "sha1", "length", "referred", "refers_to", "refers_url", "chunk_no", data.alias("data"))


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _clean(value: str) -> str:
    return " ".join(value.split())


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def headers(name: str, page_id: int | None, url: str, length: int, sha1: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """The record up to its payload; a revisit has none."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(name)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else length))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"{refers_to}/{sha1}")), ("WARC-Refers-To-Target-URI", _clean(refers_url or "")), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


class ArchiveWriter:
    """Streams records into gzip archives; finish() gives the archives that are complete."""

    def __init__(self, folder: str, part: str, attempt: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.uri, self.part, self.attempt = folder, part, attempt
        self.done: list[tuple[str, int, int]] = []
        self.stream = None
        self.fs.create_dir(self.folder, recursive=True)

    def begin(self, page_id: int | None, url: str, length: int, sha1: str, referred: bool, refers_to: int | None, refers_url: str | None) -> None:
        """A record's headers; put() its payload's chunks and end() it."""
        if self.stream is None:
            self.name = f"{self.part}-{len(self.done):04d}.warc.gz"
            self.stream = self.fs.open_output_stream(f"{self.folder}/.{self.name}.{self.attempt}", compression=None)
            self.records = self.written = 0
        self.z = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.put(headers(f"{page_id}/{sha1}" if referred else f"{self.name}/{self.records}", page_id, url, length, sha1, refers_to, refers_url))

    def put(self, data: bytes | memoryview) -> None:
        self._write(self.z.compress(data))

    def end(self) -> None:
        self.put(b"\r\n\r\n")
        self._write(self.z.flush())
        self.records += 1
        if self.written >= ROLL:
            self.close()

    def _write(self, data: bytes) -> None:
        if data:
            self.stream.write(data)
            self.written += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.move(f"{self.folder}/.{self.name}.{self.attempt}", f"{self.folder}/{self.name}")
            self.done.append((f"{self.uri}/{self.name}", self.records, self.written))
            self.stream = None


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        archive = ArchiveWriter(folder, f"part-{context.partitionId():06d}", f"{context.taskAttemptId()}")
        left = 0
        for b in batches:
            fields = [b[c].to_pylist() for c in ("page_id", "url", "length", "sha1", "referred", "refers_to", "refers_url")]
            for record, n, data in zip(zip(*fields, strict=True), b["chunk_no"].to_pylist(), b["data"], strict=True):
                if not n:
                    archive.begin(*record)
                    left = record[2] if record[5] is None else 0
                if data.is_valid:
                    archive.put(memoryview(data.as_buffer()))
                    left -= len(data.as_buffer())
                if not left:
                    archive.end()
        archive.close()
        paths, records, sizes = zip(*archive.done, strict=True) if archive.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return run


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Write decide()'s rows below folder (a URI that driver and executors share); returns the written list of archives."""
    spark = decided.sparkSession
    text_batches(spark)
    listing = f"{folder}/listing"
    payload_chunks(decided).mapInArrow(_writer(f"{folder}/archives"), "path string, records long, bytes long").write.mode("overwrite").parquet(listing)
    return spark.read.schema("path string, records long, bytes long").parquet(listing)


class _Bytes:
    """Decompressed bytes of concatenated gzip members, a bounded block at a time."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.z, self.raw, self.ready, self.end = stream, zlib.decompressobj(31), b"", b"", False

    def more(self) -> bool:
        while not self.end:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(BLOCK)
                if not self.raw:
                    self.end = True
                    break
            out = self.z.decompress(self.raw, CHUNK)
            self.raw = b"" if self.z.eof else self.z.unconsumed_tail
            if out:
                self.ready += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                return None
        out, self.ready = self.ready[: at + len(mark)], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n and self.more():
            pass
        if len(self.ready) < n:
            raise EOFError("the archive ends inside a record")
        out, self.ready = self.ready[:n], self.ready[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if line)}


def read_records(stream: pa.NativeFile, chunk: int = CHUNK, with_data: bool = True) -> Iterator[dict]:
    """The chunk rows of one archive. A record without payload has one row with no bytes; with_data=False leaves out all bytes."""
    source, number = _Bytes(stream), 0
    while (head := source.until(b"\r\n\r\n")) is not None:
        warc = _fields(head)
        left = int(warc.get("content-length", 0))
        record = {"record_no": number, "record_type": warc.get("warc-type"), "url": warc.get("warc-target-uri"), "page_id": warc.get("x-page-id"), "refers_to": warc.get("x-refers-to-page-id")}
        declared, length = warc.get("warc-payload-digest", ""), None
        if warc.get("content-type", "").startswith("application/http"):
            http = source.until(b"\r\n\r\n") or b""
            left -= len(http)
            length = int(_fields(http).get("content-length", 0))
        declared = base64.b32decode(declared[5:]).hex() if declared.startswith("sha1:") else None
        if record["record_type"] == "revisit":
            while left:
                left -= len(source.take(min(chunk, left)))
            yield record | {"chunk_no": 0, "at": 0, "data": b"", "payload_bytes": length, "sha1": declared, "last": True}
        else:
            sha1, n, at = hashlib.sha1(), 0, 0
            while True:
                data = source.take(min(chunk, left))
                sha1.update(data)
                left -= len(data)
                if not left and declared and sha1.hexdigest() != declared:
                    raise ValueError(f"record {number}: the payload doesn't have the digest {declared}")
                yield record | {"chunk_no": n, "at": at, "data": data if with_data else None, "payload_bytes": at + len(data), "sha1": sha1.hexdigest(), "last": not left}
                n, at = n + 1, at + len(data)
                if not left:
                    break
        source.take(4)
        number += 1


CHUNK_SCHEMA = "archive string, record_no long, chunk_no int, at long, data binary, payload_bytes long, sha1 string, last boolean, record_type string, url string, page_id long, refers_to long"


def _reader(batches: Iterator[pa.RecordBatch], with_data: bool = True) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in CHUNK_SCHEMA.split(", ")]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    for b in batches:
        for uri in b["path"].to_pylist():
            files, path = pafs.FileSystem.from_uri(uri)
            rows, held = [], 0
            with files.open_input_stream(path, compression=None) as stream:
                for r in read_records(stream, with_data=with_data):
                    ids = {k: None if r[k] is None else int(r[k]) for k in ("page_id", "refers_to")}
                    rows.append(r | ids | {"archive": uri})
                    held += len(r["data"] or b"") + 200
                    if held >= 4 * CHUNK:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def read_archives(listing: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk rows of all archives of a list (path), an archive a task; with_data=False gives rows without their bytes."""
    n = max(1, min(listing.count(), 100_000))
    return listing.select("path").repartition(n, "path").mapInArrow(partial(_reader, with_data=with_data), CHUNK_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = write_archives(decide(table(spark, sf_dir, "pages")), fresh_path(spark, "warc"))
    chunks = read_archives(listing, with_data=False)
    return chunks.filter("last").select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
