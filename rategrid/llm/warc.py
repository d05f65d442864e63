"""WARC archives as a chunked record table.

Writing: every task streams its rows into archives of its own in a shared
folder (one gzip member a record), payload slice by slice.  Records of equal
payload (and at least ``min_revisit_bytes``) form a group; the row with the
largest id is the response, the others are revisit records that refer to it.
Which groups have more than one row is decided on digests (combined map-side);
payloads never move between tasks.  A task attempt writes under a new name and
only the names of finished tasks are read, so a lost executor leaves no half
archive in the result.

Reading: an archive is streamed member by member.  A payload becomes rows
``(record id, chunk number)`` of at most ``chunk_bytes`` with the running SHA-1
after each chunk, so no record is ever held whole; the last chunk's digest is
checked against the record's header.

Cases: null html is an empty payload; a row with a null id is never the
response of a group that has an id; rows equal in id and payload are all
responses if that id is the largest; line breaks and spaces in an url are
percent-encoded; an empty table gives no archives and an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rategrid.llm.common import prepare, stage
from rategrid.session import ensure_checkpoint_dir
from rategrid.sources.io import checkpoint_dir

CHUNK_BYTES = 1 << 16
SLICE = 1 << 18                  # bytes read, hashed or compressed at a time
ARCHIVE_BYTES = 1 << 30          # payload bytes after which a task starts a new archive
MIN_REVISIT_BYTES = 0
DATE = "2020-01-01T00:00:00Z"    # capture time of every record (the table has none)
_PAGE, _NO_ID = 0x7761726370616765, 0x7761726370616700
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = ("record_id string, page_id long, record_type string, refers_to long, chunk_no long, is_last boolean, "
                "offset long, payload_bytes long, digest string, chunk binary")


def record_id(page_id: int | None) -> str:
    """WARC record id; the page id is its low 64 bits."""
    high, low = (_NO_ID, 0) if page_id is None else (_PAGE, page_id & (2**64 - 1))
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(rid: str) -> int | None:
    n = uuid.UUID(rid[len("<urn:uuid:"):-1]).int
    if n >> 64 == _NO_ID:
        return None
    low = n & (2**64 - 1)
    return low - 2**64 if low >= 2**63 else low


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class _Writer:
    """One archive: gzip members written to a stream."""

    def __init__(self, folder: str, name: str):
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"{folder}/{name}"
        self.out = fs.open_output_stream(f"{path}/{name}", compression=None)
        self.size = 0

    def record(self, headers: list[tuple[str, str]], head: bytes, payload) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        n = len(head) + (len(payload) if payload is not None else 0)
        lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(n))])
        self.out.write(z.compress(f"WARC/1.1\r\n{lines}\r\n".encode("utf-8") + head))
        for i in range(0, len(payload) if payload is not None else 0, SLICE):
            self.out.write(z.compress(payload[i:i + SLICE]))
        self.out.write(z.compress(b"\r\n\r\n") + z.flush())
        self.size += n

    def close(self) -> None:
        self.out.close()


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES,
                   id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row; the staged table of archives ``path, records``."""
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    key = F.when(F.octet_length("payload") >= min_revisit_bytes, F.sha2("payload", 256))
    groups = stage(rows.select(key.alias("key"), "page_id").where(F.col("key").isNotNull())
                   .groupBy("key").agg(F.max("page_id").alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("key", "main"), "payload-groups")
    typed = rows.withColumn("key", key).join(groups, "key", "left").select(
        "page_id", "url", "payload",
        F.when(F.col("main").isNotNull() & ~F.col("main").eqNullSafe(F.col("page_id")), F.col("main")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, count, done = None, 0, []
        for b in batches:
            ids, urls, main = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            for i in range(b.num_rows):
                if writer is None:
                    writer, count = _Writer(folder, f"{uuid.uuid4().hex}.warc.gz"), 0
                    info = b"format: WARC File Format 1.1\r\n"
                    writer.record([("WARC-Type", "warcinfo"), ("WARC-Date", DATE),
                                   ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                   ("Content-Type", "application/warc-fields")], info, None)
                buffer = b.column(2)[i].as_buffer()
                payload = memoryview(buffer) if buffer is not None else memoryview(b"")
                sha = hashlib.sha1()
                for s in range(0, len(payload), SLICE):
                    sha.update(payload[s:s + SLICE])
                target = "".join(c if c > " " else f"%{ord(c):02X}" for c in urls[i])
                head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                        f"Content-Length: {len(payload)}\r\n\r\n").encode()
                headers = [("WARC-Type", "response" if main[i] is None else "revisit"), ("WARC-Date", DATE),
                           ("WARC-Record-ID", record_id(ids[i])), ("WARC-Target-URI", target),
                           ("Content-Type", "application/http; msgtype=response"),
                           ("WARC-Payload-Digest", f"sha1:{base32(sha.digest())}")]
                if main[i] is not None:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(main[i]))]
                writer.record(headers, head, payload if main[i] is None else None)
                count += 1
                if writer.size >= ARCHIVE_BYTES:
                    writer.close()
                    done.append((writer.name, count))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((writer.name, count))
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()),
                               pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return stage(typed.mapInArrow(run, "path string, records long"), "archives")


class _Stream:
    """Bytes of a multi-member gzip stream, decompressed as they are asked for."""

    def __init__(self, raw):
        self.raw, self.z, self.rest, self.buf, self.end = raw, None, b"", b"", False

    def fill(self) -> bool:
        while not self.end:
            if not self.rest:
                self.rest = self.raw.read(SLICE)
                if not self.rest:
                    self.end = True
                    break
            if self.z is None:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.rest, SLICE)
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, None
            if got:
                self.buf += got
                return True
        return False

    def line(self) -> bytes | None:
        while b"\n" not in self.buf:
            if not self.fill():
                if self.buf:
                    raise ValueError("archive ends inside a header")
                return None
        out, _, self.buf = self.buf.partition(b"\n")
        return out.rstrip(b"\r")

    def read(self, n: int) -> bytes:
        while len(self.buf) < n and self.fill():
            pass
        out, self.buf = self.buf[:n], self.buf[n:]
        return out

    def headers(self) -> dict[str, str]:
        out = {}
        while line := self.line():
            k, _, v = line.decode("utf-8").partition(":")
            out[k.strip().lower()] = v.strip()
        return out


def read_chunks(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = True) -> DataFrame:
    """The chunked record table of archives (``path`` column): a row per record
    and chunk, with running offset, size and SHA-1 (base32) after the chunk.  A
    revisit is one row with the size and digest its headers give."""
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in CHUNK_SCHEMA.split(", ")]

    def records(path: str) -> Iterator[tuple]:
        fs, p = _filesystem(path)
        with fs.open_input_stream(p, compression=None) as raw:
            s = _Stream(raw)
            while (first := s.line()) is not None:
                if not first.startswith(b"WARC/"):
                    raise ValueError(f"no record where one is due in {path}")
                h = s.headers()
                left = int(h["content-length"])
                if h["warc-type"] in ("response", "revisit"):
                    status = s.line()
                    size = None
                    used = len(status) + 2
                    while line := s.line():
                        used += len(line) + 2
                        if line.lower().startswith(b"content-length:"):
                            size = int(line.split(b":")[1])
                    left -= used + 2
                    rid, page = h["warc-record-id"], page_of(h["warc-record-id"])
                    declared = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "revisit":
                        yield (rid, page, "revisit", page_of(h["warc-refers-to"]), 0, True, 0, size, declared, None)
                    else:
                        sha, at, no = hashlib.sha1(), 0, 0
                        while True:
                            part = s.read(min(chunk_bytes, left))
                            if len(part) < min(chunk_bytes, left):
                                raise ValueError(f"archive ends inside a payload: {path}")
                            left -= len(part)
                            sha.update(part)
                            digest = base32(sha.digest())
                            if not left and digest != declared:
                                raise ValueError(f"payload digest differs: {rid}")
                            yield (rid, page, "response", None, no, not left, at, at + len(part), digest,
                                   part if with_payload else None)
                            at, no = at + len(part), no + 1
                            if not left:
                                break
                while left:
                    left -= len(s.read(min(SLICE, left)))
                if s.read(4) != b"\r\n\r\n":
                    raise ValueError(f"record not closed in {path}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for path in b.column(0).to_pylist():
                held = []
                for r in records(path):
                    held.append(r)
                    if len(held) >= 256:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, CHUNK_SCHEMA)


def roundtrip(spark: SparkSession, pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` as archives, read them back: a row per record."""
    folder = f"{checkpoint_dir(ensure_checkpoint_dir(spark)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    chunks = read_chunks(write_archives(pages, folder), chunk_bytes, with_payload=False)
    return chunks.where("is_last").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to",
        (F.col("chunk_no") + 1).alias("n_chunks"))
