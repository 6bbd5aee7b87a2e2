"""WARC archives: write, normalise whole-file gzip to one member a record, index, read back.

`write_archives` writes each partition as one monolithic gzip stream of WARC
records, through Spark's own text writer. `normalise` inflates such a stream
once, rewrites every record as its own gzip member and writes a sidecar index
(`<archive>.idx`, a JSON line per record: offset, length, record id, type, page)
beside the new archive. `read_archives` reads the records back by their offsets.

Memory is bounded: blocks are streamed through in pieces when normalising; only
reading back holds one record. A file is written under a temporary name and
renamed when whole, so an attempt that was lost or ran twice leaves no half
file. Archives lie in the folder given, by default the shared one; files are
reached by `open` for file: paths and by pyarrow's file systems otherwise.

Of pages with equal payloads of at least REVISIT_BYTES bytes those with the
smallest page_id are responses, the others revisits of it, with no payload of
their own. Null html is an empty payload; a null page_id makes a response, as
it orders nowhere, and comes back as null; a null url becomes the record id.
Pages that are repeated in full, page_id included, are responses each. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.operators.cluster import materialize, scratch_path

REVISIT_BYTES = 100
BROADCAST_ROWS = 100_000
PIECE = 1 << 18
LEVEL = 6
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def first_copies(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """digest, first_id for each payload of at least `least` bytes that several pages share."""
    sized = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length("html").alias("size"))
    groups = sized.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return materialize(groups.where("n > 1 and first_id is not null").select("digest", "first_id"), "warc-copies")


def record_texts(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """`value`: each page as a WARC record, without the two line ends that close it."""
    copies = first_copies(pages)
    if copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    named = named.join(copies, "digest", "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False))
    size = F.octet_length("html")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    own = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.uuid()), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), own,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(F.regexp_replace("url", r"[\r\n]+", " "), own),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.coalesce(F.concat(F.lit("\r\nX-Page-ID: "), F.col("page_id").cast("string")), F.lit("")),
        F.lit("\r\nX-Payload-Length: "), size.cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length("http") + F.when(revisit, 0).otherwise(size)).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return named.withColumn("http", http).select(F.concat(head, "http", F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Each partition of pages (page_id, url, html) as one gzip stream; the writer's line separator closes the records."""
    record_texts(pages).write.option("lineSep", RECORD_END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


@contextmanager
def reading(uri: str):
    """A seekable binary file, by its URI."""
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            yield f
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            yield f


@contextmanager
def writing(uri: str):
    """A binary file that appears under its name only when whole."""
    path, temporary = _local(uri), f".{uuid.uuid4().hex}.part"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + temporary, "wb") as f:
            yield f
        os.replace(path + temporary, path)
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_output_stream(path + temporary) as f:
            yield f
        system.move(path + temporary, path)


def inflated(f) -> Iterator[bytes]:
    """Pieces of a gzip file of any number of members."""
    engine = zlib.decompressobj(31)
    while data := f.read(PIECE):
        while data:
            yield engine.decompress(data, 4 * PIECE)
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data.lstrip(b"\0")
                engine = zlib.decompressobj(31)
    yield engine.flush()


class RecordReader:
    """Records of an inflated WARC stream: headers, then pieces of the block."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        for piece in self.pieces:
            if piece:
                self.held += piece
                return True
        return False

    def __iter__(self) -> Iterator[tuple[bytes, Iterator[bytes]]]:
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a record's headers")
                    return
            head = bytes(self.held[: end + 4])
            del self.held[: end + 4]
            block = self._block(int(headers(head)["content-length"]))
            yield head, block
            for _ in block:
                pass
            while len(self.held) < 4 and self._more():
                pass
            if self.held[:4] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            del self.held[:4]

    def _block(self, left: int) -> Iterator[bytes]:
        while left:
            if not self.held and not self._more():
                raise ValueError("the archive ends inside a record's block")
            piece = bytes(self.held[:left])
            del self.held[: len(piece)]
            left -= len(piece)
            yield piece


def headers(head: bytes) -> dict[str, str]:
    """Headers of a record, names in lower case."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def normalise_file(source: str, target: str, level: int = LEVEL) -> int:
    """Inflate `source` once; write `target`, a member a record, and its index. Returns the number of records."""
    n = 0
    with reading(source) as f, writing(target) as out, writing(f"{target}.idx") as index:
        offset = 0
        for head, block in RecordReader(inflated(f)):
            engine = zlib.compressobj(level, zlib.DEFLATED, 31)
            length = out.write(engine.compress(head))
            for piece in block:
                length += out.write(engine.compress(piece))
            length += out.write(engine.compress(b"\r\n\r\n") + engine.flush())
            found = headers(head)
            line = {"offset": offset, "length": length, "id": found.get("warc-record-id"), "type": found.get("warc-type"), "page": found.get("x-page-id")}
            index.write(json.dumps(line).encode() + b"\n")
            offset += length
            n += 1
    return n


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """path of each archive in a folder, a task for each as far as Spark's default parallelism is exceeded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "length")
    return files.repartition(max(spark.sparkContext.defaultParallelism * 4, 16), "path")


def normalise(spark: SparkSession, source: str, target: str, level: int = LEVEL) -> DataFrame:
    """Normalise every archive of folder `source` into folder `target`; returns archive, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            names = [f"{target}/{re.sub(r'(?:[.]txt)?[.]gz$', '', p.rsplit('/', 1)[-1])}.warc.gz" for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([normalise_file(p, t, level) for p, t in zip(paths, names, strict=True)], pa.int64())], ["archive", "records"])

    return materialize(archive_files(spark, source).mapInArrow(run, "archive string, records long"), "warc-normalised")


def read_record(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the member at an offset; the payload is what follows the HTTP headers."""
    f.seek(offset)
    data = zlib.decompress(f.read(length), 31)
    end = data.index(b"\r\n\r\n") + 4
    found = headers(data[:end])
    block = memoryview(data)[end : end + int(found["content-length"])]
    body = data.index(b"\r\n\r\n", end) + 4 - end
    return found, bytes(block[body:])


def read_archives(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Records of normalised archives (column archive), by their indexes. Each payload is digested again and must agree with its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                with reading(archive) as f, reading(f"{archive}.idx") as index:
                    for line in index.read().splitlines():
                        entry = json.loads(line)
                        found, payload = read_record(f, entry["offset"], entry["length"])
                        kind, digest = found["warc-type"], found["warc-payload-digest"].removeprefix("sha256:")
                        size = int(found["x-payload-length"])
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{entry['id']} in {archive} does not hold what its headers say")
                        refers = found.get("warc-refers-to")
                        rows.append((found.get("x-page-id"), size, digest, kind, refers[len("<urn:page:") : -1] if refers else None, found.get("warc-target-uri"), archive, entry["offset"], entry["length"]))
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, archive string, offset long, length long"
    read = archives.select("archive").repartition(max(archives.sparkSession.sparkContext.defaultParallelism * 4, 16), "archive").mapInArrow(run, schema)
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    text, long = pa.string(), pa.int64()
    kinds = (text, long, text, text, text, text, text, long, long)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "offset", "length"])


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html), normalise, and read back: a row per page as read_archives gives it."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write_archives(pages, f"{folder}/whole")
    archives = normalise(spark, f"{folder}/whole", f"{folder}/members")
    return read_archives(archives, pages.schema["page_id"].dataType.simpleString())
