"""Web archives: writing, normalising and reading WARC files with Spark.

Archives and their indexes are real files in a shared folder, opened through
the file system that the folder's address names.  Tasks write under names of
their own attempt and return them as rows, so a repeated or doubled task leaves
unused files at worst; only files named in a finished table are read.

``write``      rows to archives that are each a single gzip stream, as crawlers leave them
``normalise``  each stream is inflated once; every record becomes a gzip member
               of its own, and a sidecar index says where each one begins
``read``       records are fetched by offset, so one large archive is read by many tasks
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forage.session import cut, work_path

#: Bytes of records after which a new archive begins.
ARCHIVE_BYTES = 64 << 20
#: Bytes of an archive whose records one task reads.
READ_BYTES = 8 << 20
#: Tasks of one step at most; each then takes several archives or stretches.
MOST_TASKS = 100_000
CHUNK = 1 << 18
LEVEL = 6
#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = T.StructType([T.StructField("archive", T.StringType()), T.StructField("index", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
ENTRY = T.StructType([T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to_id", T.StringType()), T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()),
])


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _field(name: str, value) -> str:
    clean = "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in str(value))
    return f"{name}: {clean}\r\n"


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header of the response, without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = "WARC/1.1\r\n" + _field("WARC-Type", "response" if refers_to is None else "revisit") + _field("WARC-Record-ID", f"<urn:page:{record_id}>")
    head += _field("WARC-Date", DATE) + (_field("WARC-Target-URI", url) if url is not None else "") + _field("WARC-Payload-Digest", f"sha256:{digest}")
    if refers_to is not None:
        head += _field("WARC-Refers-To", f"<urn:page:{refers_to}>") + _field("WARC-Profile", PROFILE)
    head += _field("Content-Type", "application/http;msgtype=response") + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def planned(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest and, where a page with a smaller id has the same payload, that page's id.

    Only digests meet in the shuffle that finds the smallest id; counting
    begins before it, so thousands of equal pages are one row per task.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    known = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    copies = known.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    joined = known.join(copies.filter("n > 1").select("digest", "first_id"), "digest", "left")
    again = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return joined.select("page_id", "url", "payload", "digest", F.when(again, F.col("first_id")).alias("refers_to"))


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[f.dataType]) for i, f in enumerate(schema.fields)], schema.names)


def _values(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch, one at a time."""
    for values in zip(*(batch.column(n) for n in names)):
        yield tuple(v.as_py() for v in values)


class _Archive:
    """A file in the shared folder that is written through gzip."""

    def __init__(self, folder: str, name: str):
        self.path = f"{folder.rstrip('/')}/{name}"
        system, place = _file_system(self.path)
        self.out = system.open_output_stream(place, compression=None)
        self.zip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.records = self.bytes = self.written = 0

    def put(self, data: bytes) -> None:
        self.bytes += len(data)
        self._send(self.zip.compress(data))

    def end_member(self) -> None:
        self._send(self.zip.flush())
        self.zip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

    def _send(self, data: bytes) -> None:
        self.written += len(data)
        self.out.write(data)

    def close(self) -> None:
        self.out.close()


def _create(folder: str) -> None:
    system, place = _file_system(folder)
    system.create_dir(place, recursive=True)


def write(plan: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the planned pages to archives of one gzip stream each; returns the table of archives."""
    ids = plan.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _create(folder)
        context, archive, n = TaskContext.get(), None, 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in _values(batch, "page_id", "url", "payload", "digest", "refers_to"):
                if archive is None:
                    archive, n = _Archive(folder, f"crawl-{context.partitionId():06d}-{context.taskAttemptId()}-{n:04d}.warc.gz"), n + 1
                archive.put(record(page_id or "", url, payload, digest, refers_to))
                archive.records += 1
                if archive.bytes >= archive_bytes:
                    archive.end_member()
                    archive.close()
                    yield _rows([(archive.path, None, archive.records, archive.written)], MANIFEST)
                    archive = None
        if archive is not None:
            archive.end_member()
            archive.close()
            yield _rows([(archive.path, None, archive.records, archive.written)], MANIFEST)

    return cut(ids.mapInArrow(run, MANIFEST), "archives")


def inflate(path: str) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in pieces of bounded size."""
    system, place = _file_system(path)
    with system.open_input_stream(place, compression=None) as source:
        engine, fresh = zlib.decompressobj(31), True
        while data := source.read(CHUNK):
            while data:
                out = engine.decompress(data, 4 * CHUNK)
                fresh = False
                if out:
                    yield out
                data = engine.unconsumed_tail
                if engine.eof:
                    data, engine, fresh = engine.unused_data, zlib.decompressobj(31), True
        if not fresh:
            out = engine.flush()
            if not engine.eof:
                raise ValueError(f"{path} ends inside a gzip member")
            if out:
                yield out


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(head, pieces of the rest) of every record in a stream; the pieces must be used up before the next record."""
    held = b""
    while True:
        while b"\r\n\r\n" not in held:
            piece = next(pieces, None)
            if piece is None:
                if held.strip():
                    raise ValueError("the archive ends inside a record's head")
                return
            held = (held + piece).lstrip(b"\r\n")
        head, held = held.split(b"\r\n\r\n", 1)
        length = int(fields_of(head)["content-length"]) + 4

        def rest() -> Iterator[bytes]:
            nonlocal held, length
            while length:
                if not held:
                    held = next(pieces, b"")
                    if not held:
                        raise ValueError("the archive ends inside a record")
                part, held = held[:length], held[length:]
                length -= len(part)
                yield part

        yield head, rest()
        for _ in rest():
            pass


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives so that every record is its own gzip member, with a sidecar index of JSON lines.

    A gzip stream can only be read from its start, so one task takes an
    archive; it holds no more than a piece of it at a time.
    """
    names = archives.select("archive").repartition(min(max(1, archives.count()), MOST_TASKS), "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _create(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for (path,) in _values(batch, "archive"):
                stem = f"{path.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{attempt}"
                out = _Archive(folder, f"{stem}.warc.gz")
                system, place = _file_system(f"{folder.rstrip('/')}/{stem}.idx")
                with system.open_output_stream(place, compression=None) as index:
                    for head, rest in records_of(inflate(path)):
                        offset = out.written
                        out.put(head + b"\r\n\r\n")
                        for piece in rest:
                            out.put(piece)
                        out.end_member()
                        out.records += 1
                        fields = fields_of(head)
                        entry = {"offset": offset, "length": out.written - offset, "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
                        index.write(json.dumps(entry).encode() + b"\n")
                out.close()
                yield _rows([(out.path, f"{folder.rstrip('/')}/{stem}.idx", out.records, out.written)], MANIFEST)

    return cut(names.mapInArrow(run, MANIFEST), "normalised")


def entries(archives: DataFrame) -> DataFrame:
    """archive, offset and length of every record, from the sidecar indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in _values(batch, "archive", "index"):
                system, place = _file_system(index)
                with system.open_input_stream(place, compression=None) as source:
                    held = b""
                    while data := source.read(CHUNK):
                        lines, _, held = (held + data).rpartition(b"\n")
                        rows = [json.loads(line) for line in lines.split(b"\n") if line]
                        yield _rows([(archive, r["offset"], r["length"]) for r in rows], ENTRY)

    return archives.select("archive", "index").mapInArrow(run, ENTRY)


def parse(member: bytes, archive: str, offset: int) -> tuple:
    """A row of ``RECORD`` from one gzip member; a payload that does not fit its digest is an error."""
    engine = zlib.decompressobj(31)
    head, _, block = engine.decompress(member, CHUNK).partition(b"\r\n\r\n")
    fields = fields_of(head)
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError(f"no HTTP header at {archive}:{offset}")
    length = int(fields_of(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response":
        seen, left, piece = hashlib.sha256(), length, payload
        while True:
            seen.update(piece[:left])
            left -= len(piece[:left])
            if left == 0 or engine.eof:
                break
            piece = engine.decompress(engine.unconsumed_tail, CHUNK)
        if left or seen.hexdigest() != digest:
            raise ValueError(f"damaged payload at {archive}:{offset}")
    name = lambda v: v.removeprefix("<urn:page:").removesuffix(">") if v else None
    return name(fields["warc-record-id"]), fields.get("warc-target-uri"), length, digest, fields["warc-type"], name(fields.get("warc-refers-to")), archive, offset


def read(archives: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """Records of normalised archives, fetched by offset and checked against their digests."""
    places = entries(archives).withColumn("stretch", F.floor(F.col("offset") / read_bytes))
    tasks = -(-(archives.agg(F.sum("bytes")).first()[0] or 1) // read_bytes)
    places = places.repartition(min(max(tasks, 2 * archives.sparkSession.sparkContext.defaultParallelism), MOST_TASKS), "archive", "stretch").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in _values(batch, "archive", "offset", "length"):
                if archive != path:
                    if source is not None:
                        source.close()
                    system, place = _file_system(archive)
                    path, source = archive, system.open_input_file(place)
                rows.append(parse(source.read_at(length, offset), archive, offset))
            yield _rows(rows, RECORD)

    return places.mapInArrow(run, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as records, normalise the archives and read them back.

    A null html is an empty payload.  Page ids that occur twice give two
    records; both are responses if they are the smallest of their payload.
    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive and offset.
    """
    raw = write(planned(pages), work_path(spark, "crawl"))
    kind = pages.schema["page_id"].dataType
    found = read(normalise(raw, work_path(spark, "warc")))
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"), "url", "archive", "offset")
