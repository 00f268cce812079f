"""WARC archives of crawled pages through a chunked record table."""
from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, stored

CHUNK_CHARS = 65_536
READ_BYTES = 1 << 16
SMALLEST_REVISIT = 0
UNKNOWN_DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean"


def chunks(pages: DataFrame) -> DataFrame:
    """The record table (page_id, chunk, last, data) of ``pages`` (page_id, html): payloads in rows of bounded size.

    A payload is cut in one walk over it, and a row holds its chunk alone. A page's rows follow each other in one task, so
    digests can be carried from row to row. A null payload is empty; every page has at least one row.
    """
    parts = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(f"(?s).{{1,{CHUNK_CHARS}}}+"), F.lit(0))
    parts = F.when(F.length(F.coalesce("html", F.lit(""))) > 0, parts).otherwise(F.array(F.lit("")))
    others = [c for c in pages.columns if c not in ("page_id", "html")]
    cut = pages.select("page_id", *others, parts.alias("parts")).withColumn("count", F.size("parts"))
    return cut.select("page_id", *others, "count", F.posexplode("parts").alias("chunk", "part")).select(
        "page_id", *others, "chunk", (F.col("chunk") == F.col("count") - 1).alias("last"), F.encode("part", "utf-8").alias("data"))


def digests(table: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, payload_sha1) of a record table: SHA-1 in base32 and as bytes, carried over a page's
    rows."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = hashlib.sha1(), 0
        for batch in batches:
            out = []
            for page, last, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = data.as_py()
                state.update(data)
                size += len(data)
                if last:
                    out.append((page, size, base64.b32encode(state.digest()).decode(), state.digest()))
                    state, size = hashlib.sha1(), 0
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                             ["page_id", "payload_bytes", "payload_digest", "payload_sha1"])

    return table.select("page_id", "last", "data").mapInArrow(task, "page_id long, payload_bytes long, payload_digest string, payload_sha1 binary")


def record_types(found: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """``found`` with record_type and refers_to: of equal payloads of at least ``smallest`` bytes the one with the largest
    page_id is the response and the others revisit it; all smaller ones are responses.

    Tasks keep one row per payload, so a payload with a third of all pages is one row before it is shuffled.
    """
    newest = found.filter(F.col("payload_bytes") >= smallest).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("newest"))
    typed = found.join(newest, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("newest").isNotNull() & (F.col("page_id") < F.col("newest"))
    return typed.select("page_id", "payload_bytes", "payload_digest", *[c for c in found.columns if c == "payload_sha1"], F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                        F.when(revisit, F.col("newest")).alias("refers_to"))


def _header(page: int, url: str | None, kind: str, refers_to: int | None, size: int, digest: str, date: str) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%d>" % page, b"WARC-Date: " + date.encode(),
             b"WARC-Target-URI: " + (url or "").replace("\r", "").replace("\n", "").encode("utf-8", "replace"),
             b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % size]
    if refers_to is not None:
        lines += [b"WARC-Refers-To: <urn:page:%d>" % refers_to,
                  b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(b"Content-Length: %d" % (0 if refers_to is not None else size))
    return b"\r\n".join(lines) + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, date: str = UNKNOWN_DATE) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) into gzipped WARC files below ``folder`` (a shared
    path with a scheme) and return the files' paths (path).

    Payloads are digested in a first pass over the record table and written chunk by chunk in a second, so no task holds a
    whole record. A file is written under a name of its attempt and moved when it is whole; lost tasks leave no half file
    among the returned paths. Rows meet their record type by page_id and payload, so a page_id on several rows has as many
    records. ``date`` is the time of capture in the headers; the page table knows none.
    """
    spark = pages.sparkSession
    small_batches(spark, 256)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").filter("page_id is not null")
    typed = stored(record_types(digests(chunks(rows.select("page_id", "html")))).dropDuplicates(["page_id", "payload_sha1"]), "records")
    own = rows.withColumn("payload_sha1", F.unhex(F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8"))))
    table = chunks(own.join(typed, ["page_id", "payload_sha1"]).drop("payload_sha1").withColumn(
        "html", F.when(F.col("refers_to").isNull(), F.col("html"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/pages-{context.partitionId():06d}.warc.gz"
        part = f"{name}.{context.taskAttemptId()}"
        written = 0
        with system.open_output_stream(part, compression=None) as sink:
            member = None
            for batch in batches:
                for row in zip(*(c.to_pylist() if batch.schema.names[i] != "data" else c for i, c in enumerate(batch.columns))):
                    row = dict(zip(batch.schema.names, row))
                    if row["chunk"] == 0:
                        member = gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=5, mtime=0)
                        member.write(_header(row["page_id"], row["url"], row["record_type"], row["refers_to"], row["payload_bytes"],
                                             row["payload_digest"], date))
                    member.write(row["data"].as_py())
                    if row["last"]:
                        member.write(b"\r\n\r\n")
                        member.close()
                        written += 1
        if written:
            system.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"])], ["path"])
        else:
            system.delete_file(part)

    return stored(table.mapInArrow(task, "path string"), "archives")


class Reader:
    """Records of one gzipped archive, payloads in pieces of READ_BYTES."""

    def __init__(self, stream):
        self.file = gzip.GzipFile(fileobj=stream)

    def records(self) -> Iterator[tuple]:
        while (line := self.file.readline()):
            if line.strip() != VERSION:
                raise ValueError(f"no record where one should start: {line[:40]!r}")
            fields = {}
            while (line := self.file.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b":")
                fields[name.strip().lower()] = value.strip().decode("utf-8")
            length, state = int(fields[b"content-length"]), hashlib.sha1()
            left = length
            while left:
                piece = self.file.read(min(left, READ_BYTES))
                if not piece:
                    raise ValueError("archive ends inside a record")
                state.update(piece)
                left -= len(piece)
            if self.file.read(4) != b"\r\n\r\n":
                raise ValueError("record does not end where its length says")
            revisit = fields[b"warc-type"] == "revisit"
            digest, size = fields[b"warc-payload-digest"].removeprefix("sha1:"), int(fields[b"x-payload-length"])
            whole = length == 0 if revisit else length == size and base64.b32encode(state.digest()).decode() == digest
            number = [int(fields[k][10:-1]) if k in fields else None for k in (b"warc-record-id", b"warc-refers-to")]
            yield number[0], fields[b"warc-target-uri"], fields[b"warc-type"], number[1], size, digest, whole


def read_archives(paths: DataFrame) -> DataFrame:
    """The records of archives (path): page_id, url, record_type, refers_to, payload_bytes, payload_digest, verified.

    Payloads are streamed and their digests checked against the headers; a revisit has its payload's length and digest
    from its header. A file that is not whole fails the job.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = pafs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_stream(place, compression=None) as stream:
                    for record in Reader(stream).records():
                        rows.append(record)
                        if len(rows) >= 1000:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    count = max(1, paths.count())
    return paths.repartition(count, "path").mapInArrow(task, RECORDS)


def with_scheme(path: str) -> str:
    """The path as an address that every file system library reads."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


def archived(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) in the shared folder and read the archives back; see write_archives and
    read_archives.

    Null payloads count as empty, null addresses as no address; rows without page_id are left out, rows that repeat a
    page_id keep one record each; of rows with one page_id and one payload all have the same type. Other columns are ignored; an empty table gives no records.
    """
    return read_archives(write_archives(pages, with_scheme(new_path(pages.sparkSession, "warc"))))
