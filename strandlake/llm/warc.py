"""Web archives: a dictionary-compressed WARC writer and its reader.

Each task writes its records into archives of bounded size in the shared store. For each archive a Zstandard dictionary is built from its
own records, spread over all of them, and embedded in a leading skippable frame (magic 0x184D2A5D); every record is a Zstandard
frame of its own. Payloads that an earlier page already holds become revisit records. Reading starts from
the manifest that the writer returns (one row per archive).

Defined cases: null html is an empty payload; of equal payloads of at least ``min_bytes`` bytes the smallest page_id is the response, the others
revisit it, smaller payloads are all responses; a null url is written as an empty target. A repeated page_id is written for each of its rows,
and no row revisits its own id: rows with the same id and payload are each a response where that id is the smallest. A null
page_id is written as ``urn:page:`` with no number; it revisits an equal payload of any page that has an id, and is a response where none has.
Other columns are ignored, whatever their names; pages above ``archive_size`` make an archive of their own; an empty table writes no archive. A task that runs again writes the same names anew: a file
gets its name only when it is whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_map, new_path, stage

SKIPPABLE = 0x184D2A5D
CRLF = b"\r\n"


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id)


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but states its length and digest."""
    kind = b"response" if refers_to is None else b"revisit"
    body = payload if refers_to is None else b""
    head = [
        b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + _urn(page_id), b"WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " ").encode("utf-8", "replace"),
        b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % len(payload),
    ]
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + _urn(refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
    return CRLF.join(head) + CRLF + CRLF + body + CRLF + CRLF


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of one record; raises ValueError if it is damaged."""
    head, _, rest = data.partition(CRLF + CRLF)
    first, *lines = head.split(CRLF)
    if first != b"WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:20]!r}")
    fields = {k.decode(): v.strip().decode("utf-8") for k, _, v in (x.partition(b":") for x in lines)}
    size = int(fields["Content-Length"])
    if rest[size:] != CRLF + CRLF:
        raise ValueError("the record doesn't end where its length says")
    return fields, rest[:size]


def build_dictionary(records: list[bytes], size: int = 1 << 16, sample_bytes: int = 2 << 20) -> bytes:
    """A Zstandard dictionary from records spread evenly over all of them, of ``sample_bytes`` together. Few or long records are cut into
    pieces, from which the samples are taken; empty below 16 pieces of 256 bytes."""
    total = sum(map(len, records))
    every = max(1, -(-total // sample_bytes))
    samples = records[::every]
    if len(samples) < 16:
        piece = max(256, min(4096, total // 64))
        samples = [r[k : k + piece] for r in records for k in range(0, len(r), piece)][::every]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, k=512, d=8).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:  # the samples have too little in common for a dictionary
        return b""


def archive_bytes(records: list[bytes], level: int = 3) -> bytes:
    """A whole archive: the dictionary in a skippable frame, then a frame per record."""
    raw = build_dictionary(records)
    dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(packer.compress, records)])


def read_archive(stream, at_once: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive read from its start, a frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    raw = stream.read(size)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    held = b""
    while True:
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            held = held or stream.read(at_once)
            if not held:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(frame.decompress(held))
            held = frame.unused_data
        yield parse_record(b"".join(parts))


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def payload_digest() -> Column:
    return F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to), once each, of the rows whose payload a page with a smaller id holds. The payloads themselves aren't shuffled."""
    size = F.octet_length(F.coalesce("html", F.lit("")).cast("binary"))
    own = stage(pages.select("page_id", payload_digest().alias("sha"), size.alias("size")).where(F.col("size") >= min_bytes), "warc-digests")
    first = own.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    first = stage(first.select("sha", "refers_to"), "warc-first")
    return own.join(first, "sha").where("page_id is null or page_id <> refers_to").select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_size: int = 32 << 20) -> DataFrame:
    """Write a record per page into ``folder`` (a URI all executors reach); returns the manifest: path, records, bytes.

    ``archive_size`` bounds the payload bytes of an archive, which its task holds while it builds the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        part, k, records, held = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal k, records, held
            name, data = f"part-{part:06d}-{k:04d}.warc.zst", archive_bytes(records)
            draft = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft, compression=None) as out:
                out.write(data)
            store.move(draft, f"{root}/{name}")
            found = pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([len(records)]), pa.array([len(data)])], names=["path", "records", "bytes"])
            k, records, held = k + 1, [], 0
            return found

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8")
                digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
                records.append(record_bytes(page_id, url or "", payload, digest, refers_to))
                held += len(records[-1])
                if held >= archive_size:
                    yield close()
        if records:
            yield close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    again = stage(revisits(rows, min_bytes).withColumnRenamed("page_id", "again_id"), "warc-revisits")
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (payload_digest() == F.col("sha"))  # by both: a hot payload is dealt by page
    return stage(arrow_map(rows.join(again, same, "left").select("page_id", "url", "html", "refers_to"), run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Payload and digest are checked against each other for responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(urn: str | None) -> int | None:
            number = (urn or "").rpartition(":")[2].rstrip(">")
            return int(number) if number else None

        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _open(path)
                with store.open_input_stream(at, compression=None) as stream:
                    rows, held = [], 0
                    for fields, block in read_archive(stream):
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        if kind == "response" and base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode() != digest:
                            raise ValueError(f"damaged payload in {path}")
                        rows.append((page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, kind, page(fields.get("WARC-Refers-To")), block if kind == "response" else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    tasks = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return arrow_map(manifest.select("path").repartition(max(tasks, int(manifest.count()))), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The result of the query: what the archives of all pages hold, read back."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new_path(spark, "warc"))
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(target)
    folder = re.sub("^file:/+", "file:///", store.makeQualified(target).toUri().toString())  # with its scheme, for executors
    return read_archives(write_archives(pages, folder, min_bytes)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
