"""WARC archives with a Zstandard dictionary in a leading skippable frame, and every record a frame of its own.

An archive file is: a skippable frame (magic 0x184D2A5D, 4 bytes of length, the dictionary), then one Zstandard frame
per WARC record, each compressed with that dictionary. Tasks write through the file system named by the target
folder's URI, first under a name of the attempt, then renamed, so that a lost task leaves no broken archive.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, fresh_path, join_by_key, small_batches, stage

#: Fixed values of the archive format.
SKIPPABLE_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
RESPONSE_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads from this many bytes on can be revisits.
REVISIT_BYTES = 100
#: Bounds of what a dictionary is trained on in each file, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, SAMPLE_RECORD_BYTES, DICTIONARY_BYTES = 400, 2 << 20, 32 << 10, 32 << 10
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:quern:warc")
_READ = 1 << 20


def mark_revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html, digest, n_bytes and refers_to: the smallest page_id with this payload, null for a response.

    Groups are summed up before the shuffle, and only payloads that occur twice are joined back, the pages of hot ones
    in parts, so a payload of any number of pages doesn't gather in one task. Rows that repeat the smallest page_id of
    a payload are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))
    groups = rows.filter(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.stage(groups.filter("n > 1"), "warc-repeated")
    joined = join_by_key(rows, repeated, "digest", "n")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id", "n")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def _clean(url: str | None, page_id: int | None) -> str:
    """A header takes one line: controls are percent-encoded; a null url becomes a urn."""
    return f"urn:page:{page_id}" if url is None else "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit holds the response's head alone."""
    block = RESPONSE_HEAD + (payload if refers_to is None else b"")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _clean(url, page_id)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Bytes", str(len(payload))),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples' own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:] or VERSION


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or ":/" in uri else posixpath.abspath(uri))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of mark_revisits, an archive per partition: path, n_records, n_bytes of every file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{context.partitionId():06d}.warc.zst"
        draft, records, held, held_bytes, packer, n = f"{name}.{context.taskAttemptId()}", _records(batches), [], 0, None, 0
        with fs.open_output_stream(draft, compression=None) as sink:

            def flush() -> zstandard.ZstdCompressor:
                raw = train_dictionary([x[:SAMPLE_RECORD_BYTES] for x in held])
                sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
                made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
                for x in held:
                    sink.write(made.compress(x))
                held.clear()
                return made

            for x in records:
                n += 1
                if packer:
                    sink.write(packer.compress(x))
                    continue
                held.append(x)
                held_bytes += len(x)
                if len(held) >= SAMPLE_RECORDS or held_bytes >= SAMPLE_BYTES:
                    packer = flush()
            if not packer:
                flush()
            size = sink.tell()
        if n:
            fs.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])
        else:
            fs.delete_file(draft)

    small_batches(marked.sparkSession, 64)
    return marked.select("page_id", "url", F.col("html").cast("binary"), "digest", "refers_to").mapInArrow(write, "path string, n_records long, n_bytes long")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            yield record(*row)


def iterate_archive(stream) -> Iterator[bytes]:
    """The records of one archive, read in pieces; only one record is held."""
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(length)))
    rest = b""
    while rest or (rest := stream.read(_READ)):
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := stream.read(_READ)):
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload."""
    head, _, block = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError("not a WARC record")
    headers = {k.decode(): v.decode() for k, _, v in (x.partition(b": ") for x in lines)}
    block = block[: int(headers["Content-Length"])]
    return headers, block[len(RESPONSE_HEAD) :]


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Rows of all records: page_id, payload_bytes, payload_digest, record_type, refers_to, url, html (null for revisits).

    A response's length and digest are taken from its payload, a revisit's from its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for raw in iterate_archive(stream):
                        h, payload = parse_record(raw)
                        whole = h["WARC-Type"] == "response"
                        digest = hashlib.sha256(payload).hexdigest() if whole else h["WARC-Payload-Digest"].removeprefix("sha256:")
                        number = lambda k: int(h[k]) if h.get(k) else None  # noqa: B023, E731
                        rows.append((number("WARC-Page-ID"), len(payload) if whole else number("WARC-Payload-Bytes"), digest, h["WARC-Type"], number("WARC-Refers-To-Page-ID"), h["WARC-Target-URI"], payload.decode() if whole else None))
                        held += len(raw)
                        if len(rows) == 64 or held > 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return files.select("path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes pages (page_id, url, html) as archives; (the written files, the folder).

    Null html is an empty payload, a null url a urn of the page; a null page_id is written as empty. Payloads under
    REVISIT_BYTES are always responses. No rows give no files. Further columns are not written.
    """
    folder, scratch = folder or fresh_path(pages.sparkSession, "warc"), Scratch(pages.sparkSession)
    files = stage(write_archives(mark_revisits(pages, scratch), folder), "warc-files")
    scratch.drop()
    return files, folder


def spread(files: DataFrame, spark: SparkSession) -> DataFrame:
    """One file a task or few."""
    tasks: int = max(1, files.count())
    by: Column = F.col("path")
    return files.repartition(min(tasks, 4096), by)


def roundtrip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read from the written archives."""
    files, folder = archive(pages)
    rows = read_archives(spread(files, pages.sparkSession), folder)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
