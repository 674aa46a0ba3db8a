"""WARC archives: one gzip member a record, written with revisit records for equal payloads, and read sequentially.

Writing: of the pages with equal payloads of at least `revisit_from` bytes the one of the smallest page_id is a response,
the others are revisits of it; smaller payloads are all responses. First pages are found on digests alone; only revisits
are joined to the pages, by page_id, so a payload that a third of the pages share is no hot key; that join is the only time
that payloads are shuffled. Each task writes
archives of about `archive_bytes` under a name of its own and moves them in place when whole, so a task that runs again
replaces its own files.

Reading: the folder's archives are listed, their paths dealt out, and each task streams its archives from the store, inflated
member by member and a piece at a time, so an archive's size is no one's memory; a record's head ends at an empty line, and
Content-Length frames its block and must end where the member does. Block and payload digests are verified; a bad digest,
length or head raises an error, as does a cut member.

Defined results: null html is an empty payload; an empty payload counts as equal to others when revisit_from is 0 (the
contract's value); pages with equal page_id and payload are a response and its revisit by themselves where page_id is the
smallest (ties go by row, one response a payload); a null page_id is written as an empty identifier, read back as null,
and is the response only where no other page has the payload; null urls are empty; an empty table gives an empty archive
folder and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import new_folder

#: Fixed format.
EOL, BLANK_LINE = b"\r\n", b"\r\n\r\n"
VERSION = b"WARC/1.1"
RECORD_DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    revisit_from: int = 0
    archive_bytes: int = 16 << 20
    #: Bytes that are inflated at once.
    piece: int = 1 << 16


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    said = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(said) if said else None


def _header(value: str) -> str:
    """A header's value: no control character can end its line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record as a gzip member."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = {
        "WARC-Type": "revisit" if is_revisit else "response",
        "WARC-Record-ID": identifier(page_id),
        "WARC-Date": RECORD_DATE,
        "WARC-Target-URI": _header(url or ""),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Length": str(len(block)),
    }
    if is_revisit:
        head |= {"WARC-Refers-To": identifier(refers_to), "WARC-Profile": PROFILE}
    lines = VERSION + EOL + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + EOL
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(lines + block + BLANK_LINE) + packer.flush()


def members(stream: BinaryIO, piece: int) -> Iterator[bytes]:
    """The content of each gzip member, inflated a piece at a time."""
    held = stream.read(piece)
    while held:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not held and not (held := stream.read(piece)):
                raise ValueError("a gzip member is cut short")
            parts.append(unpacker.decompress(held))
            held = unpacker.unused_data if unpacker.eof else b""
        yield b"".join(parts)
        if not held:
            held = stream.read(piece)


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(EOL):
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse(content: bytes) -> dict:
    """A record's fields, checked: framing and digests."""
    head, blank, rest = content.partition(BLANK_LINE)
    version, _, lines = head.partition(EOL)
    if version != VERSION or not blank:
        raise ValueError(f"not a record: {content[:40]!r}")
    fields = _fields(lines)
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != BLANK_LINE:
        raise ValueError(f"record {fields.get('warc-record-id')}: its block isn't {length} bytes")
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"record {fields.get('warc-record-id')}: wrong block digest")
    http, blank, payload = block.partition(BLANK_LINE)
    said = _fields(http.partition(EOL)[2])
    if fields["warc-type"] == "response" and (fields["warc-payload-digest"] != f"sha1:{digest(payload)}" or int(said["content-length"]) != len(payload)):
        raise ValueError(f"record {fields.get('warc-record-id')}: wrong payload digest or length")
    return fields | {"http": said, "payload": payload}


def classify(pages: DataFrame, archive: Archive) -> DataFrame:
    """page_id, url, html, refers_to of each page: the first page of its payload, where it isn't that one itself.

    Rows that repeat page_id and payload come one after the other.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keys = pages.select("page_id", F.sha2(payload.cast("binary"), 256).alias("d"), F.octet_length(payload).alias("n")).where(F.col("n") >= archive.revisit_from)
    shared = keys.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1").select("d", "first")
    # one row a page and payload, so the pages meet few and narrow rows, by page
    own = keys.select("page_id", "d").distinct().join(shared, "d").select(F.col("page_id").alias("id"), "d", "first")
    joined = pages.select("page_id", "url", "html", F.sha2(payload.cast("binary"), 256).alias("d0")).join(own, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("d0") == F.col("d")), "left")
    return joined.select("page_id", "url", "html", F.col("first").alias("refers_to"), F.col("d").isNotNull().alias("shared"))


def write_archives(pages: DataFrame, folder: str, archive: Archive = Archive()) -> DataFrame:
    """Writes all pages under folder, as *.warc.gz, and returns (archive, records) of the files, once written."""
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        out, held, size, n = [], [], 0, 0
        last = None

        def close() -> None:
            nonlocal held, size, n
            name = f"{base}/part-{task.partitionId():06d}-{len(out):04d}.warc.gz"
            aside = f"{base}/_{task.taskAttemptId()}-{len(out)}.tmp"
            with store.open_output_stream(aside) as f:
                f.write(b"".join(held))
            store.move(aside, name)
            out.append((name, n))
            held, size, n = [], 0, 0

        store.create_dir(base)
        for batch in batches:
            for page_id, url, html, first, is_shared in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to", "shared")), strict=True):
                again = is_shared and last == (page_id, html or "")
                last = (page_id, html or "")
                held.append(record(page_id, url, html, first, is_shared and (page_id != first or again)))
                size, n = size + len(held[-1]), n + 1
                if size >= archive.archive_bytes:
                    close()
        if held:
            close()
        yield pa.record_batch({"archive": pa.array([x[0] for x in out], pa.string()), "records": pa.array([x[1] for x in out], pa.int64())})

    manifest = f"{folder}-manifest"
    classify(pages, archive).sortWithinPartitions("page_id", "html", "url").mapInArrow(run, "archive string, records long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_archives(spark: SparkSession, folder: str, archive: Archive = Archive()) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload of all records under folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            store, at = pyarrow.fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path))
            with store.open_input_stream(at, compression=None) as stream:
                yield from records(stream)

    def records(stream: BinaryIO) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for member in members(stream, archive.piece):
            r = parse(member)
            revisit = r["warc-type"] == "revisit"
            out.append(
                (page_of(r["warc-record-id"]), r["warc-target-uri"], r["warc-type"], int(r["http"]["content-length"]), r["warc-payload-digest"].removeprefix("sha1:"), page_of(r["warc-refers-to"]) if revisit else None, r["payload"])
            )
            size += len(r["payload"])
            if size > 4 << 20:
                yield batch_of(out)
                out, size = [], 0
        yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        return pa.record_batch([pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds.values(), strict=True)], names=list(kinds))

    sql = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    # paths and sizes only: the content is not a column that is read
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    return files.select("path").mapInArrow(run, sql)


def round_trip(pages: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """Writes the pages to a new shared folder and reads them back."""
    folder = new_folder(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    if not write_archives(pages, folder, archive).where("records > 0").head(1):
        return read_nothing(pages.sparkSession)
    return read_archives(pages.sparkSession, folder, archive)


def read_nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
