"""WARC archives: a writer, and a reader that salvages what damaged archives still hold.

Writing.  A record is one gzip member; members follow each other in archives of about
``ARCHIVE_BYTES``.  Spark's text writer puts the bytes on any file system it knows; it ends a file
with ``PADDING`` zero bytes, which gzip tools ignore.  Of records with equal payloads of at least
``REVISIT_BYTES`` the one with the smallest id is a response, the others are revisits without
payload.  Payload digests are pre-aggregated and joined back in an equi-join that Spark may split.

Reading.  Every record must pass: the gzip checksum, the version line, the header, the content
length, the end mark, and the block and payload digests it names.  Where a check fails the reader
searches for the next place that passes, a gzip member or a version line, goes on from there, and
logs the bytes between as quarantined with the reason.  Plain and compressed records may be mixed,
and a member may hold several.  Zero bytes between members are padding.

An archive is one row of Spark's binaryFile source, so an archive must fit in a task's memory (and
in 2 GB); other archives than those written here should be cut to that size.

Defined results: a null payload is empty; a null id is larger than any id; rows that share the
smallest id of a group are all responses; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
PADDING = 4
LEVEL = 5
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_ZEROS = re.compile(rb"\0+")
_MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def planned(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, least: int = REVISIT_BYTES) -> DataFrame:
    """id, uri, payload (null for revisits), digest, n_bytes, refers_to (null for responses)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("n_bytes"))
    groups = rows.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(groups, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select("id", "uri", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "n_bytes", F.when(revisit, F.col("first")).alias("refers_to"))


def record_id(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def record(page: int | None, uri: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """The bytes of one record, uncompressed."""
    block = _HTTP % n_bytes + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if uri:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {n_bytes}", "WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest()]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _archives(archive_bytes: int):
    def of_partition(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                page, uri, payload, digest, n_bytes, refers_to = row
                held.append(member(record(page, uri, payload, digest, n_bytes, refers_to)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    return of_partition


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    rows = planned(pages, id_col, uri_col, payload_col).select("id", "uri", F.col("payload").cast("binary"), "digest", "n_bytes", "refers_to")
    archives = rows.mapInArrow(_archives(archive_bytes), "value binary")
    # a string column may hold any bytes, and the text writer writes them as they are
    archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0" * PADDING).text(path)


# ---------------------------------------------------------------- reading


@dataclass
class Record:
    offset: int  # in the archive: of the record, or of the member that holds it
    length: int
    fields: dict[str, str]
    payload: bytes


class Damaged(Exception):
    """A check failed; its text says which."""


def _matches(spec: str, data: bytes) -> bool:
    """Whether a digest field holds for the data; unknown algorithms are not judged."""
    name, _, value = spec.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return True
    digest = hashlib.new(name.lower(), data).digest()
    return value.lower() == digest.hex() or value.upper() == base64.b32encode(digest).decode()


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(fields, payload, end) of the record whose version line is at ``at``."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    fields: dict[str, str] = {}
    line = version.end()
    # Line by line, so a header may be as long as the data, and one without end is left at the next version line.
    while (stop := data.find(b"\r\n", line)) != line:
        if stop < 0:
            raise Damaged("header without end")
        name, colon, value = data[line:stop].partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
        line = stop + 2
    if not MANDATORY <= fields.keys():
        raise Damaged("mandatory field missing")
    size = fields["content-length"]
    if not size.isdigit():
        raise Damaged("no content length")
    begin, end = stop + 2, stop + 2 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no end mark where the content length says")
    block = data[begin:end]
    if "warc-block-digest" in fields and not _matches(fields["warc-block-digest"], block):
        raise Damaged("block digest differs")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields and not _matches(fields["warc-payload-digest"], payload):
        raise Damaged("payload digest differs")
    return fields, payload, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(memoryview(data)[at:]) + z.flush()
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    if not z.eof:
        raise Damaged("gzip: member without end")
    return out, len(data) - len(z.unused_data)


def _next_start(data: bytes, at: int) -> int:
    """The next place that looks like a member or a version line, else the end."""
    gz = data.find(_MAGIC, at)
    version = _VERSION.search(data, at)
    return min(gz if gz >= 0 else len(data), version.start() if version else len(data))


def _one(data: bytes, at: int, records: list[Record], gaps: list[tuple[int, int, str]]) -> int:
    """Read what starts at ``at``: a record, or a member with its records.  Returns its end."""
    if data.startswith(_MAGIC, at):
        inside, end = _inflate(data, at)
        found: list[Record] = []
        lost: list[tuple[int, int, str]] = []
        _scan(inside, found, lost, plain=True)
        if not found and inside.strip(b"\r\n\0"):
            raise Damaged(lost[0][2] if lost else "member without record")
        records += [Record(at, end - at, r.fields, r.payload) for r in found]
        gaps += [(at, end, f"inside member: {why}") for _, _, why in lost]
        return end
    fields, payload, end = parse_record(data, at)
    records.append(Record(at, end - at, fields, payload))
    return end


def _scan(data: bytes, records: list[Record], gaps: list[tuple[int, int, str]], plain: bool = False) -> None:
    at, size = 0, len(data)
    while at < size:
        if data[at] == 0 and not plain:  # padding between members
            at = _ZEROS.match(data, at).end()
            continue
        start, why = at, None
        while at < size:
            try:
                end = _one(data, at, records, gaps)
                break
            except Damaged as e:
                why = why or str(e)
                at = _next_start(data, at + 1)
        else:
            end = size
        if at > start:
            gaps.append((start, at, why or "no record"))
        at = end


def salvage(data: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """All records of an archive that pass their checks, and the quarantined gaps (begin, end, why)."""
    records: list[Record] = []
    gaps: list[tuple[int, int, str]] = []
    _scan(data, records, gaps)
    return records, gaps


SALVAGED = "kind string, archive string, begin bigint, length bigint, reason string, record_type string, page_id bigint, uri string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
_NAMES = [c.split()[0] for c in SALVAGED.split(", ")]


def _read(with_payload: bool):
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def of_partition(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                records, gaps = salvage(content)
                rows = [("gap", name, a, b - a, why, None, None, None, None, None, None, None) for a, b, why in gaps]
                for r in records:
                    f, kind = r.fields, r.fields.get("warc-type")
                    revisit = kind == "revisit"
                    digest = f.get("warc-payload-digest", "").rpartition(":")[2] if revisit else hashlib.sha256(r.payload).hexdigest()
                    length = f.get("warc-payload-length", "") if revisit else str(len(r.payload))
                    rows.append(("record", name, r.offset, r.length, None, kind, _page(f.get("warc-record-id")), f.get("warc-target-uri"), _page(f.get("warc-refers-to")), digest, int(length) if length.isdigit() else None, r.payload if with_payload else None))
                for i in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1000]), types)], _NAMES)

    return of_partition


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, glob: str = "part-*") -> DataFrame:
    """Rows of kind "record", and one of kind "gap" for each quarantined run of bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), SALVAGED)
