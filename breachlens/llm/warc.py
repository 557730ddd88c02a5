"""WARC archives with revisit records in place of repeated payloads.

``write_archives`` takes records (page id, url, payload), shuffles their headers by payload digest, and writes one
record for each with a fresh header: of the records with equal payloads of ``LEAST`` bytes or more, the one of largest
page id is the ``response``, the others are ``revisit`` records that name it; shorter payloads are always responses.
``read_archives`` reads the files back by the lengths in their headers, and ``resolved`` joins revisits to the original
responses by digest, which gives every record the bytes and digest of its full payload. What is read and resolved can be
written again, so archives of several crawls become one deduplicated set.

Archives are WARC/1.1, one gzip member a record. Spark's text writer puts a member a line; the last byte of a member is
the highest of its length, zero below 16 MB, and that zero byte is the line separator, so the files are plain sequences
of members (a longer record is followed by an empty member, whose last byte is zero). Records are dealt by number
to files of about ``ARCHIVE_BYTES`` of payload; reading holds one compressed file and one record in a task. Payloads are
shuffled once, on their way to their archive; decisions are made on headers. Digests that many records share are
counted by partial aggregates and joined with a salt.

Defined cases: null html is empty; null urls and page ids have no header field and come back as null, a null page id is
the smallest; records of equal page id and payload are told apart by their row number, so one of them is the response;
line breaks and other control characters in urls are percent-encoded; a payload may hold anything, record heads too; a
revisit whose response is in none of the archives read keeps its own digest, without bytes and reference; an empty table
gives archives without records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import zlib
from datetime import UTC, datetime
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breachlens.llm.arrow_text import bounded_batches
from breachlens.llm.rows import Tables

LEAST = 1000                    # bytes of the shortest payload that is written once
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 4 << 20            # of payloads in a batch that is read
STEP = 1 << 14                  # compressed bytes that are taken at a time
LEVEL = 3                       # of compression
SALTS = 16
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = ("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8")


def from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records (page_id, url, payload, payload_bytes, payload_digest) of a table of pages."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    return own.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))


# ── writing ──────────────────────────────────────────────────────────────────

def decided(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """r, record_type, refers_to (page id) and refers_r of headers (r, page_id, payload_bytes, payload_digest, held).

    ``held`` tells whether the record brings its payload: only such a record can be the response."""
    long = headers.where(F.col("payload_bytes") >= least)
    chosen = (long.groupBy("payload_digest").agg(F.max(F.struct("held", "page_id", "r")).alias("o"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select(F.col("payload_digest").alias("_digest"), "o",
                                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")))
    salt = F.pmod(F.xxhash64("r"), F.lit(SALTS)).cast("int")
    met = headers.withColumn("salt", salt).join(chosen, (F.col("payload_bytes") >= least) & (F.col("salt") == F.col("_salt")) & (
        F.col("payload_digest") == F.col("_digest")), "left")
    again = F.col("o").isNotNull() & (F.col("r") != F.col("o.r"))
    return met.select("r", F.when(again, "revisit").otherwise("response").alias("record_type"),
                      F.when(again, F.col("o.page_id")).alias("refers_to"), F.when(again, F.col("o.r")).alias("refers_r"))


def _base32(digest: Column) -> Column:
    """Hexadecimal as base 32, five bytes at a time."""
    part = lambda k: F.translate(F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0"),
                                 "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[part(k) for k in (1, 11, 21, 31)])


def _record_id(r: Column, job: str) -> Column:
    name = F.md5(F.concat_ws(":", F.lit(job), r.cast("string")))
    cut = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise(F.lit(""))


def _uri(url: Column) -> Column:
    """A url without control characters: a header field is one line."""
    safe = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x01-\x1F\x7F]$"), F.concat(
        F.lit("%"), F.lpad(F.hex(F.encode(c, "UTF-8")), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x01-\x1F\x7F]"), F.array_join(safe, "")).otherwise(url)


def _record(job: str, date: str) -> Column:
    """The record of a row, without the separator after it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(END.join(_HTTP) + END + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("payload", F.lit(""))))
    return F.concat(
        F.lit(f"WARC/1.1{END}"), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", _record_id(F.col("r"), job)),
        _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", _uri(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("payload_digest")))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_r"), job))),
        _field("Page-ID", F.url_encode(F.col("page_id").cast("string"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block)


def _members(batches):
    """Every record with its separator as a gzip member, without the zero byte at its end."""
    empty = gzip.compress(b"", mtime=0)
    for batch in batches:
        out = []
        for value in batch.column(0):
            member = gzip.compress(value.as_buffer().to_pybytes() + b"\r\n\r\n", LEVEL, mtime=0)
            out.append((member if member[-1] == 0 else member + empty)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_archives(records: DataFrame, path: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES,
                   date: str | None = None) -> str:
    """Write records (page_id, url, payload, payload_bytes, payload_digest) as deduplicated archives into a folder."""
    tables = Tables(records.sparkSession, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    numbered = tables.put(records.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                                         F.monotonically_increasing_id().alias("r")), compression="zstd")
    headers = numbered.select("r", "page_id", "payload_bytes", "payload_digest", F.col("payload").isNotNull().alias("held"))
    types = tables.put(decided(headers, least))
    size = numbered.agg(F.sum("payload_bytes")).first()[0] or 0
    files = 1 + size // archive_bytes
    typed = numbered.repartition(files, "r").join(types.repartition(files, "r"), "r")
    made = typed.select(_record(tables.base, date).cast("binary").alias("value"))
    members = bounded_batches(made).mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    return path


# ── reading ──────────────────────────────────────────────────────────────────

_FIELDS = ("record_type", "record_id", "page_id", "url", "refers_to_id", "digest", "payload")
_READ = "archive string, " + ", ".join(f"{c} string" for c in _FIELDS[:-1]) + ", payload binary"


def records_in(archive: bytes):
    """The records of an archive, one after another: header fields and the bytes of the block."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        member, end, parts = zlib.decompressobj(wbits=31), at, []
        while not member.eof:       # in steps, as what follows a member is copied
            if end >= len(archive):
                raise ValueError(f"the archive ends within the record at byte {at}")
            parts.append(member.decompress(view[end:end + STEP]))
            end = min(len(archive), end + STEP)
        record, following = b"".join(parts), end - len(member.unused_data)
        if record:
            head = record.find(b"\r\n\r\n")
            lines = record[:head].split(b"\r\n") if head >= 0 else [b""]
            if not lines[0].startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            fields = {k.strip().lower().decode(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
            end = head + 4 + int(fields["content-length"])
            if record[end:] != b"\r\n\r\n":
                raise ValueError(f"the record at byte {at} has another length than its header says")
            yield fields, record[head + 4:end]
        at = following


def _read_record(fields: dict, block: bytes) -> tuple:
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    digest, page = text("warc-payload-digest"), text("page-id")
    kind = text("warc-type")
    if digest is not None:
        digest = base64.b32decode(digest.partition(":")[2]).hex()
    payload = None if kind == "revisit" else block[block.index(b"\r\n\r\n") + 4:]
    return (kind, text("warc-record-id"), None if page is None else unquote_plus(page), text("warc-target-uri"),
            text("warc-refers-to"), digest, payload)


def read_archives(spark: SparkSession, path: str, page_id_type: str = "string") -> DataFrame:
    """The response and revisit records of all archives in a folder: archive, record_type, record_id, page_id, url,
    refers_to_id, digest (as written) and payload (null for revisits)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for fields, block in records_in(content.as_buffer().to_pybytes()):
                    rows.append(_read_record(fields, block))
                    size += len(block)
                    if size >= READ_BYTES:
                        yield made(name, rows)
                        rows, size = [], 0
                if rows:
                    yield made(name, rows)

    def made(name, rows):
        kinds = [pa.string()] * (len(_FIELDS) - 1) + [pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *columns], names=["archive", *_FIELDS])

    read = bounded_batches(files).mapInArrow(run, _READ).where(F.col("record_type").isin("response", "revisit"))
    return read.withColumn("page_id", F.col("page_id").cast(page_id_type))


def resolved(records: DataFrame, payloads: bool = False) -> DataFrame:
    """Records read from archives as page_id, url, payload_bytes, payload_digest, record_type, refers_to: bytes and
    digest of the full payload, which a revisit has from its original response. With ``payloads``, responses keep theirs."""
    tables = Tables(records.sparkSession, "warc-read")
    own = F.col("payload").isNotNull()
    kept = F.col("payload").cast("string") if payloads else F.lit(None).cast("string")
    df = tables.put(records.select(
        "page_id", "url", "record_type", kept.alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.monotonically_increasing_id().alias("r")))
    responses, revisits = df.where("record_type = 'response'"), df.where("record_type = 'revisit'")
    named = revisits.select("payload_digest").distinct()
    originals = (responses.select("payload_digest", "page_id", F.col("payload_bytes").alias("bytes"))
                 .join(named, "payload_digest", "left_semi").groupBy("payload_digest")
                 .agg(F.max(F.struct("page_id", "bytes")).alias("o"))
                 .select("payload_digest", "o", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salt = F.pmod(F.xxhash64("r"), F.lit(SALTS)).cast("int").alias("salt")
    found = revisits.select("*", salt).join(originals, ["payload_digest", "salt"], "left")
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type"]
    none = F.lit(None).cast(records.schema["page_id"].dataType).alias("refers_to")
    return responses.select(*columns, none).union(found.select(
        "page_id", "url", "payload", F.col("o.bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("o.page_id").alias("refers_to")))


__all__ = ["from_pages", "decided", "write_archives", "records_in", "read_archives", "resolved", "LEAST"]
