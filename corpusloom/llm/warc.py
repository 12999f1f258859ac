"""WARC archives: gzip members written by Spark's text writer, read back as whole files, assembled into one row per capture.

Each capture is three records: a request, a response (or a revisit of one with an equal payload), and metadata. The
request and the metadata name the response in WARC-Concurrent-To; grouping by that identifier puts a capture together.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, shared_dir, text_of

CRLF = "\r\n"
#: A file is closed once it has so many bytes, compressed. One file is one value when it is read, so files stay far below
#: what a task can hold; only a single capture may be larger.
FILE_BYTES = 32 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def _record_id(kind: str, key: Column) -> Column:
    """A name-based URN of a row's own identifier and the kind of record."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), key))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column | None]], block: Column) -> Column:
    """One WARC record. A header whose value is null is left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block, F.lit(CRLF + CRLF))


def _base32_sha1(hex_sha1: Column) -> Column:
    """A SHA-1 in hex as bare upper-case base32: 5 bits a digit."""
    bits = [F.lpad(F.conv(F.substring(hex_sha1, 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)]
    value = lambda text, i: F.conv(F.substring(text, 1 + 5 * i, 5), 2, 10).cast("int")
    return F.concat(*(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), value(b, i) + 1, F.lit(1)) for b in bits for i in range(8)))


def mark_revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`rows` (_id, _row, _sha1, _bytes) plus _first: struct of _id and _row of the first row with an equal payload, null if
    it is this row. First is the smallest id, null ids being larger than any, then the smallest row identifier.

    Only identifiers and digests are shuffled for it, reduced per task first; payloads under `min_bytes` aren't compared."""
    large = F.col("_bytes") >= min_bytes
    least = F.min(F.struct(F.col("_id").isNull().alias("absent"), F.col("_id").alias("_id"), F.col("_row").alias("_row")))
    firsts = rows.where(large).groupBy(F.col("_sha1").alias("_key")).agg(least.alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    firsts = materialize(firsts.select("_key", F.struct("_least._id", "_least._row").alias("_first")))  # read from a table, both sides of the join are plain shuffles, which may split a hot key
    joined = rows.join(firsts, F.col("_sha1") == F.col("_key"), "left").drop("_key")
    return joined.withColumn("_first", F.when(large & (F.col("_first._row") != F.col("_row")), F.col("_first")))


def _into_files(rows: DataFrame, file_bytes: int) -> DataFrame:
    """(value binary): contents of files, each without its last byte: records as gzip members, captures together.

    The last byte of a gzip member is the highest of its length, zero below 16 MB, and the writer puts it after the row as
    its line end. A member of another last byte is followed by an empty one."""

    def member(data: bytes) -> bytes:
        one = zlib.compressobj(6, zlib.DEFLATED, 31)
        return one.compress(data) + one.flush()

    def close(parts: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(parts if parts[-1].endswith(b"\0") else [*parts, member(b"")])
        return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], names=["value"])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for records in batch.column(0):
                own = [member(r.as_buffer()) for r in records.values]
                parts += own
                size += sum(map(len, own))
                if size >= file_bytes:
                    yield close(parts)
                    parts, size = [], 0
        if parts:
            yield close(parts)

    return rows.mapInArrow(fill, "value binary")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: datetime | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Archive every row of `pages` below `path`: three records a row, the payload being the html in UTF-8 (null: empty).

    Every row is a capture of its own, with record ids of its own, also where ids or whole rows repeat. A null url is left
    out; line ends in a url are percent-encoded. Of a null id nothing is noted. `date`: when the pages were fetched, now by
    default. Files are gzip members, one per record, under the names that the text writer gives them.
    """
    url = F.nullif(F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(""))
    # written once: the identifiers are drawn once, and the digests aren't computed again for the join
    rows = materialize(pages.select(F.col(id_col).alias("_id"), url.alias("_url"), text_of(html_col).alias("_payload")).withColumns({"_row": F.expr("uuid()"), "_sha1": F.sha1("_payload"), "_bytes": F.octet_length("_payload")}))
    rows = mark_revisits(rows, min_bytes)
    response, first = _record_id("response", F.col("_row")), _record_id("response", F.col("_first._row"))
    digest = F.concat(F.lit("sha1:"), _base32_sha1(F.col("_sha1")))
    is_revisit = F.col("_first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF + CRLF))
    host = F.regexp_extract(F.coalesce("_url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    request = F.concat(F.lit("GET "), F.coalesce("_url", F.lit("/")), F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF))
    notes = F.coalesce(F.concat(F.lit("page-id: "), F.col("_id").cast("string"), F.lit(CRLF)), F.lit(""))
    shared = [("WARC-Date", F.lit((date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ"))), ("WARC-Target-URI", F.col("_url"))]
    records = F.array(
        _record("request", _record_id("request", F.col("_row")), [("WARC-Concurrent-To", response), *shared, ("Content-Type", F.lit("application/http; msgtype=request"))], request),
        _record(F.when(is_revisit, "revisit").otherwise("response"), response, [*shared, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(is_revisit, first)), ("WARC-Profile", F.when(is_revisit, F.lit(REVISIT_PROFILE))), ("Content-Type", F.lit("application/http; msgtype=response"))], F.when(is_revisit, http).otherwise(F.concat(http, F.col("_payload")))),
        _record("metadata", _record_id("metadata", F.col("_row")), [("WARC-Concurrent-To", response), *shared, ("Content-Type", F.lit("application/warc-fields"))], notes),
    )
    files = _into_files(rows.select(records.alias("records")), file_bytes)
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse_records(data: bytes) -> Iterator[tuple[str, dict[str, list[str]], bytes]]:
    """(type, headers by lower-case name, block) of each record, by Content-Length alone, so a block may hold anything."""
    at, end = 0, len(data)
    while at < end:
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers: dict[str, list[str]] = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers.setdefault(name.decode().strip().lower(), []).append(value.decode().strip())
        at = stop + 4 + int(headers["content-length"][0])
        if at > end:
            raise ValueError("a WARC record is cut short")
        yield headers["warc-type"][0], headers, data[stop + 4 : at]


def members(content: memoryview) -> Iterator[bytes]:
    """The gzip members of a file, decompressed one by one; the whole of a file that isn't compressed."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield bytes(content)
        return
    at, step = 0, 1 << 16
    while at < len(content):
        parts, one = [], zlib.decompressobj(31)
        while not one.eof:
            if at >= len(content):
                raise ValueError("a gzip member is cut short")
            fed = content[at : at + step]
            parts.append(one.decompress(fed))
            at += len(fed) - len(one.unused_data)
        yield b"".join(parts)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records below `path`, one row each (RECORD_SCHEMA). `payload` is what follows the HTTP head of a response,
    `payload_digest` and `payload_bytes` are taken from it; a revisit has no payload, its digest is the stated one and
    its bytes are null. `fields` holds those of a metadata block. Files may be compressed, by record or as a whole. Broken
    archives fail the job. A file is held as one value, so it must be below 2 GB. An empty folder gives no rows; records that
    repeat are repeated; a header that is missing is null, but WARC-Concurrent-To an empty array."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for kind, headers, block in (r for data in members(memoryview(content.as_buffer())) for r in parse_records(data)):
                    one = lambda name, h=headers: h.get(name, [None])[0]
                    payload = block.partition(b"\r\n\r\n")[2] if kind in ("response", "request") else None
                    digest = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
                    if kind == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if digest not in (None, found):
                            raise ValueError(f"payload of {one('warc-record-id')} doesn't match its digest")
                        digest = found
                    pairs = [x.partition(b":") for x in block.split(b"\r\n") if x] if kind == "metadata" else []
                    rows.append((kind, one("warc-record-id"), headers.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), digest, len(payload) if kind == "response" else None, [(a.decode().strip(), b.decode().strip()) for a, _, b in pairs], payload))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target_uri, response, request, metadata (structs of RECORD_SCHEMA, null where the
    archive has no such record). Records belong together if either names the other in WARC-Concurrent-To. A request or metadata
    record without a response or revisit gives no row; of several of one kind, the one with the smallest record id counts.
    Records concurrent to several responses belong to each. `records` is read three times, so give a written table; it may
    lack the payload, which the structs then lack too. An empty table gives no rows."""
    parts = {"response": ["type", "record_id", "refers_to", "payload_digest", "payload_bytes", "payload"], "request": ["record_id", "target_uri", "payload"], "metadata": ["record_id", "fields"]}
    parts = {kind: [c for c in own if c in records.columns] for kind, own in parts.items()}
    is_capture = F.col("type").isin("response", "revisit")
    captures, others = records.where(is_capture), records.where(F.col("type").isin("request", "metadata"))
    own = captures.withColumn("capture_id", F.col("record_id"))
    naming = others.withColumn("capture_id", F.explode("concurrent_to"))
    named = captures.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id"))
    rows = own.unionByName(naming).unionByName(others.join(named, "record_id"))
    part = lambda kind, held: F.min_by(F.when(held, F.struct(*parts[kind])), F.when(held, F.col("record_id"))).alias(kind)
    out = rows.groupBy("capture_id").agg(F.min_by(F.when(is_capture, F.col("target_uri")), F.when(is_capture, F.col("record_id"))).alias("target_uri"), part("response", is_capture), part("request", F.col("type") == "request"), part("metadata", F.col("type") == "metadata"))
    return out.where(F.col("response").isNotNull())


def archive_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
