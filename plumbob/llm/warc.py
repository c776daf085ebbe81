"""Web archives: writing pages as records, and reassembling segmented records.

A page becomes a ``response`` record that holds an HTTP message in chunked
framing; a page whose payload another page has too becomes a ``revisit`` of it.
A long record is cut into a first segment and ``continuation`` records. Reading
groups continuations by the record they continue, puts them in the order of
their numbers, verifies the total length and takes the chunked framing off.
Archives are gzip-compressed and written and read by Spark's own sources, so they
can lie in any store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.functions.columns import ref
from plumbob.llm.common import as_long, scratch

#: Smaller payloads are never replaced by a revisit.
REVISIT_BYTES = 1000
SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 13
#: A reading task holds one compressed file.
RECORDS_PER_FILE = 20_000
#: Tasks over which pages of one payload are spread.
SALTS = 32
BATCH_BYTES = 4 << 20

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
NAMES = uuid.UUID("5c1c6b3e-6f0b-4d0f-9a55-6c1f5a6f2b11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{sha1}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; extensions and trailers are skipped."""
    parts, place = [], 0
    while True:
        end = body.index(b"\r\n", place)
        size = int(body[place:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        place = end + 2 + size
        if body[place : place + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        parts.append(body[end + 2 : place])
        place += 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def records(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, date: str, segment_bytes: int) -> Iterator[bytes]:
    """A page's records without the two line ends after each. ``keeper``: the page it revisits."""
    sha1 = hashlib.sha1(payload)
    own = record_id(page_id, sha1.hexdigest())
    about = [
        ("WARC-Record-ID", own),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha1.digest()).decode()}"),
        ("Page-ID", page_id),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if keeper is not None:
        more = [("WARC-Refers-To", record_id(keeper, sha1.hexdigest())), ("WARC-Profile", PROFILE)]
        yield _record([("WARC-Type", "revisit"), *about, *more], HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *about], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), *about, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = len(block) if n == len(parts) else None
        fields = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, f'{own}:{n}')}>"),
            ("WARC-Date", date),
            ("WARC-Segment-Origin-ID", own),
            ("WARC-Segment-Number", n),
            ("WARC-Segment-Total-Length", last),
        ]
        yield _record(fields, part)


def _build(date: str, segment_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                page_id, url, payload, keeper = (batch.column(n)[i].as_py() for n in ("page_id", "url", "payload", "keeper"))
                for r in records(page_id, url, payload, keeper, date, segment_bytes):
                    out.append(r)
                    size += len(r)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write_archive(
    pages: DataFrame,
    path: str,
    date: str = "2024-01-01T00:00:00Z",
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write one record per page, or several segments, as gzip-compressed archives below ``path``.

    Of pages with equal payloads of at least :data:`REVISIT_BYTES`, that with the
    largest id is a response and the others revisit it; a page of a null id is
    never one that others revisit. A null payload is empty; a null URL leaves its
    field out; an empty table gives archives without records.
    """
    payload = F.encode(F.coalesce(ref(html_column).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(as_long(id_column).alias("page_id"), ref(url_column).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha1("payload")))
    keepers = (
        rows.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND keeper IS NOT NULL")
        .select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(keepers, ["digest", "salt"], "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("keeper")
    )
    # A record ends with two line ends, which separate the rows of a text file.
    rows.mapInArrow(_build(date, segment_bytes), "record binary").select(F.col("record").cast("string")).write.options(
        lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=RECORDS_PER_FILE
    ).text(path)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive that comes in pieces."""
    source, held, place, ended = iter(pieces), bytearray(), 0, False

    def more() -> bool:
        nonlocal place, ended
        if place:
            del held[:place]
            place = 0
        got = next(source, None)
        ended = got is None
        held.extend(got or b"")
        return not ended

    while True:
        while (end := held.find(b"\r\n\r\n", place)) < 0:
            if not more():
                if held[place:].strip():
                    raise ValueError("a record's header is cut off")
                return
        lines = bytes(held[place:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        place = end + 4
        size = int(fields["content-length"])
        while len(held) - place < size + 4:
            if not more():
                raise ValueError("a record's block is cut off")
        yield fields, bytes(held[place : place + size])
        if held[place + size : place + size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")
        place += size + 4


def _unzipped(content: bytes) -> Iterator[bytes]:
    """Decompressed pieces of one or several gzip members."""
    while content:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(content, 1 << 20)
            content = member.unconsumed_tail
            if not piece and not content and not member.eof:
                raise ValueError("an archive is cut off")
            yield piece
        content = member.unused_data


_FIELDS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "url": "warc-target-uri",
    "digest": "warc-payload-digest",
    "page_id": "page-id",
    "refers_to": "warc-refers-to",
    "origin": "warc-segment-origin-id",
    "number": "warc-segment-number",
    "total": "warc-segment-total-length",
}
_RECORD = "record_type string, record_id string, url string, digest string, page_id bigint, refers_to string, origin string, number bigint, total bigint, block binary"
_NUMBERS = ("page_id", "number", "total")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64() if n in _NUMBERS else pa.string() for n in _FIELDS] + [pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*_FIELDS, "block"])

    for batch in batches:
        for i in range(batch.num_rows):
            rows, size = [], 0
            for fields, block in parse(_unzipped(batch.column("content")[i].as_py())):
                values = [fields.get(f) for f in _FIELDS.values()]
                rows.append((*(int(v) if n in _NUMBERS and v is not None else v for n, v in zip(_FIELDS, values)), block))
                size += len(block)
                if size >= BATCH_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``, segments apart."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_read, _RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Records with the segments of each put together: ``block`` whole, ``complete`` if it is as long as it should be.

    Only segmented records are shuffled, and a group is one record. Records
    written for repeated rows share their id; each of their segments is then
    there as often, and so is the result. A continuation without its first
    segment gives no row; a record that lacks a segment is not complete.
    """
    about = ("record_type", "record_id", "url", "digest", "page_id", "refers_to")
    whole = records.where("number IS NULL").select(*about, "block", F.lit(True).alias("complete"))
    parts = records.where("number IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    once = parts.groupBy("origin", "number").agg(
        *(F.first(c).alias(c) for c in (*about, "total", "block")), F.count(F.lit(1)).alias("copies")
    )
    first = F.col("number") == 1
    groups = once.groupBy("origin").agg(
        *(F.max(F.when(first, F.col(c))).alias(c) for c in about),
        F.max("total").alias("total"),
        F.max("number").alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(first, F.col("copies"))).alias("copies"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
    ).where("record_type IS NOT NULL")
    block = F.concat(F.lit(b""), F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["block"])))
    complete = (F.col("n") == F.col("last")) & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    joined = groups.withColumn("block", block).withColumn("complete", complete)
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return whole.union(repeated.select(*about, "block", "complete"))


def _payloads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_type", "record_id", "refers_to", "payload_bytes", "payload_digest", "complete"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            r = {n: batch.column(n)[i].as_py() for n in ("page_id", "record_type", "record_id", "refers_to", "digest", "complete", "block")}
            size = digest = None
            if r["record_type"] == "response" and r["complete"]:
                head, _, body = r["block"].partition(b"\r\n\r\n")
                body = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                size, sha1 = len(body), hashlib.sha1(body)
                digest = sha1.hexdigest()
                r["complete"] = r["digest"] is None or r["digest"] == f"sha1:{base64.b32encode(sha1.digest()).decode()}"
            rows.append((r["page_id"], r["record_type"], r["record_id"], r["refers_to"], size, digest, r["complete"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per page of the archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to, complete``.

    A revisit has the size and the digest of the payload of the response it
    refers to, and that page's id; both are null where the response is missing.
    """
    schema = "page_id bigint, record_type string, record_id string, refers_to string, payload_bytes bigint, payload_digest string, complete boolean"
    rows = reassembled(read_records(spark, path)).mapInArrow(_payloads, schema)
    target = scratch(spark, "warc-pages")
    rows.write.parquet(target)
    rows = spark.read.schema(rows.schema).parquet(target)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type")
    responses = rows.where("record_type = 'response'")
    revisits = rows.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    referred = revisits.select("refers_to").distinct().join(
        responses.groupBy(F.col("record_id").alias("refers_to")).agg(
            F.max("page_id").alias("response_page"), F.max("payload_bytes").alias("size"), F.max("payload_digest").alias("sha1")
        ),
        "refers_to",
    ).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    resolved = revisits.join(referred, ["refers_to", "salt"], "left").select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type",
        F.col("response_page").alias("refers_to"), F.col("size").isNotNull().alias("complete"),
    )
    return responses.select(*names, F.lit(None).cast("bigint").alias("refers_to"), "complete").union(resolved)


def archive_round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: :func:`read_pages`."""
    path = scratch(pages.sparkSession, "warc")
    write_archive(pages, path, **columns)
    return read_pages(pages.sparkSession, path)


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS digest FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS keeper FROM p
)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to, true AS complete
FROM k
"""
