"""WARC archives: writing with segmentation and chunked framing, and reassembly when they are read back."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import materialize, shared_dir, tune

#: Bytes of a record's block in one segment; a longer block goes on in continuation records.
SEGMENT_BYTES = 32_768
#: Bytes of one chunk of the chunked transfer coding.
CHUNK_BYTES = 8_192
#: Rows of the text source in one file, so that a file fits in the memory of a task that reads it.
RECORDS_PER_FILE = 512
_VERSION = b"WARC/1.1\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer coding."""
    parts = [b"%x\r\n%s\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; chunk extensions and trailers are left out."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response: its body without transfer coding."""
    head, _, body = block.partition(b"\r\n\r\n")
    coding = [v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]) if k.strip().lower() == b"transfer-encoding"]
    return dechunked(body) if any(c.endswith(b"chunked") for c in coding) else body


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda v: str(v).replace("\r", " ").replace("\n", " ")
    return _VERSION + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None).encode("utf-8") + b"\r\n"


def records(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The WARC records of a page, each without the two line ends after it: a revisit, or a response and its continuations."""
    name = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row}/{page_id}/{digest}/{k}')}>"
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", page_id)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield _header([("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", refers_to), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http))]) + http
        return
    block = http + chunked(payload)
    count = -(-len(block) // segment_bytes)
    for k in range(count):
        part = block[k * segment_bytes : (k + 1) * segment_bytes]
        kind = [("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *common] if k == 0 else [("WARC-Type", "continuation"), ("WARC-Record-ID", name(k + 1)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name(1))]
        number = [("WARC-Segment-Number", k + 1)] if count > 1 else []
        total = [("WARC-Segment-Total-Length", len(block))] if count > 1 and k == count - 1 else []
        yield _header([*kind, *number, *total, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(part))]) + part


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = archive[end + 4 : end + 4 + size]
        if len(block) != size or archive[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = end + 8 + size


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes one WARC record (and its continuations) per row of ``page_id, url, html`` into gzipped files under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the smallest page_id is a response;
    others are revisits of it.  Rows that repeat that page_id too are responses.  Null html is the empty payload.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    repeated = rows.filter(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = rows.join(repeated.select("digest", "first"), "digest", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first")))
    marked = marked.select("page_id", F.monotonically_increasing_id().alias("row"), "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for x in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True) for r in records(*x, segment_bytes)]
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 64], pa.binary())], names=["record"])

    text = marked.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value"))
    # The text source writes the bytes as they are; what ends a line there is what ends a record.
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).mode("overwrite").text(path)


_READ = "record_id string, origin string, number int, total long, kind string, page_id long, url string, refers_to long, digest string, block binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: fields and block, as they stand in the files."""
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _READ.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer().to_pybytes()
                if data[:2] == b"\x1f\x8b":
                    parts = []
                    while data:
                        gz = zlib.decompressobj(31)
                        parts.append(gz.decompress(data))
                        data = gz.unused_data
                    data = b"".join(parts)
                out = []
                number = lambda v: None if v is None else int(v)
                for f, block in parse(data):
                    rid, origin, no = f["warc-record-id"], f.get("warc-segment-origin-id"), number(f.get("warc-segment-number"))
                    out.append((rid, origin or rid, no, number(f.get("warc-segment-total-length")), f["warc-type"], number(f.get("x-page-id")), f.get("warc-target-uri"), number(f.get("x-refers-to-page-id")), f.get("warc-payload-digest", "").removeprefix("sha256:"), block))
                    if len(out) >= 64:
                        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(read, _READ)


def reassemble(found: DataFrame) -> DataFrame:
    """Whole records: segments grouped by origin, put in order of their numbers, the total length verified.

    Only segmented records are shuffled.  A record whose segments are missing, repeated or of another total length
    than the last segment says has a null block and ``complete`` false.
    """
    whole = found.filter("number IS NULL").select("record_id", "kind", "page_id", "url", "refers_to", "digest", "block", F.lit(True).alias("complete"))
    parts = found.filter("number IS NOT NULL").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max(F.when(F.col("number") == 1, F.struct("record_id", "kind", "page_id", "url", "refers_to", "digest"))).alias("head"),
    )
    schema = "record_id string, kind string, page_id long, url string, refers_to long, digest string, block binary, complete boolean"
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segments, total, head in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = b"".join(x["block"] for x in segments)
                fine = head is not None and len(block) == total and [x["number"] for x in segments] == [*range(1, len(segments) + 1)]
                row = [*((head or {}).get(n) for n in names[:6]), block if fine else None, fine]
                yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, types, strict=True)], names=names)

    return whole.unionByName(parts.select("parts", "total", "head").mapInArrow(join, schema))


def payloads(whole: DataFrame) -> DataFrame:
    """Payload length and digest of each whole response, from the bytes read; the digest in the header must agree."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    schema = "page_id long, kind string, refers_to long, payload_bytes long, payload_digest string, url string, verified boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, kind, refers, digest, url, block in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if kind == "response" and block is not None:
                    data = http_payload(block)
                    own = hashlib.sha256(data).hexdigest()
                    out.append((page, kind, refers, len(data), own, url, own == digest))
                else:
                    out.append((page, kind, refers, None, digest, url, kind != "response"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return whole.select("page_id", "kind", "refers_to", "digest", "url", "block").mapInArrow(read, schema)


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 100, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes ``pages`` to archives, reads these back: one row per page from the records.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, verified``.  ``path`` is a folder that driver
    and executors share; by default a new one in the shared folder of the session.  Null html counts as empty; a null
    page_id is kept and its record is always a response; of rows that repeat page_id and html each is a response if
    that page_id is the smallest; an empty table gives an empty result; other columns are not looked at.
    """
    spark = pages.sparkSession
    tune(spark)
    path = path or f"{shared_dir(spark)}/webquarry/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes, segment_bytes)
    # The archives are read once: what is kept of a page is small.
    read = materialize(payloads(reassemble(read_archives(spark, path))), "payloads")
    responses = read.filter("kind = 'response'")
    revisits = read.filter("kind = 'revisit'")
    # The length of a revisit's payload is that of the response that it refers to; one row for each of those.
    origin = responses.filter("page_id IS NOT NULL").groupBy(F.col("page_id").alias("origin_id"), F.col("payload_digest").alias("origin_digest")).agg(F.max("payload_bytes").alias("origin_bytes"))
    linked = revisits.join(origin, (F.col("refers_to") == F.col("origin_id")) & (F.col("payload_digest") == F.col("origin_digest")), "left").withColumn("payload_bytes", F.col("origin_bytes")).withColumn("verified", F.col("origin_bytes").isNotNull())
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "verified"]
    return responses.select(*columns).unionByName(linked.select(*columns))
