"""WARC archives: writing with revisits, segments and chunked framing, and reassembly on reading.

Writing. A record's block is an HTTP response whose body has chunked transfer framing. Of rows with one payload the
row with the largest page_id is a response, the others are revisits that refer to it. A block over SEGMENT characters
becomes a first segment and continuation records. Records are whole strings, written by Spark's text writer with the
record separator as its line separator, so any file system that Spark writes can hold the archives.

Reading. Files come in as binary; a parser walks each by Content-Length. Segments are grouped by the record they
belong to (WARC-Segment-Origin-ID), put in order of their numbers, checked against the total length, joined, and the
body's chunks decoded. Only segmented records are shuffled.

Defined results: a null html is an empty payload, a null url an empty target. Rows with equal page_id and payload
give a record each. A null page_id is the least. Records of other types (warcinfo, request, metadata) are skipped;
a revisit of a record that no archive holds has a null page and length. Broken archives (missing segments, wrong length or framing) raise.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_path, table

SEGMENT, CHUNK = 32_000, 4_000
RECORDS_PER_FILE = 2_000
#: Rows with payloads from this many bytes on are compared with each other.
MIN_REVISIT_BYTES = 0
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a string's SHA-1: four base-32 digits for each five hex digits."""
    h = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _pieces(text: Column, size: int) -> Column:
    """A text cut into pieces of size characters; one empty piece for an empty text."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(text, k * size + 1, F.lit(size)))
    return F.when(F.octet_length(text) <= size, F.array(text)).otherwise(many)  # bytes are no fewer than characters


def _chunked(body: Column) -> Column:
    def frame(c: Column) -> Column:
        return F.concat(F.lower(F.hex(F.octet_length(c).cast("long"))), F.lit("\r\n"), c, F.lit("\r\n"))

    chunks = F.array_join(F.transform(F.filter(_pieces(body, CHUNK), lambda c: c != ""), frame), "")
    framed = F.when(body == "", F.lit("")).when(F.octet_length(body) <= CHUNK, frame(body)).otherwise(chunks)
    return F.concat(framed, F.lit("0\r\n\r\n"))


def _id(name: Column) -> Column:
    h = F.md5(name)
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """(value): WARC records as strings, without the separator that follows each."""
    body = F.coalesce("html", F.lit(""))
    src = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"),
        body.alias("html"),
        F.octet_length(body).cast("long").alias("bytes"),
        base32_sha1(body).alias("digest"),
        F.monotonically_increasing_id().alias("row"),  # of a row of a file always the same one, also if a task runs again
    )
    latest = src.filter(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("m"))
    latest = latest.select("digest", F.col("m.page_id").alias("latest"), F.col("m.row").alias("latest_row"))
    src = src.join(latest.withColumnRenamed("digest", "d2"), (F.col("digest") == F.col("d2")) & (F.col("bytes") >= MIN_REVISIT_BYTES), "left")
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    key = lambda row: _id(F.concat_ws("|", row.cast("string"), F.col("digest")))
    kind = F.when(revisit, "revisit").otherwise("response")
    block = F.when(revisit, F.lit(_HTTP + _END)).otherwise(F.concat(F.lit(_HTTP + _END), _chunked(F.col("html"))))
    src = src.select(
        kind.alias("kind"),
        key(F.col("row")).alias("id"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), key(F.col("latest_row")))).otherwise("").alias("refers"),
        F.concat(
            F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url"),
            F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
            F.coalesce(F.concat(F.lit("\r\nX-Page: "), F.col("page_id").cast("string")), F.lit("")),
        ).alias("common"),
        block.alias("block"),
    )
    src = src.select("kind", "id", "refers", "common", F.octet_length("block").alias("total"), _pieces(F.col("block"), SEGMENT).alias("segments"))
    src = src.select("*", F.size("segments").alias("n"), F.posexplode("segments").alias("k", "part")).drop("segments")
    first, many = F.col("k") == 0, F.col("n") > 1
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(first, F.col("kind")).otherwise("continuation"),
        F.lit("\r\nWARC-Record-ID: "), F.when(first, F.col("id")).otherwise(_id(F.concat("id", F.col("k").cast("string")))),
        F.when(first, F.concat("common", "refers")).otherwise(F.concat(F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Segment-Origin-ID: "), F.col("id"))),
        F.when(many, F.concat(F.lit("\r\nWARC-Segment-Number: "), (F.col("k") + 1).cast("string"))).otherwise(""),
        F.when(many & (F.col("k") == F.col("n") - 1), F.concat(F.lit("\r\nWARC-Segment-Total-Length: "), F.col("total").cast("string"))).otherwise(""),
        F.when(first, F.lit("\r\nContent-Type: application/http; msgtype=response")).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length("part").cast("string"), F.lit(_END), F.col("part"),
    )
    return src.select(head.alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of at most RECORDS_PER_FILE records, gzipped, under path."""
    writer = records(pages).write.option("lineSep", _END).option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.option("compression", "gzip").text(path)


def _walk(data: bytes):
    """(headers, block) of each record of one archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"a record at {at} does not end where it says")
        yield headers, data[start:stop]
        at = stop + 4


_PART = "origin string, number int, total long, type string, page_id long, refers string, url string, digest string, length long, block binary, payload binary"
_PART_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
_PART_NAMES = [x.split()[0] for x in _PART.split(", ")]


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _parts(payloads: bool):
    """Rows of records; those without segments are finished here, the others keep their blocks."""
    number = lambda v: None if v is None else int(v)

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for h, block in _walk(gzip.decompress(raw.as_py())):
                    kind, digest, part = h["warc-type"], h.get("warc-payload-digest", ""), number(h.get("warc-segment-number"))
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    digest = digest[5:] if digest.startswith("sha1:") else ""
                    origin, length, payload = h.get("warc-segment-origin-id", h["warc-record-id"]), None, None
                    if part is None:
                        length, payload, digest = finished(kind, digest, block)
                        block = None
                    rows.append((origin, part, number(h.get("warc-segment-total-length")), kind, number(h.get("x-page")), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, length, block, payload if payloads else None))
                    if len(rows) >= 500:
                        yield _batch(rows, _PART_KINDS, _PART_NAMES)
                        rows = []
                yield _batch(rows, _PART_KINDS, _PART_NAMES)

    return run


def finished(kind: str, digest: str, block: bytes) -> tuple[int | None, bytes | None, str]:
    """Length, payload and digest of a whole block; a revisit has only the digest that it states."""
    if kind == "revisit":
        return None, None, digest
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body
    real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest and real != digest:
        raise ValueError("a payload's digest differs from the record's")
    return len(payload), payload, real


def unchunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing."""
    at, out = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        start = end + 2
        if not size:
            break
        if body[start + size : start + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        out.append(body[start : start + size])
        at = start + size + 2
    return b"".join(out)


def _finish(payloads: bool):
    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index
            columns = list(batch.columns)
            done = [finished("response", d.as_py(), b.as_py()) for d, b in zip(columns[place("digest")], columns[place("block")])]
            columns[place("length")] = pa.array([n for n, _, _ in done], pa.int64())
            columns[place("digest")] = pa.array([d for _, _, d in done], pa.string())
            columns[place("block")] = pa.nulls(len(done), pa.binary())
            columns[place("payload")] = pa.array([p for _, p, _ in done], pa.binary()) if payloads else pa.nulls(len(done), pa.binary())
            yield pa.RecordBatch.from_arrays(columns, _PART_NAMES)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per response and revisit record under path; payload only where payloads is set (null for revisits)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parts = cut(files.mapInArrow(_parts(payloads), _PART), "warc-parts")  # archives are parsed once
    # The segments of one record: bounded by that record's own size.
    joined = (
        parts.filter("number IS NOT NULL")
        .groupBy("origin")
        .agg(
            F.sort_array(F.collect_set(F.struct("number", "block"))).alias("s"),
            F.max("total").alias("total"),
            F.max(F.when(F.col("number") == 1, F.struct("type", "page_id", "refers", "url", "digest", "length"))).alias("h"),
        )
    )
    block = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    complete = (F.element_at("s", -1)["number"] == F.size("s")) & (F.octet_length(block) == F.col("total"))
    joined = joined.select(
        "origin", F.lit(None).cast("int").alias("number"), "total", "h.*",
        F.when(complete, block).otherwise(F.raise_error(F.concat(F.lit("segments are missing of "), F.col("origin")))).alias("block"),
        F.lit(None).cast("binary").alias("payload"),
    )
    done = parts.filter("number IS NULL").unionByName(joined.select(*_PART_NAMES).mapInArrow(_finish(payloads), _PART))
    done = done.select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "url", "payload", "origin", "refers")
    # A revisit has its page and length from the record that it refers to; that one may be in any archive.
    own = done.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    named = own.select(F.col("origin").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"))
    again = done.filter("record_type = 'revisit'").join(named, F.col("refers") == F.col("_id"), "left")
    again = again.withColumn("refers_to", F.col("_page")).withColumn("payload_bytes", F.col("_bytes"))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    return own.select(*out).unionByName(again.select(*out))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("payload")
