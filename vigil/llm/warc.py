"""WARC archives: writing with revisits and segments, and segment reassembly on reading.

Writing: a page becomes a `response` record whose block is an HTTP message with chunked
transfer framing; blocks above `segment_bytes` are cut into a first segment and
`continuation` records, dealt over the archives like any other record.  Pages whose
payload another record already has become `revisit` records without a payload.  The
archives are gzipped files of records ended by CRLF CRLF, written by Spark.

Reading: every archive is parsed by itself.  Whole records are decoded in place;
segments are grouped by the identifier of their first segment, ordered by number,
checked against the total length that the last one states, joined and decoded.
"""
from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from ..session import checkpoint_dir
from .common import pieces, salted_lookup, sized, text_batches

CRLF = b"\r\n"
END = b"\r\n\r\n"
CHUNK = 8192
RECORD = ("record_id string, record_type string, uri string, page_id string, refers_to string, digest string, "
          "origin string, segment int, total long, block binary")


def chunked(payload: bytes) -> bytes:
    parts = []
    for at in range(0, len(payload), CHUNK):
        piece = payload[at:at + CHUNK]
        parts += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*parts, b"0", END])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(CRLF, at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != CRLF:
            return None
        out.append(body[at:at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    head, found, body = block.partition(END)
    if not found:
        return None
    if b"transfer-encoding: chunked" in head.lower():
        return dechunked(body)
    return body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record without the CRLF CRLF that ends it."""
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block


def one_line(value: str | None) -> str | None:
    """A header value must not end its line."""
    return None if value is None else " ".join(value.split())


def records_of(segment_bytes: int):
    def make(batches):
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page-row-%d' % r['row'])}>"
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", rid),
                          ("WARC-Target-URI", one_line(r["url"])), ("WARC-Date", "2024-01-01T00:00:00Z"),
                          ("WARC-Payload-Digest", "sha1:" + r["digest"])]
                page = [] if r["page_id"] is None else [("X-Page-Id", str(r["page_id"]))]
                if r["first_id"] is not None:
                    fields[0] = ("WARC-Type", "revisit")
                    more = [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                            ("X-Refers-To-Page-Id", str(r["first_id"])),
                            ("Content-Type", "application/http; msgtype=response")]
                    out.append((rid, 1, record(fields + page + more, b"HTTP/1.1 200 OK\r\n\r\n")))
                    continue
                block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                         b"Transfer-Encoding: chunked\r\n\r\n" + chunked(r["payload"]))
                kind = ("Content-Type", "application/http; msgtype=response")
                if len(block) <= segment_bytes:
                    out.append((rid, 1, record([*fields, *page, kind], block)))
                    continue
                cuts = range(0, len(block), segment_bytes)
                for n, at in enumerate(cuts, 1):
                    piece = block[at:at + segment_bytes]
                    if n == 1:
                        f = [*fields, *page, kind, ("WARC-Segment-Number", "1")]
                        out.append((rid, n, record(f, piece)))
                    else:
                        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '%s-%d' % (rid, n))}>"
                        f = [("WARC-Type", "continuation"), ("WARC-Record-ID", own),
                             ("WARC-Target-URI", one_line(r["url"])), ("WARC-Date", "2024-01-01T00:00:00Z"),
                             ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(n)),
                             ("WARC-Segment-Total-Length", str(len(block)) if n == len(cuts) else None)]
                        out.append((rid, n, record(f, piece)))
                if sum(len(x[2]) for x in out) > 1 << 23:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
    return make


def batch_of(out):
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int32()),
         pa.array([x[2] for x in out], pa.binary())], ["origin", "segment", "record"])


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Adds first_id: the largest page_id with an equal payload of `least_bytes` or more, if another page's.

    Only ids and digests are grouped and looked up, and a payload that a third of all
    pages share is dealt over many parts; pages themselves stay where they are read.
    """
    slim = pages.where(F.col("n") >= least_bytes).select("row", "page_id", "digest")
    first = (slim.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1 and first_id is not null").drop("copies"))
    again = (salted_lookup(slim, first, ["digest"])
             .where("first_id is not null and not first_id <=> page_id").select("row", "first_id"))
    return pages.join(sized(materialize(again, "revisits")), "row", "left")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, segment_bytes: int = 16384,
                   archive_bytes: int = 16 << 20) -> int:
    """Writes the pages (page_id, url, html) as gzipped WARC files into a new folder.

    Every input row becomes one record (a revisit or a response, the latter in one or
    more segments).  Null html is an empty payload; a null page_id leaves its header
    out and never is a response that others revisit.  Returns the number of archives.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = (text_batches(pages).select(F.col("page_id"), F.col("url"), payload.alias("payload"))
            .withColumn("row", F.monotonically_increasing_id())  # of the scan: the same when a task is run again
            .withColumn("n", F.octet_length("payload")).withColumn("digest", F.sha1("payload")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    archives = pieces(total, archive_bytes)
    records = revisits(rows, least_bytes).mapInArrow(
        records_of(segment_bytes), "origin string, segment int, record binary")
    # a cast keeps the bytes as they are, also where a segment ends inside a character
    (records.repartition(archives, "origin", "segment").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder))
    return archives


def parse(content: bytes):
    """(fields, block) of each record of an archive."""
    at = 0
    while at < len(content):
        head = content.find(END, at)
        if head < 0 or not content.startswith(b"WARC/", at):
            return
        fields = {}
        for line in content[at:head].split(CRLF)[1:]:
            key, _, value = line.partition(b":")
            fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        size = int(fields.get("content-length", "0"))
        yield fields, content[head + 4:head + 4 + size]
        at = head + 4 + size + len(END)


def gunzipped(content: bytes) -> bytes:
    """All members of a gzip file; other content as it is."""
    if not content.startswith(b"\x1f\x8b"):
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        content = d.unused_data
    return b"".join(out)


def parsed(batches):
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, {"segment": pa.int32(), "total": pa.int64(), "block": pa.binary()}.get(n, pa.string()))
                        for n in names])
    for b in batches:
        for content in b.column("content"):
            out, held = [], 0
            for f, block in parse(gunzipped(content.as_py())):
                number = f.get("warc-segment-number")
                rid = f.get("warc-record-id")
                out.append(dict(
                    record_id=rid, record_type=f.get("warc-type"), uri=f.get("warc-target-uri"),
                    page_id=f.get("x-page-id"), refers_to=f.get("x-refers-to-page-id"),
                    digest=f.get("warc-payload-digest", "").removeprefix("sha1:"),
                    origin=f.get("warc-segment-origin-id", rid if number else None),
                    segment=int(number) if number else None,
                    total=int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                    block=block))
                held += len(block)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)


def decoded(batches):
    """Payload size and digest of each reassembled record; parts are (number, block), total may be null."""
    for b in batches:
        sizes, digests = [], []
        for parts, total, kind in zip(b.column("parts"), b.column("total").to_pylist(),
                                      b.column("record_type").to_pylist()):
            parts = parts.as_py()
            numbers = [p["segment"] for p in parts]
            block = b"".join(p["block"] for p in parts)
            whole = numbers == [None] or (numbers == list(range(1, len(parts) + 1)) and total == len(block))
            payload = http_payload(block) if whole and kind == "response" else None
            sizes.append(None if payload is None else len(payload))
            digests.append(None if payload is None else hashlib.sha1(payload).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in ("record_id", "record_type", "uri", "page_id", "refers_to", "digest")]
            + [pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
            ["record_id", "record_type", "uri", "page_id", "refers_to", "digest", "payload_bytes", "payload_digest"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of WARC archives with their reassembled, decoded payloads.

    Returns record_id, record_type, uri, page_id, refers_to, digest (as the record states
    it), payload_bytes and payload_digest (of the decoded payload; of the record that it
    revisits for a revisit).  Both are null where segments are missing, repeated or do not
    add up to the stated total, or the transfer framing is broken.
    """
    found = (spark.read.format("binaryFile").load(folder).select("content")
             .mapInArrow(parsed, RECORD))
    kept = ["record_id", "record_type", "uri", "page_id", "refers_to", "digest"]
    part = F.struct("segment", "block")
    whole = found.where("origin is null").select(*kept, F.array(part).alias("parts"), "total")
    first = [F.max_by(c, -F.col("segment")).alias(c) for c in kept]
    cut = (found.where("origin is not null").groupBy("origin")
           .agg(*first, F.array_sort(F.collect_list(part)).alias("parts"), F.max("total").alias("total")).drop("origin"))
    out = whole.unionByName(cut).mapInArrow(
        decoded, "record_id string, record_type string, uri string, page_id string, refers_to string, "
                 "digest string, payload_bytes long, payload_digest string")
    return out


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Gives revisits the size and digest of the payload that they refer to, looked up by page and digest."""
    held = (records.where("record_type = 'response' and payload_digest is not null and page_id is not null")
            .groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"))
            .agg(F.max("payload_bytes").alias("held_bytes")))
    out = salted_lookup(records, held, ["refers_to", "digest"])
    revisit = F.col("held_bytes").isNotNull() & (F.col("record_type") == "revisit")
    return (out.withColumn("payload_bytes", F.when(revisit, F.col("held_bytes")).otherwise(F.col("payload_bytes")))
            .withColumn("payload_digest", F.when(revisit, F.col("digest")).otherwise(F.col("payload_digest")))
            .drop("held_bytes"))


def round_trip(pages: DataFrame, least_bytes: int = 1000, segment_bytes: int = 16384) -> DataFrame:
    """Writes pages as archives into the shared folder and reads them back.

    Columns of `read_archives`, page_id and refers_to as long.  One row per input row;
    repeated page_ids are records of their own.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/vigil-warc/{uuid.uuid4().hex}"
    write_archives(pages, folder, least_bytes, segment_bytes)
    back = resolve_revisits(read_archives(spark, folder))
    return (back.withColumn("page_id", F.col("page_id").cast("long"))
            .withColumn("refers_to", F.col("refers_to").cast("long")))
