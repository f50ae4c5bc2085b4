"""WARC archives: writing, reading, and assembling transactions.

Writing: each capture becomes a request, a response (or revisit) and a metadata record, tied by
WARC-Concurrent-To. Of captures with equal payloads of at least ``MIN_REVISIT`` bytes the one with the
largest id holds the payload and the others revisit it. Records are written by Spark's own text writer, a
file for each task, so any file system and any lost executor is covered by its commit protocol; a record
ends with two line breaks, which is that writer's line separator here.

Reading: archives (plain or gzip, of one member or one for each record) come in as binary files and are cut by
Content-Length, never by what a payload holds. Sizes and digests of payloads are worked out from the bytes read.
``assemble`` joins the records of a capture through their concurrent-to identifiers into one nested row, and
``per_page`` follows a revisit to the record that holds its payload.

Scale: a file holds about ``FILE_BYTES`` and at most ``FILE_LIMIT``, as a row of a binary file must. Blocks are dropped where
they are read, unless asked for; what is shuffled is the headers.

Defined results: a null payload counts as empty; a repeated row is one capture with a metadata record for
each repeat; equal ids with different payloads are captures of their own; no rows give no archive; a revisit of
a record that is nowhere has no payload (null).
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import cut, map_batches, new_path

MIN_REVISIT = 1000
#: Bytes of records in a file: about, and at most (but for a single record).
FILE_BYTES, FILE_LIMIT = 64 << 20, 1 << 30
HEADER_BYTES = 2000
#: Up to so many payload groups are broadcast when captures look up what they revisit.
BROADCAST_ROWS = 200_000
_BREAK = "\r\n"
_HEADERS = (b"warc-type", b"warc-record-id", b"warc-concurrent-to", b"warc-target-uri", b"warc-refers-to", b"warc-payload-digest", b"content-type")
RECORD = "kind string, record_id string, concurrent_to string, target_uri string, refers_to string, digest string, content_type string, block binary, payload_bytes long, payload_sha1 string"


def _record(kind: str, ident: Column, block: Column, **more: Column) -> Column:
    """A record as text: header lines, an empty line, the block. Null fields are left out."""
    names = {"concurrent_to": "WARC-Concurrent-To", "uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "digest": "WARC-Payload-Digest", "profile": "WARC-Profile", "content_type": "Content-Type"}
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit("WARC-Date: 2024-01-01T00:00:00Z")]
    lines += [F.concat(F.lit(f"{names[k]}: "), v) for k, v in more.items()]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_BREAK, *lines), F.lit(_BREAK * 2), block)


def plan_revisits(pages: DataFrame, ident: str, payload: str) -> DataFrame:
    """Add digest, length and the id that each capture revisits (null: it holds its payload)."""
    pages = pages.withColumns({"_body": F.coalesce(F.col(payload), F.lit("")), "_id": F.col(ident)})
    pages = pages.withColumns({"_digest": F.sha1(F.col("_body").cast("binary")), "_bytes": F.octet_length("_body")})
    groups = pages.where(F.col("_bytes") >= MIN_REVISIT).groupBy("_digest").agg(F.max("_id").alias("_holder"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    groups = cut(groups, "warc-groups")
    small = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = pages.join(F.broadcast(groups) if small else groups, "_digest", "left")
    return joined.withColumn("_refers", F.when(F.col("_holder") != F.col("_id"), F.col("_holder")))


def _urn(what: str, ident: Column) -> Column:
    """An identifier of id and payload, so that equal ids with other payloads stay apart."""
    return F.concat(F.lit(f"<urn:capture:{what}:"), F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":"), F.col("_digest"), F.lit(">"))


def write(pages: DataFrame, path: str, ident: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write the captures to a folder of archives."""
    planned = plan_revisits(pages, ident, payload)
    page = F.col("_id")
    uri = F.regexp_replace(F.coalesce(F.col(url), F.lit("about:blank")), r"[\r\n]", "%0A")
    head, digest = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n", F.concat(F.lit("sha1:"), F.col("_digest"))
    http = F.concat(F.lit(head + "Content-Length: "), F.col("_bytes").cast("string"), F.lit(_BREAK * 2))
    response = _record("response", _urn("response", page), F.concat(http, F.col("_body")), uri=uri, digest=digest, content_type=F.lit("application/http;msgtype=response"))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    revisit = _record("revisit", _urn("response", page), http, uri=uri, refers_to=_urn("response", F.col("_refers")), digest=digest, profile=profile, content_type=F.lit("application/http;msgtype=response"))
    request = _record("request", _urn("request", page), F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + _BREAK * 2)), concurrent_to=_urn("response", page), uri=uri, content_type=F.lit("application/http;msgtype=request"))
    fields = F.concat(F.lit("captureId: "), F.coalesce(page.cast("string"), F.lit("null")), F.lit(_BREAK + "payloadLength: "), F.col("_bytes").cast("string"), F.lit(_BREAK))
    metadata = _record("metadata", _urn("metadata", page), fields, concurrent_to=_urn("response", page), uri=uri, content_type=F.lit("application/warc-fields"))
    mean, top = planned.select(F.avg("_bytes"), F.max("_bytes")).first()
    per_file = max(3, min(FILE_BYTES // (int(mean or 0) + HEADER_BYTES), FILE_LIMIT // (int(top or 0) + HEADER_BYTES)) * 3)  # three records a page
    records = F.array(request, F.when(F.col("_refers").isNull(), response).otherwise(revisit), metadata)
    planned.select(F.explode(records).alias("value")).write.option("lineSep", _BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_records(data: bytes) -> Iterator[tuple]:
    """Records of an archive, cut by Content-Length: headers, block, and size and SHA-1 of the payload of an HTTP response."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)  # all its members
    at, size = 0, len(data)
    while at < size:
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode()
        start = end + 4
        stop = start + int(head[b"content-length"])
        get = head.get
        payload = None
        if get(b"warc-type") == "response":
            split = data.find(b"\r\n\r\n", start, stop) if (get(b"content-type") or "").startswith("application/http") else start - 4
            payload = data[split + 4 if split >= 0 else stop : stop]
        measured = (None, None) if payload is None else (len(payload), hashlib.sha1(payload).hexdigest())
        yield (*(get(k) for k in _HEADERS), data[start:stop], *measured)
        at = stop + 4


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row for each record of the archives in a folder. blocks False: HTTP blocks only up to their headers' end."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [{"block": pa.binary(), "payload_bytes": pa.int64()}.get(n, pa.string()) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for data in batch.column(0):
                for r in parse_records(data.as_py()):
                    if not blocks and (r[6] or "").startswith("application/http"):
                        r = (*r[:7], r[7][: r[7].find(b"\r\n\r\n") + 4], *r[8:])
                    rows.append(r)
                    held += len(r[7])
                    if held > 4_000_000 or len(rows) >= 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz,txt,txt.gz}").load(path).select("content")
    return map_batches(files, run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its request, response or revisit, and metadata.

    The request and metadata records name the response in WARC-Concurrent-To; the response stands for itself.
    ``metadata`` is an array: a page that came several times, unchanged, has several.
    """
    key = F.coalesce(F.col("concurrent_to"), F.col("record_id"))
    part = F.struct("record_id", "kind", "target_uri", "refers_to", "digest", "block", "payload_bytes", "payload_sha1")
    of = lambda *kinds: F.max_by(part, F.when(F.col("kind").isin(*kinds), F.col("record_id")))
    return records.groupBy(key.alias("capture")).agg(of("request").alias("request"), of("response", "revisit").alias("response"), F.collect_list(F.when(F.col("kind") == "metadata", part)).alias("metadata"))


def captures(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back as nested captures (HTTP headers only)."""
    path = new_path(spark, "warc")
    write(pages, path)
    return assemble(read(spark, path, blocks=False))


def field(block: Column, name: str) -> Column:
    """A value of a metadata block (application/warc-fields)."""
    return F.regexp_extract(block.cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)


def per_page(nested: DataFrame) -> DataFrame:
    """A row for each page that was written, from the nested captures. Sizes and digests are those of payload bytes read, for revisits of the record that they refer to."""
    of = F.coalesce(F.col("response.refers_to"), F.col("response.record_id"))
    rows = nested.select("response", of.alias("_held_in"), F.explode("metadata").alias("m"))
    held = nested.where("response.kind = 'response'").select(F.col("response.record_id").alias("_record"), F.col("response.payload_bytes").alias("_bytes"), F.col("response.payload_sha1").alias("_sha1"))
    rows = rows.join(held, F.col("_held_in") == F.col("_record"), "left")
    block, response = F.col("m.block"), F.col("response")
    revisited = F.regexp_extract(response["refers_to"], r"^<urn:capture:response:([^:]*):", 1)
    return rows.select(
        field(block, "captureId").try_cast("long").alias("page_id"),
        F.col("_bytes").alias("payload_bytes"),
        F.col("_sha1").alias("payload_digest"),
        response["kind"].alias("record_type"),
        revisited.try_cast("long").alias("refers_to"),
        response["target_uri"].alias("target_uri"),
    )
