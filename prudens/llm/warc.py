"""Operator 9: WARC archives of captures, and their assembly into one nested row for each.

A capture is written as three records: request, response (or revisit of an earlier equal payload), and
metadata. Request and metadata name the response or revisit in WARC-Concurrent-To. Records are separated
by two line breaks, which are the writer's line separator, so archives are plain WARC/1.1, gzip'd whole,
written and committed by Spark. Reading parses records by Content-Length and joins those of a capture
through the concurrent-to identifiers.

Defined cases: null html is an empty payload; null url is written as an empty target; a null page_id sorts
last and stays null; of equal payloads that with the smallest page_id is the response, also for repeated
page_ids, and rows that repeat exactly share record ids and come back as often as they were written; an
empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudens.llm.common import Scratch, batch

END = "\r\n"
#: Records of an archive file at most; a file is read into memory whole.
RECORDS = 6_000
_HTTP = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}"
_PAYLOADS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("n", pa.int64()), ("digest", pa.string())])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _with_digest(batches):
    for b in batches:
        raw = b.column(2).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in raw], pa.int64()), pa.array([payload_digest(x) for x in raw])], schema=_PAYLOADS)


def _uuid(*cols: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str | Column, record_id: Column, fields: dict[str, Column], content_type: str, block: Column) -> Column:
    """Fields that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, **fields, "Content-Type": F.lit(content_type), "Content-Length": F.octet_length(block).cast("string")}
    head = F.concat_ws(END, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()])
    return F.concat(head, F.lit(END + END), block)


def write_archives(pages: DataFrame, scratch: Scratch, min_revisit_bytes: int = 0, date: str = "2025-01-01T00:00:00Z") -> str:
    """Write the archives; the folder's path."""
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
            .mapInArrow(_with_digest, "page_id long, url string, html string, n long, digest string"))
    light = rows.groupBy("page_id", "url", "n", "digest").agg(F.count(F.lit(1)).alias("copies"))
    light = scratch.write(light, "captures")
    rank = F.struct(F.col("page_id").isNull().alias("null"), "page_id", "url", "copies")
    groups = light.groupBy("n", "digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("distinct"), F.max("copies").alias("most"))
    # only payloads or rows that repeat need to be looked up
    repeated = groups.where((F.col("distinct") > 1) | (F.col("most") > 1)).select(F.col("n").alias("n0"), F.col("digest").alias("d0"), "first")
    counts = light.where(F.col("copies") > 1).select(*[F.col(c).alias(f"{c}_") for c in ("page_id", "url", "n", "digest")], "copies")
    known = rows.join(repeated, (F.col("n") == F.col("n0")) & (F.col("digest") == F.col("d0")), "left")
    known = known.join(counts, F.col("page_id").eqNullSafe(F.col("page_id_")) & (F.col("url") == F.col("url_")) & (F.col("n") == F.col("n_")) & (F.col("digest") == F.col("digest_")), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("n") >= min_revisit_bytes)
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    own = _uuid(F.lit("response"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("n"))
    original = F.when(again, _uuid(F.lit("response"), F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.col("n")))
    shared = {"WARC-Date": F.lit(date), "WARC-Target-URI": target}
    request = _record("request", _uuid(F.lit("request"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("n")), {**shared, "WARC-Concurrent-To": own},
                      "application/http;msgtype=request", F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{END}{END}")))
    response = _record(F.when(again, "revisit").otherwise("response"), own,
                       {**shared, "WARC-Payload-Digest": F.concat(F.lit("sha1:"), "digest"), "WARC-Refers-To": original,
                        "WARC-Profile": F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))},
                       "application/http;msgtype=response", F.concat(F.lit(_HTTP), F.when(again, F.lit("")).otherwise(F.col("html"))))
    metadata = _record("metadata", _uuid(F.lit("metadata"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("n")), {**shared, "WARC-Concurrent-To": own},
                       "application/warc-fields", F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(END)), F.lit("")), F.lit("copies: "), F.coalesce("copies", F.lit(1)).cast("string"), F.lit(END)))
    path = f"{scratch.path}/warc"
    (known.select(F.explode(F.array(request, response, metadata)).alias("value"))
     .write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path))
    return path


def parse(data: bytes):
    """(fields, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split(END)[1:])
        n = int(fields["Content-Length"])
        yield fields, data[end + 4:end + 4 + n]
        at = end + 4 + n + 4


_RECORDS = pa.schema([("capture", pa.string()), ("kind", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()),
                      ("page_id", pa.int64()), ("copies", pa.int64()), ("n", pa.int64()), ("payload", pa.string())])


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """One nested row for each capture: request, response (the response or revisit) and metadata."""
    def read(batches):
        for b in batches:
            for content in b.column(0):
                rows: dict[str, list] = {f.name: [] for f in _RECORDS}
                for f, block in parse(zlib.decompress(content.as_py(), 47)):
                    kind = f["WARC-Type"]
                    payload = block[block.index(b"\r\n\r\n") + 4:] if kind == "response" else None
                    about = dict(x.split(": ", 1) for x in block.decode().split(END) if x) if kind == "metadata" else {}
                    if payload is not None and f"sha1:{payload_digest(payload)}" != f["WARC-Payload-Digest"]:
                        raise ValueError(f"{f['WARC-Record-ID']}: the payload does not match its digest")
                    for k, v in (("capture", f.get("WARC-Concurrent-To", f["WARC-Record-ID"])), ("kind", kind), ("record_id", f["WARC-Record-ID"]), ("target", f.get("WARC-Target-URI")),
                                 ("refers_to", f.get("WARC-Refers-To")), ("digest", f.get("WARC-Payload-Digest", "")[5:] or None),
                                 ("page_id", int(about["page-id"]) if "page-id" in about else None), ("copies", int(about["copies"]) if about else None),
                                 ("n", None if payload is None else len(payload)), ("payload", payload.decode() if payloads and payload is not None else None)):
                        rows[k].append(v)
                yield batch(_RECORDS, **rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(read, "capture string, kind string, record_id string, target string, refers_to string, digest string, page_id long, copies long, n long, payload string")
    pick = lambda cond, *cols: F.first(F.when(cond, F.struct(*cols)), ignorenulls=True)
    return records.groupBy("capture").agg(
        pick(F.col("kind") == "request", "record_id", "target").alias("request"),
        pick(F.col("kind").isin("response", "revisit"), "record_id", "kind", "digest", "refers_to", "n", "payload").alias("response"),
        pick(F.col("kind") == "metadata", "record_id", "page_id", "copies").alias("metadata"))


def digest(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, from assembled captures."""
    rows = captures.select(F.col("metadata.page_id").alias("page_id"), F.col("metadata.copies").alias("copies"), F.col("response.record_id").alias("rid"), F.col("response.n").alias("n"),
                           F.col("response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("ref"))
    originals = rows.where(F.col("record_type") == "response").select(F.col("rid").alias("ref"), F.col("page_id").alias("refers_to"), F.col("n").alias("n_ref"))
    return (rows.join(originals, "ref", "left")
            .select("page_id", F.coalesce("n", "n_ref").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy"))
