"""WARC archives: writing records, and reading them back with segments put together.

Writing: one record per row. Rows with equal payloads of at least ``revisit_bytes`` share one ``response``; the others
become ``revisit`` records that name it. A block is an HTTP message whose body is in chunked transfer framing. A block of
over ``segment_bytes`` is cut: a first segment with the record's own id, then ``continuation`` records that name it as
WARC-Segment-Origin-ID, the last with WARC-Segment-Total-Length. Records are written by Spark's text writer, gzip
compressed, so any file system Spark writes to will do.

Reading: Spark's text reader cuts the files at the version line; a piece that is shorter than its Content-Length is
joined with what follows it in the file. (The writer never lets a version line occur in a block: it ends a chunk inside
it.) Continuation records are grouped by origin, ordered by segment number, checked against the total length, and the
HTTP message is parsed and its chunks joined. Records that fail a check are returned with ``error`` set, not dropped.

A record's id is made of the row's id and a number of the row, so it is its own even where ids are repeated. The table
is read twice (payloads in common, then the records), so it must give the same rows in the same order each time, as
stored tables do.

Edge cases: a null payload is empty and still a record; a null URL is left out of the header; rows with one id are rows
like others, and of equal payloads of the largest id the later row's is the response; a null id is the smallest and is
read back as null; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._shared import small, written
from larkspur.storage import fresh_path

VERSION = b"WARC/1.1\r\n"
REVISIT_BYTES = 1000
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4096
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def frame(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; no chunk holds a whole version line."""
    out, at = [], 0
    while at < len(payload):
        to = min(len(payload), at + size)
        k = payload.find(VERSION, at, to + len(VERSION) - 1)
        if k >= 0:
            to = min(to, k + 4) if k + 4 > at else to
        out.append(b"%x\r\n%s\r\n" % (to - at, payload[at:to]))
        at = to
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def unframe(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda v: re.sub(r"[\r\n]", "", str(v))
    return VERSION + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def records(name: str, uri: str | None, payload: bytes, digest: str, refers: str | None, segment: int) -> Iterator[bytes]:
    """A row's record, or its segments, each with the blank lines that end it but the last line break."""
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield _header([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Refers-To", refers), ("WARC-Profile", PROFILE), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block + b"\r\n"
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        own = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common] if k == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name)]
        number = [("WARC-Segment-Number", k)] if len(parts) > 1 else []
        total = [("WARC-Segment-Total-Length", len(block))] if 1 < len(parts) == k else []
        yield _header([*own, *number, *total, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(part))]) + part + b"\r\n"


def write(df: DataFrame, path: str, id_: str, url: str, payload: str, revisit_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes a record for each row of df into the folder path; payload is a string column."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.select(F.col(id_).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # which payloads occur more than once, and their last row: narrow, and summed before it is shuffled
    long = rows.where(F.octet_length("payload") >= revisit_bytes)
    keys = long.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    keys = written(keys.select("digest", "first"), "payloads")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for key, row, uri, data, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                again = first is not None and first["row"] != row and len(data) >= revisit_bytes
                refers = record_name(first["id"], first["row"]) if again else None
                out += records(record_name(key, row), uri, data, digest, refers, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = rows.join(small(keys), "digest", "left").select("id", "row", "url", "payload", "digest", "first")
    lines = rows.mapInArrow(lay, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def record_name(key: object, row: int) -> str:
    return f"<urn:record:{'' if key is None else key}.{row}>"


def key_of(name: Column) -> Column:
    """The id of the row whose record has this name, as text; null for a null id."""
    key = F.regexp_extract(name, r"^<urn:record:(.*)\.\d+>$", 1)
    return F.when(key != "", key)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(b":") for x in head.split(b"\r\n"))
    return {k.strip().lower().decode(errors="replace"): v.strip().decode(errors="replace") for k, _, v in pairs if k}


_RECORD = "type string, name string, origin string, uri string, digest string, refers string, number int, total long, block binary, error string"
_KEYS = ("warc-type", "warc-record-id", "warc-segment-origin-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in path, segments apart."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (fields, length, block so far)
        schema = pa.schema([("type", pa.string()), ("name", pa.string()), ("origin", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("error", pa.string())])

        def row(fields: dict, length: int, block: bytes) -> tuple:
            short = len(block) < length
            number, total = (fields.get(f"warc-segment-{k}") for k in ("number", "total-length"))
            return (*(fields.get(k) for k in _KEYS), int(number) if number else None, int(total) if total else None, block[:length], "the record is cut off" if short else None)

        for b in batches:
            out = []
            for piece in b.column(0).to_pylist():
                if held and len(held[2]) < held[1]:
                    held = (*held[:2], held[2] + VERSION + piece)
                    continue
                if held:
                    out.append(row(*held))
                    held = None
                head, sep, block = piece.partition(b"\r\n\r\n")
                if sep:
                    fields = _fields(head)
                    held = (fields, int(fields.get("content-length", "0")), block)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(*held), schema, strict=True)], schema=schema)

    return spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary")).mapInArrow(parse, _RECORD)


@F.arrow_udf(T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())]))
def _payload(blocks: pa.Array) -> pa.Array:
    out = []
    for block in blocks.to_pylist():
        if block is None:
            out.append(None)
            continue
        head, sep, body = block.partition(b"\r\n\r\n")
        try:
            if not sep:
                raise ValueError("the HTTP header is cut off")
            if _fields(head).get("transfer-encoding", "").lower() == "chunked":
                body = unframe(body)
            out.append({"payload": body, "error": None})
        except ValueError as e:
            out.append({"payload": None, "error": str(e)})
    return pa.array(out, pa.struct([("payload", pa.binary()), ("error", pa.string())]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per logical record: ``type, name, uri, digest, refers, payload, error``."""
    rows = scan(spark, path)
    part = F.struct("number", "block", "total", "type", "uri", "digest", "refers", "error")
    whole = rows.where("number IS NULL").select("type", "name", "uri", "digest", "refers", "block", "error")
    # a group is one record's segments
    cut = rows.where("number IS NOT NULL").groupBy(F.coalesce("origin", "name").alias("name")).agg(F.array_sort(F.collect_list(part)).alias("p"))
    block = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["block"]))
    cut = cut.withColumn("block", block).withColumn("head", F.element_at("p", 1))
    total = F.element_at("p", -1)["total"]
    wrong = (F.element_at("p", -1)["number"] != F.size("p")) | (F.col("head.number") != 1) | total.isNull() | (total != F.octet_length("block"))
    cut = cut.select("head.type", "name", "head.uri", "head.digest", "head.refers", "block", F.when(wrong, "segments are missing").otherwise(F.col("head.error")).alias("error"))
    every = whole.unionByName(cut)
    got = F.when(F.col("type") == "response", _payload("block"))
    every = every.withColumn("got", got)
    return every.select("type", "name", "uri", "digest", "refers", F.col("got.payload").alias("payload"), F.coalesce("error", "got.error").alias("error"))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, "page_id", "url", "html")
    size, sha1 = F.octet_length("payload").cast("long"), F.sha1("payload")
    found = written(read(spark, path).select("name", "type", "refers", size.alias("bytes"), sha1.alias("sha1")), "records")
    # a revisit's length is that of the response it names
    told = found.where("refers IS NOT NULL").select(F.col("refers").alias("name")).distinct()
    known = found.where("type = 'response'").join(told, "name", "left_semi").select(F.col("name").alias("refers"), F.col("bytes").alias("b"), F.col("sha1").alias("s"))
    out = found.join(small(written(known, "known")), "refers", "left")
    number = lambda c: key_of(F.col(c)).try_cast("long")
    return out.select(
        number("name").alias("page_id"),
        F.coalesce("bytes", "b").alias("payload_bytes"),
        F.coalesce("sha1", "s").alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers").alias("refers_to"),
    )


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id OR payload_bytes < 1000 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id AND payload_bytes >= 1000 THEN first END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""
