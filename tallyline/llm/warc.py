"""Writing pages as WARC records and reading archives back, with segmented records.

A record that is longer than a segment is written as a first record and continuation records that
name its id, number themselves from 1 and, in the last one, give the total length. Payloads are
framed as HTTP chunks. Reading groups the segments of an origin, orders them by number, checks
their number and total length and takes the chunk framing off.

Archives are written and read by Spark's text source: the end of a record is the line separator
for writing, that and the first line of the next record the one for reading. The writer ends a
chunk inside any text of a page that looks like such a boundary, so that none occurs in a block.
Each task writes one archive and reads whole ones, record by record.

Records with equal payloads of at least ``least`` bytes share one response: that with the largest
page id. The others are revisits, which carry the headers of the response but no payload. Equal
rows of that id are responses all. A page without an id is a revisit if any page with that payload
has an id; if none has, all of them are responses. Null html is an empty payload, null url an empty
target. Columns of other names are ignored. No pages make no archive files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.hashing import binary
from tallyline.sources.scratch import scratch_folder, stored

CHUNK = 1 << 14
SEGMENT = 1 << 15
VERSION = b"WARC/1.1\r\n"
RECORD_END = b"\r\n\r\n"
BOUNDARY = RECORD_END + VERSION
_LINE = VERSION.rstrip()  # its line end may come from the framing
_DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digested(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_bytes, digest`` of every page."""

    @F.arrow_udf("string")
    def digest(html: pa.Array) -> pa.Array:
        return pa.array([digest_of(x) for x in binary(html)], pa.string())

    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), digest(html).alias("digest"),
    )


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """:func:`digested` pages with ``response_id``: the page a revisit refers to, else null."""
    pages = digested(pages)
    groups = pages.where(F.col("payload_bytes") >= least).groupBy("digest").agg(
        F.max("page_id").alias("response_id"), F.count("*").alias("n")
    )
    # Stored, so that the planner can split the pages of one digest among tasks.
    shared = stored(groups.where("n > 1 and response_id is not null").select("digest", "response_id"), "responses")
    other = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return (
        pages.join(shared, "digest", "left")
        .withColumn("response_id", F.when(other, F.col("response_id")))
    )


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Archive files of all pages under ``path``, gzip-compressed."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.string())])
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(5)), binary(batch.column(5)))
            made = [record.decode() for row in rows for record in records_of(*row, segment, chunk)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], schema=schema)

    rows = planned(pages, least).select("page_id", "url", "payload_bytes", "digest", "response_id", "html")
    (
        rows.mapInArrow(records, "value string")
        .write.option("lineSep", RECORD_END.decode()).option("compression", "gzip").text(path)
    )


def header(fields: dict[str, object]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items())


def records_of(page_id, url, size, digest, response_id, payload, segment, chunk) -> Iterator[bytes]:
    """The records of a page, without the empty lines after each."""
    target = re.sub(r"[\r\n]", "", url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: %d\r\n" % size
    fields = {
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}:{digest}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    if response_id is not None:
        fields = {
            "WARC-Type": "revisit", **fields, "WARC-Profile": "identical-payload-digest",
            "WARC-Refers-To": f"<urn:page:{response_id}:{digest}>",
        }
        block = http + b"\r\n"
        yield record(fields, block)
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + b"".join(chunked(payload, chunk))
    cuts = segments(block, segment)
    if len(cuts) == 1:
        yield record({"WARC-Type": "response", **fields}, block)
        return
    yield record({"WARC-Type": "response", **fields, "WARC-Segment-Number": 1}, cuts[0])
    for number, part in enumerate(cuts[1:], 2):
        more = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"{fields['WARC-Record-ID'][:-1]}:{number}>",
            "WARC-Date": _DATE,
            "WARC-Target-URI": target,
            "WARC-Segment-Origin-ID": fields["WARC-Record-ID"],
            "WARC-Segment-Number": number,
        }
        if number == len(cuts):
            more["WARC-Segment-Total-Length"] = len(block)
        yield record(more, part)


def record(fields: dict[str, object], block: bytes) -> bytes:
    return VERSION + header({**fields, "Content-Length": len(block)}) + b"\r\n" + block


def whole_characters(data: bytes, at: int) -> int:
    """The last place up to ``at`` that is not inside a UTF-8 character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunked(payload: bytes, size: int) -> Iterator[bytes]:
    """HTTP chunks of about ``size`` bytes. No record boundary is left in or arises from them: one in
    the payload is parted before its version line, and a version line after a line end that would
    begin a chunk, right after the line end of the chunk's size, is parted from it."""
    begin = 0
    while begin < len(payload):
        end = begin + size
        if payload.startswith(b"\r\n" + _LINE, begin):
            end = begin + 2
        elif end < len(payload):
            end = max(whole_characters(payload, end), begin + 1)
            while end < len(payload) and payload[end] & 0xC0 == 0x80:
                end += 1
        looks_so = payload.find(RECORD_END + _LINE, begin, end + len(BOUNDARY))
        end = min(end, len(payload))
        if begin <= looks_so < end:
            end = min(end, looks_so + len(RECORD_END))
        yield b"%x\r\n" % (end - begin) + payload[begin:end] + b"\r\n"
        begin = end
    yield b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        part = body[line + 2 : line + 2 + size]
        if len(part) < size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        parts.append(part)
        at = line + 4 + size


def segments(block: bytes, size: int) -> list[bytes]:
    """The block in parts of about ``size`` bytes. No part but the first begins with a version line or
    a line end and one, which would look like a boundary after the record's header."""
    like_record = (_LINE, b"\r\n" + _LINE)
    parts, begin = [], 0
    while len(block) - begin > size:
        end = max(whole_characters(block, begin + size), begin + 1)
        while block[end : end + 1] and (block[end] & 0xC0 == 0x80 or block.startswith(like_record, end)):
            end += 1
        parts.append(block[begin:end])
        begin = end
    return [*parts, block[begin:]]


_PARSED = pa.schema(
    [("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("type", pa.string()),
     ("target", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary()),
     ("problem", pa.string())]
)
_PARSED_DDL = (
    "origin string, number long, total long, type string, target string, digest string, "
    "refers_to string, block binary, problem string"
)
_READ_DDL = (
    "record_id string, type string, target_uri string, payload_digest string, payload_bytes long, "
    "refers_to string, payload binary, problem string"
)


def parsed(value: bytes) -> tuple:
    """A record's origin, segment number (null: not segmented), fields and block."""
    value = value.removeprefix(VERSION)
    head, _, rest = value.partition(b"\r\n\r\n")
    fields = {
        name.strip().lower(): text.strip()
        for name, _, text in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))
    }
    length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else -1
    problem = None
    if length < 0:
        problem = "no length"
    elif len(rest) < length:
        problem = "cut off"
    number = fields.get("warc-segment-number")
    total = fields.get("warc-segment-total-length")
    return (
        fields.get("warc-segment-origin-id", fields.get("warc-record-id")),
        int(number) if (number or "").isdigit() else None,
        int(total) if (total or "").isdigit() else None,
        fields.get("warc-type"),
        fields.get("warc-target-uri"),
        fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        fields.get("warc-refers-to"),
        rest[: max(length, 0)],
        problem,
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every response and revisit of the archives, with segments put together.

    ``problem`` says what is wrong with a record; its payload is null then. Records of an archive
    that are equal, segments included, are as many rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed(value) for value in binary(batch.column(0)) if value]
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_PARSED), _PARSED)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_PARSED)

    lines = spark.read.schema("value string").option("lineSep", BOUNDARY.decode()).text(path)
    records = lines.select(F.col("value").cast("binary")).mapInArrow(parse, _PARSED_DDL)
    # A record that is not segmented is its own only segment; only segmented ones are shuffled.
    alone = records.where("number is null and type in ('response', 'revisit')").select(
        "origin", "type", "target", "digest", "refers_to", "problem",
        F.array(F.struct(F.lit(1).cast("long").alias("number"), F.octet_length("block").cast("long").alias("total"), "block")).alias("parts"),
    )
    first = F.col("number") == 1
    joined = (
        records.where("number is not null")
        .groupBy("origin")
        .agg(
            *(F.max(F.when(first, F.col(c))).alias(c) for c in ("type", "target", "digest", "refers_to")),
            F.max("problem").alias("problem"),
            # Equal records were written once each: their equal segments count once.
            F.sort_array(F.collect_set(F.struct("number", "total", "block"))).alias("parts"),
            F.count(F.when(first, 1)).alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
        .drop("copies", "copy")
    )
    return alone.unionByName(joined).mapInArrow(_assemble, _READ_DDL)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()),
         ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()),
         ("payload", pa.binary()), ("problem", pa.string())]
    )
    for batch in batches:
        rows = [assembled(**row) for row in batch.to_pylist()]
        columns = zip(*rows) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def assembled(origin, type, target, digest, refers_to, problem, parts) -> tuple:
    numbers = [part["number"] for part in parts]
    block = b"".join(part["block"] for part in parts)
    if problem is None and (type is None or numbers != [*range(1, len(numbers) + 1)]):
        problem = "segments missing"
    if problem is None and parts[-1]["total"] != len(block):
        problem = "total length"
    payload = size = None
    if problem is None:
        head, _, body = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^X-Payload-Length: (\d+)\r?$", head)
        try:
            if type == "revisit":
                size = int(length[1]) if length else None
            else:
                payload = unchunked(body) if re.search(rb"(?im)^Transfer-Encoding: chunked", head) else body
                size = len(payload)
                if digest is not None and digest_of(payload) != digest:
                    problem, payload, size = "payload digest", None, None
        except ValueError:
            problem = "chunk framing"
    return origin, type, target, digest, size, refers_to, payload, problem


def round_trip(pages: DataFrame, least: int = 0, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """What is read back of archives written of the pages, in a folder of the shared scratch."""
    path = scratch_folder(pages.sparkSession, "warc")
    write(pages, path, least, segment, chunk)
    return read(pages.sparkSession, path)
