from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm import warc
from tallyline.llm.queries import op9_warc
from tests.conftest import SAMPLE

OUT = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(pages):
    """Contract rows of (page_id, html)."""
    largest: dict[str, int] = {}
    for page, html in pages:
        largest[html or ""] = max(page, largest.get(html or "", page))
    out = []
    for page, html in pages:
        body, own = (html or "").encode(), largest[html or ""]
        out.append((page, len(body), digest(body), "response" if own == page else "revisit", None if own == page else own))
    return sorted(out, key=repr)


def test_query(spark):
    rows = [tuple(r) for r in op9_warc(spark, SAMPLE).select(*OUT).collect()]
    pages = spark.read.parquet(f"{SAMPLE}/pages.parquet").select("page_id", "html").collect()
    assert sorted(rows, key=repr) == plain([tuple(r) for r in pages])


def test_odd_pages(spark):
    pick = random.Random(2)
    long = "".join(pick.choice("abc é日\r\n\t<>") for _ in range(9000))
    bodies = [
        None, "", "x", "x", "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\n" * 40, "\r\n" * 300, "\r\n\r\nWARC/1.1", long, long,
        "0\r\n\r\n", "Content-Length: 3\r\n\r\nabc", "é" * 3000,
    ]
    pages = [(k, f"http://a/{k}\r\nX: y", body, k) for k, body in enumerate(bodies)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int").repartition(3)
    found = warc.round_trip(df, segment=700, chunk=150).collect()
    assert all(r.problem is None for r in found)
    rows = []
    for r in found:
        page = int(r.record_id.split(":")[2])
        refers = int(r.refers_to.split(":")[2]) if r.refers_to else None
        rows.append((page, r.payload_bytes, r.payload_digest, r.type, refers))
        if r.type == "response":
            assert bytes(r.payload) == (bodies[page] or "").encode()
    assert sorted(rows, key=repr) == plain([(k, body) for k, body in enumerate(bodies)])


def test_repeated_rows_missing_ids_and_small_payloads(spark):
    long = "abcdefghij" * 200
    pages = [(1, long), (1, long), (None, long), (2, "tiny"), (3, "tiny"), (None, "alone")]
    df = spark.createDataFrame([(p, None, h) for p, h in pages], "page_id long, url string, html string")
    found = sorted((r.record_id.split(":")[2], r.type) for r in warc.round_trip(df, least=5, segment=300).collect())
    assert found == [("", "response"), ("", "revisit"), ("1", "response"), ("1", "response"), ("2", "response"), ("3", "response")]
    assert warc.round_trip(df.limit(0)).collect() == []


@given(st.binary(max_size=300).map(lambda b: b.decode("utf-8", "ignore").encode()), st.integers(1, 40), st.integers(1, 90))
@settings(max_examples=200, deadline=None)
def test_framing(payload, chunk, segment):
    line = warc.VERSION
    payload = b"\r\n" + line + payload + b"\r\n\r\n" + line + line + payload + b"x\r\n" + line + b"\r\n" + line
    payload += b"\r\n\r\nWARC/1.1" if chunk % 2 else b""
    framed = b"".join(warc.chunked(payload, chunk))
    assert warc.unchunked(framed) == payload and warc.BOUNDARY not in framed
    parts = warc.segments(framed, segment)
    assert b"".join(parts) == framed
    records = [warc.record({"WARC-Type": "x"}, part) for part in parts]
    assert warc.RECORD_END.join(records).split(warc.BOUNDARY) == [records[0], *(r.removeprefix(warc.VERSION) for r in records[1:])]
    for part in parts:
        part.decode()


def test_archives_are_whole_records_and_damage_is_told(spark, tmp_path):
    pages = [(k, "u", "text " * 400 + str(k)) for k in range(4)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "a"), segment=500)
    (file,) = (tmp_path / "a").glob("*.gz")
    data = gzip.decompress(file.read_bytes())
    assert data.startswith(warc.VERSION) and data.endswith(warc.RECORD_END)
    records = data.split(warc.BOUNDARY)
    assert len(records) == 4 * 5
    damaged = [r for r in records if not (b"urn:page:2:" in r and b"Segment-Number: 3" in r)]
    damaged = [r[:-40] if b"urn:page:3:" in r and b"Segment-Number: 2\r" in r else r for r in damaged]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(warc.BOUNDARY.join(damaged))
    problems = {r.record_id.split(":")[2]: (r.problem, r.payload) for r in warc.read(spark, str(tmp_path / "b")).collect()}
    assert problems["0"][0] is None and problems["1"][0] is None
    assert problems["2"] == ("segments missing", None) and problems["3"] == ("cut off", None)


@pytest.mark.parametrize("body", [b"5\r\nabc", b"zz\r\nabc\r\n0\r\n\r\n", b"", b"3\r\nabcd\r\n0\r\n\r\n"])
def test_broken_chunks(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)
