"""WARC round trips."""

import base64
import gzip
import hashlib
import io
import time

import pytest

from lorekeep.llm.warc import from_chunks, op6_warc, page_records, page_summary, parse_records, read_warc, to_chunks, write_warc


def want(rows):
    first, out = {}, []
    for i, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for i, html in rows:
        raw = (html or "").encode()
        again = i is not None and first[html or ""] < i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def test_query_round_trip(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert sorted(map(tuple, op6_warc(spark, sf).collect()), key=str) == want(rows)


def test_odd_rows(spark):
    rows = [(9, "same"), (3, "same"), (5, None), (4, ""), (7, "é" * 50_000), (8, "é" * 50_000), (None, "same"), (None, "x"), (3, "same"), (6, "same"), (3, "other")]
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://h/{i} \n", h, 1) for i, h in rows], "page_id long, url string, html string, origin long").repartition(3)
    files = write_warc(pages, segment=1000)
    back = read_warc(files)
    assert sorted(map(tuple, page_summary(back).collect()), key=str) == want(rows)
    assert {bytes(r.payload).decode() for r in back.where("payload IS NOT NULL").collect()} == {h or "" for _, h in rows}
    assert page_summary(read_warc(write_warc(pages.limit(0)))).count() == 0


def test_segments_and_framing():
    assert from_chunks(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc" and from_chunks(to_chunks(b"z" * 20_000)) == b"z" * 20_000
    with pytest.raises(ValueError):
        from_chunks(b"5\r\nabc")
    raw = b"".join(page_records("1.0", "http://x", b"p" * 5000, None, 512))
    parse = lambda raw: list(parse_records(io.BytesIO(raw)))
    parsed = parse(raw)
    assert [h.get("warc-segment-number") for h, _ in parsed] == [str(i) for i in range(1, len(parsed) + 1)]
    assert int(parsed[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in parsed)
    assert parse(gzip.compress(raw)) == parsed == parse(b"".join(gzip.compress(r) for r in page_records("1.0", "http://x", b"p" * 5000, None, 512)))
    for bad in (raw[:-9], raw[:20], gzip.compress(raw)[:-9], b"HTTP/1.1 200 OK\r\n\r\n", b"WARC/1.1" + b"x" * (2 << 20)):
        with pytest.raises(ValueError):
            parse(bad)
    assert parse(b"") == []


def test_a_large_file_is_read_in_linear_time():
    member = b"".join(gzip.compress(r) for r in page_records("1.0", "http://x", bytes(range(256)) * 40, None, 4_096))
    start = time.perf_counter()
    found = sum(len(b) for _, b in parse_records(io.BytesIO(member * 20_000)))  # some 18 MB of 60,000 members
    assert found > 200_000_000 and time.perf_counter() - start < 60


def test_revisits_from_a_least_size(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "longer"), (4, "u", "longer")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in page_summary(read_warc(write_warc(pages, min_payload=4))).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_a_lost_segment_fails(spark, tmp_path):
    records = list(page_records("1.0", "http://x", b"p" * 5000, None, 512))
    (tmp_path / "a.warc").write_bytes(b"".join(records[::2]))
    (tmp_path / "b.warc").write_bytes(b"".join(records[1::2]))
    files = lambda *names: spark.createDataFrame([(f"file://{tmp_path}/{n}", 1) for n in names], "path string, records long")
    assert bytes(read_warc(files("b.warc", "a.warc")).first().payload) == b"p" * 5000
    with pytest.raises(Exception, match="segments do not fit"):
        read_warc(files("a.warc")).collect()
