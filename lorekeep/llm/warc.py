"""WARC archives: writing pages as responses, revisits and segments, and reading them back.

Writing: each payload is an HTTP response in chunked transfer framing. A block longer than a segment is cut into a first
record and continuation records that name its id as their origin; the last has the total length. A payload that an
earlier page had becomes a revisit record that names that page's record. Each record is its own gzip member.

Reading: records are parsed file by file. Whole records are decoded where they are read; segments are grouped by the
origin's id across files, put in order of their number, checked for gaps and against the total length, and decoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded, materialize, new_path, read, slices

CHUNK = 8_192  # bytes of a chunk of the transfer framing
SEGMENT = 32_768  # bytes of a record's block
FILE = 64 << 20  # bytes of a file after which the next begins
DATE = "2026-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_chunks(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def from_chunks(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken or cut off. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The decoded payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(h.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for h in head.split(b"\r\n")[1:])
    return from_chunks(body) if chunked else body


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_records(name: str, url: str, payload: bytes, refers_to: str | None, segment: int) -> Iterator[bytes]:
    """The records of a page; name is the part of its record id that others can know."""
    url = "".join(c for c in url if c.isprintable() and c != " ")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url or "about:blank"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is not None:
        more = [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", str(len(payload)))]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), *common, *more], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + to_chunks(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), *common]
    if len(block) <= segment:
        yield record(head, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record([*head, ("WARC-Segment-Number", "1")], parts[0])
    for i, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}:{i}>"), *common[:2], ("WARC-Segment-Origin-ID", f"<urn:page:{name}>"), ("WARC-Segment-Number", str(i)), *total], part)


READ = 1 << 16  # bytes read at a time
HEAD = 1 << 20  # most bytes of a record's headers


def _members(stream) -> Iterator[bytes]:
    """The bytes of a file of gzip members, or of a plain one, piece by piece."""
    raw = stream.read(READ)
    packed = raw[:2] == b"\x1f\x8b"
    while raw and not packed:
        yield raw
        raw = stream.read(READ)
    while raw:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not raw:
                raise ValueError("a record is cut off")
            yield z.decompress(raw)
            raw = z.unused_data if z.eof else stream.read(READ)
        raw = raw or stream.read(READ)


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file open for reading, of gzip members or plain records; names of headers in
    lower case. Held are one record and what was read with it."""
    pieces, held, seen = _members(stream), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not held.startswith(b"WARC/"[: len(held)]) or len(held) > HEAD:
                raise ValueError("no record where one should begin")
            if not more():
                if held:
                    raise ValueError("a record is cut off")
                return
        if not held.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        while len(held) < stop + 4:
            if not more():
                raise ValueError("a record is cut off")
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        block = bytes(held[start:stop])
        del held[: stop + 4]
        seen = 0
        yield headers, block


def _writer(folder: str, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, handle, size, name, count = TaskContext.get().partitionId(), None, 0, "", 0

        def close() -> pa.RecordBatch:
            handle.close()
            return pa.RecordBatch.from_arrays([pa.array([folder + name.removeprefix(root)]), pa.array([count], pa.int64())], names=["path", "records"])

        for b in slices(batches, 2):
            for key, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if handle is None:
                    name, size, count = f"{root}/{part:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    handle = store.open_output_stream(name, compression=None)
                for r in page_records(key, url or "", (html or "").encode("utf-8", "surrogatepass"), refers, segment):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out = z.compress(r) + z.flush()
                    handle.write(out)
                    size, count = size + len(out), count + 1
                if size >= FILE:
                    yield close()
                    handle = None
        if handle is not None:
            yield close()

    return run


def write_warc(pages: DataFrame, min_payload: int = 0, segment: int = SEGMENT, folder: str | None = None) -> DataFrame:
    """Write every row of pages as WARC records; gives the files as (path, records).

    Among rows with equal payloads of at least min_payload bytes those of the smallest page_id are responses, the others
    revisits of it; rows without a page_id are responses. Null html is an empty payload, a null url about:blank. Rows
    that repeat a page_id are written each. Columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    marks = rows.where(F.col("page_id").isNotNull()).select("page_id", F.unhex(F.sha1(payload)).alias("sha"), F.length(payload).alias("n")).where(F.col("n") >= min_payload)
    marks = materialize(marks, "warc-marks")
    first = marks.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last > first")
    again = materialize(marks.join(first, "sha").where("page_id > first").select(F.col("page_id").alias("again"), F.col("sha").alias("again_sha"), "first").distinct(), "warc-again")
    sha = F.unhex(F.sha1(payload))
    joined = rows.join(again, (F.col("page_id") == F.col("again")) & (sha == F.col("again_sha")), "left")
    # the record's id: of a page that is told from rows with the same page_id by a number of its own
    key = F.concat_ws(".", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.monotonically_increasing_id().cast("string"))
    keyed = joined.select(key.alias("key"), "url", "html", F.col("first").cast("string"))
    return materialize(keyed.mapInArrow(bounded(_writer(folder or new_path(spark, "warc"), segment)), "path string, records long"), "warc-files")


def _file_records(store, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    with store.open_input_stream(name, compression=None) as f:
        yield from parse_records(f)


SEGMENTS = "origin string, number int, kind string, refers_to string, url string, digest string, declared long, total long, block binary, payload binary"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("kind", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("declared", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("payload", pa.binary())])
    bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None
    for b in batches:
        for path in b.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            for h, block in _file_records(store, name):
                kind, number = h["warc-type"], int(h.get("warc-segment-number", 0))
                whole = kind == "response" and not number
                row = (bare(h.get("warc-segment-origin-id") or h["warc-record-id"]), number, kind, bare(h.get("warc-refers-to")), h.get("warc-target-uri"), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                       int(h["x-payload-length"]) if "x-payload-length" in h else None, int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                       None if whole or kind == "revisit" else block, http_payload(block) if whole else None)
                rows.append(row)
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column holds the blocks of the segments in order; the payload takes its place, row by row."""
    for b in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
        payloads = [http_payload(b"".join(x)) for x in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(payloads, pa.binary())], names=[*b.schema.names[:-1], "payload"])


def read_warc(files: DataFrame) -> DataFrame:
    """origin, kind (response or revisit), refers_to, url, digest, declared, payload of each page in the files.

    Segments are reassembled by origin, from any files. An origin whose segments leave a gap, lack the last one or
    differ from the total length fails the job. declared is a revisit's payload length.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records = files.select("path").repartition(n).mapInArrow(bounded(_reader), SEGMENTS)
    records = materialize(records, "warc-records")
    cols = ["origin", "kind", "refers_to", "url", "digest", "declared", "payload"]
    whole = records.where("number = 0").select(cols)
    parts = records.where("number > 0").groupBy("origin").agg(
        F.max(F.when(F.col("number") == 1, F.struct("url", "digest"))).alias("head"),
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
    )
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    ok = F.col("head").isNotNull() & (F.element_at("parts", -1)["number"] == F.size("parts")) & (length == F.col("total"))
    blocks = F.transform("parts", lambda p: p["block"])
    parts = parts.withColumn("blocks", F.when(F.coalesce(ok, F.lit(False)), blocks).otherwise(F.raise_error(F.concat(F.lit("segments do not fit: "), "origin"))))
    joined = parts.select("origin", F.lit("response").alias("kind"), F.lit(None).cast("string").alias("refers_to"), "head.url", "head.digest", F.lit(None).cast("long").alias("declared"), "blocks")
    schema = "origin string, kind string, refers_to string, url string, digest string, declared long, payload binary"
    return whole.unionByName(joined.mapInArrow(bounded(_decode), schema))


def _sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payloads = b.column(4).to_pylist()
        found = [d if p is None else digest(p) for p, d in zip(payloads, b.column(3).to_pylist(), strict=True)]
        if any(p is not None and f != d for p, f, d in zip(payloads, found, b.column(3).to_pylist(), strict=True)):
            raise ValueError("a payload differs from its digest")
        size = [n if p is None else len(p) for p, n in zip(payloads, b.column(5).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found), pa.array(size, pa.int64())], names=["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"])


def page_summary(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of read_warc's rows."""
    page = lambda c: F.substring_index(c, ".", 1).try_cast("long")
    rows = records.select(page("origin").alias("page_id"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"), "digest", "payload", "declared")
    found = rows.mapInArrow(bounded(_sha, 4), "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    return page_summary(read_warc(write_warc(read(spark, sf_dir, "pages"))))
