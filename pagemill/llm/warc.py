"""WARC archives of web pages: writing with payload de-duplication and segments, reading with reassembly.

An archive is a `.warc.gz` file of one gzip member a record. A response's block is an HTTP message in chunked transfer
framing. A block longer than a segment is cut: its record has segment number 1, and continuation records name it by
WARC-Segment-Origin-ID, the last of them with the total length. A payload that another record holds is only revisited.
A record id is made of the page id and the payload's SHA-1, so records of equal ids are equal.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import create_folder, file_system, one_each, salted, shared_folder, written

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISITED = 1000  # bytes; shorter payloads are always stored
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
DATE = "2000-01-01T00:00:00Z"  # pages have no capture time
HEAVY_SHARE = 1000  # digests with over 1 / HEAVY_SHARE of the rows, at most HEAVY_SHARE of them, are joined by broadcast
_HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_ID = re.compile(r"<urn:page:(-?\d*):([0-9a-f]{40})>")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(identifier: str | None) -> int | None:
    """The page id of a record id."""
    found = _ID.fullmatch(identifier or "")
    return int(found[1]) if found and found[1] else None


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2 + size
        parts.append(body[end + 2 : at])
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        at += 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP header missing")
    return dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """A page's records: a revisit, or a response and its continuations."""
    digest = hashlib.sha1(payload).hexdigest()
    own = record_id(page_id, digest)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    both = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        more = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Payload-Length", len(payload))]
        yield _record([("WARC-Type", "revisit"), *both, *more, kind], _HTTP_HEAD)
        return
    block = _HTTP_HEAD + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *both, kind], block)
        return
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    yield _record([("WARC-Type", "response"), *both, ("WARC-Segment-Number", 1), kind], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", own), *last], part)


def with_revisits(pages: DataFrame) -> DataFrame:
    """`page_id, url, html, refers_to`: the largest page id with the same payload, null for that page itself and for short payloads.

    Digests that many pages share are few, and meet the pages by broadcast; the others by a shuffle, in which a page that
    needs no partner has a key of its own. Pages of equal id and payload are the same record, so all are responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    keyed = pages.withColumn("digest", F.when(F.octet_length("html") >= LEAST_REVISITED, F.sha1(F.col("html").cast("binary"))))
    shared = keyed.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("largest")).where("n > 1")
    shared = written(shared, "payload-digests")
    least = shared.agg(F.sum("n")).first()[0] or 0
    heavy = shared.where(F.col("n") > least / HEAVY_SHARE).select("digest", F.col("largest").alias("by_heavy"))
    light = shared.where(F.col("n") <= least / HEAVY_SHARE).select(F.col("digest").alias("key"), F.col("largest").alias("by_light"))
    found = keyed.join(F.broadcast(heavy), "digest", "left")
    key = F.when(F.col("by_heavy").isNull(), F.col("digest"))
    found = found.withColumn("key", F.coalesce(key, F.concat(F.lit("page "), F.coalesce(F.col("page_id"), F.xxhash64("url", "html")).cast("string"))))
    found = found.join(light.hint("merge"), "key", "left")
    largest = F.coalesce("by_heavy", "by_light")
    return found.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(largest), largest).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Writes `page_id, url, html` as archives, one a task, and returns the manifest `file, n_records` of finished tasks.

    A null html is an empty payload; a null url an empty target.
    """
    create_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, name, count = None, salted("pages") + ".warc.gz", 0
        for batch in batches:
            if stream is None and batch.num_rows:
                fs, where = file_system(f"{folder}/{name}")
                stream = fs.open_output_stream(where)
                stream.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for record in records_of(page_id, url, html.encode(), refers_to, segment):
                    stream.write(record)
                    count += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([count], pa.int64())})

    return written(with_revisits(pages).mapInArrow(write, "file string, n_records long"), "warc-manifest")


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an open archive, a record in memory at a time."""
    expand, held, raw = zlib.decompressobj(31), bytearray(), b""

    def more() -> bool:
        nonlocal expand, raw
        raw = raw or stream.read(1 << 18)
        if not raw:
            return False
        if expand.eof:
            expand = zlib.decompressobj(31)
        held.extend(expand.decompress(raw))
        raw = expand.unused_data if expand.eof else b""
        return True

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("record header cut short")
        lines = held[:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        begin, size = end + 4, int(fields["Content-Length"])
        while len(held) < begin + size + 4:
            if not more():
                raise ValueError("record block cut short")
        yield fields, bytes(held[begin : begin + size])
        del held[: begin + size + 4]


PARSED = "record_id string, record_type string, refers_to string, digest string, payload_bytes long, segment int, total long, origin string, block binary, problem string"


def _resolved(block: bytes, digest: str | None) -> tuple[int, str, str | None]:
    """(payload bytes, SHA-1, problem)."""
    try:
        payload = payload_of(block)
    except ValueError as e:
        return 0, hashlib.sha1(b"").hexdigest(), str(e)
    found = hashlib.sha1(payload).hexdigest()
    return len(payload), found, None if found == digest else "payload digest differs"


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to, problem` of each page in the archives.

    Records that aren't segmented are decoded where they are read. Of the others, continuations meet by origin id in a
    shuffle, are put in order of their number and appended to the first segment; a missing number, a total length that
    isn't met, broken framing or a wrong digest is told in `problem`, which else is null.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                fs, where = file_system(f"{folder}/{name}")
                with fs.open_input_stream(where) as stream:
                    for fields, block in records_in(stream):
                        kind = fields["WARC-Type"]
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                        number = int(fields["WARC-Segment-Number"]) if "WARC-Segment-Number" in fields else None
                        total = int(fields["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in fields else None
                        length, problem, kept = None, None, block if number else None
                        if kind == "revisit":
                            length = int(fields["X-Payload-Length"])
                        elif not number:
                            length, digest, problem = _resolved(block, digest)
                        rows.append((fields["WARC-Record-ID"], kind, fields.get("WARC-Refers-To"), digest, length, number, total, fields.get("WARC-Segment-Origin-ID"), kept, problem))
                        size += len(kept or b"") + 200
                        if size > 4 << 20:
                            yield _parsed(rows)
                            rows, size = [], 0
        if rows:
            yield _parsed(rows)

    records = one_each(manifest.select("file")).mapInArrow(parse, PARSED)
    records = written(records, "warc-records")
    whole = records.where("segment is null").select("record_id", "record_type", "refers_to", "digest", "payload_bytes", "problem")
    first = records.where("segment = 1").select("record_id", "record_type", "refers_to", "digest", "block")
    rest = records.where("segment > 1").select(F.col("origin").alias("record_id"), "segment", "total", "block").dropDuplicates(["record_id", "segment"])
    # a block's segments are one record's, so a group is as bounded as a record is
    rest = rest.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"))
    joined = first.hint("merge").join(rest, "record_id", "left")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, kind, refers, digest, block, parts, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = parts or []
                block = b"".join([block, *(p["block"] for p in parts)])
                length, found, problem = _resolved(block, digest)
                if [p["segment"] for p in parts] != list(range(2, len(parts) + 2)) or total is None:
                    problem = "a segment is missing"
                elif total != len(block):
                    problem = "total length differs"
                out.append((own, kind, refers, found, length, problem))
            names = ["record_id", "record_type", "refers_to", "digest", "payload_bytes", "problem"]
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    joined = joined.select("record_id", "record_type", "refers_to", "digest", "block", "parts", "total")
    pages = whole.unionByName(joined.mapInArrow(assemble, "record_id string, record_type string, refers_to string, digest string, payload_bytes long, problem string"))
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*):", 1), F.lit("")).cast("long")
    return pages.select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), "problem")


def _parsed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in PARSED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    folder = shared_folder(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder)
