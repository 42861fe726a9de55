"""WARC archives: written with one gzip member per record, read back record by record."""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.llm.common import checkpointed, dealt, ship_package

CHUNK, HEAD = 1 << 16, 1 << 20
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: object, url: str | None, payload: bytes, refers_to: object = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head only, and the digest and length of the full payload."""
    head = _HEAD + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x-page:{page_id}>"), ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url:
        fields.insert(3, ("WARC-Target-URI", " ".join(url.split())))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member; its last byte is zero, if need be by an empty member after it (data of 16 MB or more)."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


_FIELDS = {
    "record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "refers_to": pa.string(), "ok": pa.bool_(), "payload": pa.binary(), "error": pa.string(), "archive": pa.string(),
}


class BadRecord(ValueError):
    """An archive breaks off, or isn't framed as WARC."""


def members(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member in turn; pieces are bounded, so a bomb can't fill the memory."""
    source = iter(chunks)
    data = next(source, b"")
    while data or (data := next(source, b"")):
        d = zlib.decompressobj(31)

        def pieces(d=d) -> Iterator[bytes]:
            nonlocal data
            while not d.eof:
                if not data and not (data := next(source, b"")):
                    raise BadRecord("the archive ends inside a record")
                try:
                    piece = d.decompress(data, CHUNK)
                except zlib.error as e:
                    raise BadRecord(f"not a gzip member: {e}") from e
                data = d.unused_data if d.eof else d.unconsumed_tail
                if piece:
                    yield piece

        one = pieces()
        yield one
        for _ in one:  # what the reader has left
            pass


def _until_blank(pieces: Iterator[bytes], buffer: bytearray, most: int = HEAD) -> bytes:
    while (end := buffer.find(b"\r\n\r\n")) < 0:
        if len(buffer) > most:
            raise BadRecord("headers without an end")
        piece = next(pieces, None)
        if piece is None:
            raise BadRecord("a record without an end of its headers")
        buffer += piece
    head = bytes(buffer[:end])
    del buffer[: end + 4]
    return head


def read_records(chunks: Iterable[bytes], with_payload: bool = True) -> Iterator[dict]:
    """Reads an archive in order: a dict per record with its lower-case headers, payload_bytes, payload_digest, payload (if wanted) and ok.

    Members are inflated piece by piece, a record's block is framed by its Content-Length,
    and the digests of block and payload are computed as the block passes. ``ok`` is
    false where a digest in the headers isn't the one computed, or bytes follow the
    record's end. Framing that can't be followed, and headers or an HTTP head of more than ``HEAD`` bytes,
    raise BadRecord. Without payloads, what is held at once doesn't grow with a record.
    """
    for pieces in members(chunks):
        buffer = bytearray()
        first = next(pieces, None)
        if first is None:
            continue  # an empty member
        buffer += first
        lines = _until_blank(pieces, buffer).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise BadRecord(f"no WARC version line: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise BadRecord("no content length") from e
        block_digest, payload_digest, payload, size, seen, http = hashlib.sha1(), hashlib.sha1(), io.BytesIO(), 0, 0, bytearray()
        is_http = headers.get("content-type", "").startswith("application/http")
        in_payload = not is_http
        while seen < length:
            if not buffer:
                piece = next(pieces, None)
                if piece is None:
                    raise BadRecord("a record shorter than its content length")
                buffer += piece
            part = bytes(buffer[: length - seen])
            del buffer[: len(part)]
            seen += len(part)
            block_digest.update(part)
            if not in_payload:
                new = max(0, len(http) - 3)
                http += part
                if (end := http.find(b"\r\n\r\n", new)) >= 0:
                    part, in_payload = bytes(http[end + 4 :]), True
                    del http[end:]
                elif len(http) > HEAD:
                    raise BadRecord("an HTTP head without an end")
                else:
                    continue
            payload_digest.update(part)
            size += len(part)
            if with_payload:
                payload.write(part)
        for piece in pieces:
            buffer += piece
            if len(buffer) > 64:
                break
        ok = bytes(buffer) == b"\r\n\r\n"
        told = {k: headers[f"warc-{k}-digest"].partition(":")[2] for k in ("block", "payload") if f"warc-{k}-digest" in headers}
        ok &= told.get("block") in (None, base64.b32encode(block_digest.digest()).decode())
        digest = base64.b32encode(payload_digest.digest()).decode()
        if headers.get("warc-type") == "revisit":  # the payload is elsewhere: its length and digest stand in the headers
            inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
            size, digest = int(inner.get("content-length", "0")), told.get("payload", digest)
        else:
            ok &= told.get("payload") in (None, digest)
        yield {"headers": headers, "payload_bytes": size, "payload_digest": digest, "payload": payload.getvalue() if with_payload else None, "ok": ok}


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_mb: int = 16, level: int = 6) -> None:
    """Writes a record for each row below ``path``, as archives of about ``archive_mb`` of payload.

    Of rows with equal payloads the one with the smallest id is a response, the others are
    revisits of it. Payloads are compared by length and SHA-1 (what WARC itself compares), counted with a
    map-side combine. Null html is an empty payload; null ids are written as ``null`` and
    come last; rows with a repeated id are written each. An empty table gives no archives.

    Spark's own text writer and committer write the files, so any file system and lost
    tasks are its business: a row is a record's gzip member without the last byte, which
    is always zero, and zero is the writer's line separator.
    """
    spark = pages.sparkSession
    ship_package(spark)
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("html")), "len": F.octet_length("html")})
    slim = checkpointed(rows.select("id", "sha", "len"))
    first = checkpointed(slim.groupBy("sha", "len").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    payload, total = slim.agg(F.coalesce(F.sum("len"), F.lit(0)), F.count(F.lit(1))).first()
    # Ids of rows that revisit another: only these meet the pages. Rows of a payload that very many share are dealt into parts, by number, as their ids may all be null.
    parts, first = dealt(slim.withColumn("row", F.monotonically_increasing_id()), first, ["sha", "len"], "n", total, ["row"])
    key = F.struct("id", "sha")  # one column, which compares null ids like others; so the join needs no other partitioning than the archives'
    again = parts.join(first, ["sha", "len", "_part"]).where("not (id <=> first)").select(key.alias("key"), "first").distinct()
    files = max(1, -(-payload // (archive_mb << 20)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = rows.withColumn("key", key).repartition(files, "key").join(again.withColumn("revisit", F.lit(True)), "key", "left")
    records = met.select("id", "url", "html", "first", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                out = []
                for i, url, body, first, revisit in zip(*(c.to_pylist() for c in whole.slice(at, 64).columns), strict=True):
                    out.append(member(record("revisit" if revisit else "response", "null" if i is None else i, url, body, first), level)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records.mapInArrow(make, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(record_id, record_type, url, payload_bytes, payload_digest, refers_to, ok, payload, error, archive) of each record of the archives below ``path``.

    ``with_payload`` says whether payloads come out or, though read and verified, are null. Where an archive breaks off
    or can't be followed, its records so far stand, and one more row without an id says so in ``error``; other archives are read all the same.

    Each archive is read in order, as a stream of gzip members (see ``read_records``).
    Archives are spread over tasks; one is held compressed by its task, as Spark's binary
    file source hands it over, so archives should be of moderate size (2 GB is that source's limit).
    """
    ship_package(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _FIELDS.values(), strict=True)], names=list(_FIELDS))
        for b in batches:
            for content, archive in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                view, rows, size = memoryview(content.as_buffer()), [], 0
                records = read_records((bytes(view[i : i + CHUNK]) for i in range(0, len(view), CHUNK)), with_payload)
                while True:
                    try:
                        r = next(records, None)
                    except BadRecord as e:
                        rows.append((None, None, None, None, None, None, False, None, str(e), archive))
                        break
                    if r is None:
                        break
                    h = r["headers"]
                    rows.append(
                        (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), r["payload_bytes"], r["payload_digest"], h.get("warc-refers-to"), r["ok"], r["payload"], None, archive)
                    )
                    size += len(r["payload"] or b"")
                    if size > 8 << 20 or len(rows) >= 1000:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    schema = "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, ok boolean, payload binary, error string, archive string"
    return files.select("content", "path").mapInArrow(read, schema)
