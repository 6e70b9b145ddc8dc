"""WARC archives as a chunked record table.

Writing: a payload over ``chunk`` bytes becomes WARC segments (a response and its continuations), one
row and at most ``chunk`` payload bytes each, so no row of the writer holds a whole large record.
Reading: a streaming parser goes through each file line by line and yields (record_id, chunk_no) rows
of at most ``chunk`` bytes, with the SHA-1 of the payload up to and with each chunk. Of a record it holds
one chunk and one line at a time; Spark's line reader gives lines whole, so a foreign record without line
feeds is as large as its segment. This writer's segments are never larger than ``chunk`` and a header.

Files are plain WARC/1.1, compressed by file; a compressed file is one task's work and holds whole
records only, and Spark writes and reads it through its own file systems.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: An HTTP header longer than this is an error, so that a payload without a header isn't gathered.
HEAD_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "record_id string, chunk_no int, record_type string, uri string, refers_to string, declared_digest string, n_bytes long, bytes_so_far long, digest_so_far string, last boolean, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decide(pages: DataFrame, id_col: str, payload: Column, least: int, extra: list[Column]) -> DataFrame:
    """(id, bytes, digest, response): response is the largest id among payloads of equal digest and length."""
    rows = pages.select(F.col(id_col).alias("id"), F.length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("digest"), *extra)
    first = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("id").alias("response"))
    return rows.join(first, ["digest", "bytes"], "left").withColumn("revisit", F.coalesce(F.col("id") < F.col("response"), F.lit(False)))


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", date: str = "1970-01-01T00:00:00Z", least_revisit: int = 0, chunk: int = CHUNK) -> None:
    """Write a record for each row to new WARC files under ``path``.

    Of rows with equal payloads of at least ``least_revisit`` bytes, that with the largest id is a
    response and the others revisit it. Defined results: a null payload is empty; a null id is an empty
    id, always a response; rows that repeat an id and payload are all responses, or all revisits; white
    space in a URI is percent-encoded and a null URI is left out; an empty table writes no record.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    uri = F.replace(F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20")).alias("uri")
    decided = decide(pages, id_col, payload, least_revisit, [uri])

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def optional(name: str, value: Column, close: str = "") -> Column:
        return F.when(value.isNull(), "").otherwise(text(name, value, close, "\r\n"))

    urn = lambda c: text("<urn:page:", F.coalesce(c.cast("string"), F.lit("")), ">")
    http = text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("bytes").cast("string"), "\r\n\r\n")

    def record(kind: Column | str, own: Column, more: Column | str, block: Column) -> Column:
        head = text("WARC/1.1\r\nWARC-Type: ", kind, "\r\nWARC-Record-ID: ", own, f"\r\nWARC-Date: {date}\r\n", optional("WARC-Target-URI: ", F.col("uri")), "WARC-Payload-Digest: sha1:", F.col("digest"), "\r\n", more, "Content-Type: application/http; msgtype=response\r\nContent-Length: ", F.length(block).cast("string"), "\r\n\r\n")
        return F.concat(head.cast("binary"), block, F.lit(b"\r\n")).cast("string").alias("value")

    wanted = decided.where(~F.col("revisit")).select("id", "digest", "bytes").distinct().select(F.col("id").alias("i"), F.col("digest").alias("d"), F.col("bytes").alias("b"))
    whole = pages.select(F.col(id_col).alias("id"), uri, payload.alias("payload"), base32_sha1(payload).alias("digest"), F.length(payload).cast("long").alias("bytes"))
    kept = whole.join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left_semi")
    n = F.greatest(F.ceil(F.col("bytes") / chunk), F.lit(1)).cast("int")
    parts = kept.select("*", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    piece = F.substring(F.col("payload"), F.col("k") * chunk + 1, F.lit(chunk))
    own = text("<urn:page:", F.coalesce(F.col("id").cast("string"), F.lit("")), F.when(F.col("k") > 0, F.concat(F.lit(":segment:"), F.col("k").cast("string"))).otherwise(""), ">")
    segment = F.when(F.col("n") == 1, "").otherwise(text(
        "WARC-Segment-Number: ", (F.col("k") + 1).cast("string"), "\r\n",
        F.when(F.col("k") > 0, text("WARC-Segment-Origin-ID: ", urn(F.col("id")), "\r\n")).otherwise(""),
        F.when(F.col("k") == F.col("n") - 1, text("WARC-Segment-Total-Length: ", (F.col("bytes") + F.length(http)).cast("string"), "\r\n")).otherwise(""),
    ))
    responses = parts.select(record(F.when(F.col("k") == 0, "response").otherwise("continuation"), own, segment, F.when(F.col("k") == 0, F.concat(http.cast("binary"), piece)).otherwise(piece)))
    refers = text("WARC-Refers-To: ", urn(F.col("response")), f"\r\nWARC-Profile: {PROFILE}\r\n")
    revisits = decided.where("revisit").select(record("revisit", urn(F.col("id")), refers, http.cast("binary")))
    responses.union(revisits).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _bare(urn: str | None) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") if urn is not None else None


class _Records:
    """The state of the parser between lines."""

    def __init__(self, chunk: int) -> None:
        self.chunk = chunk
        self.rows: list[tuple] = []
        self.state, self.left, self.head = "start", 0, {}
        self.sha, self.so_far, self.chunk_no, self.record, self.origin = hashlib.sha1(), 0, 0, "", None
        self.buffer, self.size, self.http, self.http_head = [], 0, False, b""

    def line(self, data: bytes) -> None:
        if self.state == "block":
            data += b"\n"
            if len(data) <= self.left:
                self.left -= len(data)
                self.take(data)
                return
            self.take(data[: self.left])
            if data[self.left :] != b"\r\n":
                raise ValueError(f"record {self.head.get('warc-record-id')}: no line end after the block")
            self.end()
            self.state = "close"
        elif self.state == "close":
            if data != b"\r":
                raise ValueError("no empty line after a record")
            self.state = "start"
        elif self.state == "head":
            if data == b"\r":
                self.begin()
            else:
                name, _, value = data.decode("utf-8", "replace").rstrip("\r").partition(":")
                self.head[name.strip().lower()] = value.strip()
        elif data.startswith(b"WARC/1."):
            self.state, self.head = "head", {}
        elif data not in (b"", b"\r"):
            raise ValueError(f"not a WARC record: {data[:60]!r}")

    def begin(self) -> None:
        self.state, self.left, kind = "block", int(self.head["content-length"]), self.head["warc-type"]
        self.buffer, self.size = [], 0
        if kind == "continuation":
            if self.head.get("warc-segment-origin-id") != self.record:
                raise ValueError(f"segment of {self.head.get('warc-segment-origin-id')} doesn't follow it")
        else:
            self.sha, self.so_far, self.chunk_no, self.record, self.origin = hashlib.sha1(), 0, 0, self.head["warc-record-id"], self.head
            self.http, self.http_head = "application/http" in self.head.get("content-type", ""), b""

    def take(self, data: bytes) -> None:
        if self.http:
            self.http_head += data
            cut = self.http_head.find(b"\r\n\r\n")
            if cut < 0:
                if len(self.http_head) > HEAD_BYTES:
                    raise ValueError(f"record {self.record}: no end of the HTTP header within {HEAD_BYTES} bytes")
                return
            data, self.http_head, self.http = self.http_head[cut + 4 :], self.http_head[:cut], False
        while data:
            part, data = data[: self.chunk - self.size], data[self.chunk - self.size :]
            self.buffer.append(part)
            self.size += len(part)
            if self.size == self.chunk and (data or self.left):
                self.emit(False)

    def emit(self, last: bool) -> None:
        payload = b"".join(self.buffer)
        self.sha.update(payload)
        self.so_far += len(payload)
        kind, digest, total = self.origin["warc-type"], base64.b32encode(self.sha.digest()).decode(), self.so_far
        declared = self.origin.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "revisit":  # the payload is elsewhere; the stored HTTP head tells its length
            m = re.search(rb"(?i)content-length:\s*(\d+)", self.http_head)
            digest, total = declared, int(m[1]) if m else None
        elif last and declared and declared != digest:
            raise ValueError(f"payload of {self.record} has digest {digest}, not {declared}")
        self.rows.append((_bare(self.record), self.chunk_no, kind, self.origin.get("warc-target-uri"), _bare(self.origin.get("warc-refers-to")), declared, len(payload), total, digest, last, payload))
        self.chunk_no += 1
        self.buffer, self.size = [], 0

    def end(self) -> None:
        self.http = False
        segmented = "warc-segment-number" in self.head
        last = not segmented or "warc-segment-total-length" in self.head
        if last or self.size:
            self.emit(last)


def read(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of all archives under ``path``, compressed or plain; digests are checked at each record's end.

    A task takes an archive from its start to its end, whatever its size: a record begins where the one before it
    ends, and a payload may hold what looks like a record. Write archives of a size that one task can take.
    """
    schema = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("n_bytes", pa.int64()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, held = _Records(chunk), 0

        def out() -> pa.RecordBatch:
            rows, records.rows = records.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for value in batch.column(0):
                records.line(value.as_py())
                if len(records.rows) > held:
                    held = len(records.rows)
                    if held >= 64 and (held >= 2048 or held % 64 == 0 and sum(r[6] for r in records.rows) > 8 << 20):
                        yield out()
                        held = 0
        if records.state not in ("start", "close"):
            raise ValueError("the archive ends within a record")
        if records.rows:
            yield out()

    # A session of its own for the reader: a split as large as any file, and no two files in one.
    whole = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        whole.conf.set(f"spark.sql.files.{name}", 1 << 60)
    lines = whole.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(run, ROWS)
