"""WARC archives: segmented writing, reading, segment reassembly and decoding of chunked payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, quoted, saved, spread_join

RECORDS = "record_id string, warc_type string, target_uri string, page string, refers_to_page string, payload_digest string, segment_number long, segment_origin string, segment_total long, block binary"
ASSEMBLED = "record_id string, warc_type string, target_uri string, page string, refers_to_page string, payload_digest string, n_segments long, block_bytes long, http_head string, payload binary, payload_bytes long, payload_sha1 string, status string"
_BATCH = 8 << 20
#: What can't be an HTTP head, or a chunk's size line, for its length.
_LONGEST_HEAD, _LONGEST_LINE = 1 << 24, 1 << 16


def base32(digest: bytes) -> str:
    """The bare upper-case base32 of a SHA-1, which needs no padding."""
    return base64.b32encode(digest).decode()


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """The payload in chunked transfer framing."""
    out = bytearray()
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += b"%x\r\n" % len(part) + part + b"\r\n"
    return bytes(out + b"0\r\n\r\n")


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken or cut short. Extensions and trailers are ignored."""
    out, at = bytearray(), 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        digits = body[at:end].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("bad chunk size")
        n, at = int(digits, 16), end + 2
        if not n:
            return bytes(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out += body[at : at + n]
        at += n + 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    clean = ((k, str(v).replace("\r", " ").replace("\n", " ")) for k, v in fields if v is not None)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode()


def records_of(page, uri, payload: bytes, digest: str, refers_to, revisit: bool, segment_bytes: int) -> list[bytes]:
    """The records of one page, without the blank lines that end each."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Target-URI", uri), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Page", page)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", refers_to)]
        return [_head([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *kind, *profile, ("Content-Length", len(http))]) + http]
    block = http + chunked(payload)
    if len(block) <= segment_bytes:
        return [_head([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *kind, ("Content-Length", len(block))]) + block]
    out, parts = [], range(0, len(block), segment_bytes)
    for i, at in enumerate(parts):
        part = block[at : at + segment_bytes]
        if i == 0:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *kind, ("WARC-Segment-Number", 1)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common[1:2], ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i + 1), ("WARC-Segment-Total-Length", len(block) if i == len(parts) - 1 else None)]
        out.append(_head([*fields, ("Content-Length", len(part))]) + part)
    return out


def write_archives(pages: DataFrame, path: str, page_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", segment_bytes: int = 1 << 15, records_per_file: int = 1000, least_revisit_bytes: int = 0, broadcast_up_to: int = 500_000) -> str:
    """Writes each row of pages as WARC records under path (any store that Spark writes to) and returns path.

    A payload (text as UTF-8, or binary; null: empty) is an HTTP response with chunked framing. Of equal payloads (by length
    and SHA-1) of at least least_revisit_bytes the least page id is a response and the others are revisits; rows that share that
    id and payload are all responses. A null id comes after all others; if a payload has only null ids, all are responses.
    Blocks over segment_bytes are cut into a first record and continuations. A file holds records_per_file records at most,
    so it has a known size; it is one gzip stream. Other columns are not read. An empty table writes no record.
    """
    import pyarrow as pa

    bounded_batches(pages.sparkSession)
    src = pages.select(quoted(page_col).alias("page"), quoted(uri_col).cast("string").alias("uri"), F.coalesce(quoted(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    src = src.withColumns({"sha1": F.sha1("payload"), "n": F.length("payload")})
    same = src.where(F.col("n") >= least_revisit_bytes).groupBy("sha1", "n").agg(F.min("page").alias("least"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    same = saved(same.select(F.concat_ws(":", "sha1", "n").alias("same"), "least"), "copies")
    rows = src.withColumn("same", F.concat_ws(":", "sha1", "n"))
    # payloads are only shuffled to meet the table of those with copies if that isn't small
    rows = rows.join(F.broadcast(same), "same", "left") if same.count() <= broadcast_up_to else spread_join(rows, same, "same", "page", "left")
    rows = rows.withColumn("revisit", F.coalesce(F.col("least").isNotNull() & ~F.col("page").eqNullSafe(F.col("least")), F.lit(False)))
    rows = rows.select("page", "uri", "payload", "sha1", "least", "revisit")

    def made(batches):
        for batch in batches:
            out, size = [], 0
            for page, uri, payload, sha1, *rest in zip(*(batch.column(c).to_pylist() for c in ("page", "uri", "payload", "sha1", "least", "revisit")), strict=True):
                got = records_of(page, uri, payload, base32(bytes.fromhex(sha1)), *rest, segment_bytes)
                out += got
                size += sum(map(len, got))
                if size > _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # Spark's text writer puts the bytes as they are; the blank lines that end a record are its line separator
    rows.mapInArrow(made, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    return path


_GAP = b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.splitlines()
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}


def parse_pieces(pieces):
    """(fields, block) of each record of an archive that comes in pieces, cut at each blank line (and without those).

    A block may hold blank lines: pieces are joined until its length is reached, so one record is held at a time. ValueError
    where a record is cut short or isn't WARC.
    """
    fields, need, parts, got = None, 0, [], 0
    for piece in pieces:
        if fields is not None:
            got += len(piece) + (len(_GAP) if parts else 0)
            parts.append(piece)
            if got < need:
                continue
            whole = _GAP.join(parts) if len(parts) > 1 else piece
            yield fields, whole[:need]
            piece, fields = whole[need:], None
        piece = piece.lstrip(b"\r\n")
        if piece.strip():
            fields = _fields(piece)
            need, parts, got = int(fields["content-length"]), [], 0
    if fields is not None:
        if need:
            raise ValueError("record cut short")
        yield fields, b""


def parse_archive(stream):
    """(fields, block) of each record of a plain stream. ValueError where a record is cut short or isn't WARC."""
    while line := stream.readline():
        if not line.strip():
            continue
        head = [line]
        while (line := stream.readline()).strip():
            head.append(line)
        fields = _fields(b"".join(head))
        block = stream.read(n := int(fields["content-length"]))
        if len(block) < n:
            raise ValueError("record cut short")
        yield fields, block


def _number(x):
    return int(x) if x and x.isdigit() else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records under path, one row each; columns as in RECORDS.

    Files named *.gz (whole files or a member a record) are read as streams: Spark's text reader cuts them at blank lines and
    a task holds one record and a batch of rows, however long an archive is. Other files, plain or gzip, are values, of 2 GB
    at most, as Spark would else cut them where no record begins. A file is a task's unit: its framing can only be followed from its start.
    """
    import pyarrow as pa

    bounded_batches(spark)
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORDS.split(", ")]

    def as_batches(records):
        rows, size = [], 0
        for f, block in records:
            digest = f.get("warc-payload-digest", "")
            rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-page"), f.get("warc-refers-to-page"), digest.removeprefix("sha1:") or None, _number(f.get("warc-segment-number")), f.get("warc-segment-origin-id"), _number(f.get("warc-segment-total-length")), block))
            size += len(block)
            if size > _BATCH or len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def streamed(batches):
        from itertools import groupby

        pieces = ((file, piece) for batch in batches for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield from as_batches(r for _, own in groupby(pieces, lambda x: x[0]) for r in parse_pieces(p for _, p in own))

    def parsed(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer()
                raw = io.BytesIO(data)
                yield from as_batches(parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2].to_pybytes() == b"\x1f\x8b" else raw))

    zipped = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", _GAP.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "{*[!z],*[!g]z,*[!.]gz,gz,z}").load(path).where("length > 0").select("content")
    return zipped.mapInArrow(streamed, RECORDS).unionByName(plain.mapInArrow(parsed, RECORDS))


def is_chunked(head: str) -> bool:
    return any(k.strip().lower() == "transfer-encoding" and "chunked" in v.lower() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:]))


def decode_http(block: bytes) -> tuple[str | None, bytes, str]:
    """(head, payload, status) of an HTTP response block; a block without a head is its payload."""
    if not block.startswith(b"HTTP/"):
        return None, block, "ok"
    head, gap, body = block.partition(b"\r\n\r\n")
    text = head.decode("latin-1")
    if not gap:
        return text, b"", "bad_http"
    if is_chunked(text):
        try:
            return text, dechunk(body), "ok"
        except ValueError:
            return text, b"", "bad_chunks"
    return text, body, "ok"


class PayloadStream:
    """An HTTP response block decoded as it comes: what decode_http gives for the whole, with the payload's length and SHA-1.

    The payload itself is kept up to most bytes; beyond that only its length and digest are had.
    """

    def __init__(self, most: int):
        self.most, self.sha, self.n, self.kept = most, hashlib.sha1(), 0, []
        self.head, self.status, self.step, self.rest, self.left = None, "ok", "head", b"", 0

    def _take(self, data: bytes) -> None:
        self.sha.update(data)
        self.n += len(data)
        if self.n <= self.most:
            self.kept.append(data)
        else:
            self.kept = []

    def feed(self, data: bytes) -> None:
        data = self.rest + data
        self.rest = b""
        while data and self.step != "over":
            if self.step == "plain":
                self._take(data)
                return
            if self.step == "data":
                part, data = data[: self.left], data[self.left :]
                self._take(part)
                self.left -= len(part)
                if not self.left:
                    self.step = "end"
            elif self.step == "end":  # the line end after a chunk's data
                if len(data) < 2:
                    self.rest = data
                    return
                if data[:2] != b"\r\n":
                    return self._broken("bad_chunks")
                data, self.step = data[2:], "size"
            elif self.step == "size":
                at = data.find(b"\r\n")
                if at < 0:
                    self.rest = data
                    return self._broken("bad_chunks") if len(data) > _LONGEST_LINE else None
                digits = data[:at].split(b";")[0].strip()
                if not digits or digits.strip(b"0123456789abcdefABCDEF"):
                    return self._broken("bad_chunks")
                self.left, data = int(digits, 16), data[at + 2 :]
                self.step = "data" if self.left else "over"
            else:
                if len(data) < 5 and b"HTTP/".startswith(data):
                    self.rest = data
                    return
                if not data.startswith(b"HTTP/"):
                    self.step = "plain"
                    continue
                at = data.find(_GAP)
                if at < 0:
                    self.rest = data
                    return self._broken("bad_http") if len(data) > _LONGEST_HEAD else None
                self.head, data = data[:at].decode("latin-1"), data[at + 4 :]
                self.step = "size" if is_chunked(self.head) else "plain"

    def _broken(self, status: str) -> None:
        self.step, self.status, self.rest, self.kept = "over", status, b"", []

    def end(self) -> tuple:
        """(head, payload, payload_bytes, payload_sha1, status)."""
        if self.step == "head" and self.rest.startswith(b"HTTP/"):
            self.head = self.rest.decode("latin-1")
            self._broken("bad_http")
        elif self.step == "head":
            self._take(self.rest)
        elif self.step in ("size", "data", "end"):
            self._broken("bad_chunks")
        if self.status != "ok":
            return self.head, None, None, None, self.status
        return self.head, b"".join(self.kept) if self.n <= self.most else None, self.n, base32(self.sha.digest()), "ok"


def reassemble(records: DataFrame, max_payload_bytes: int = 1 << 30) -> DataFrame:
    """Whole records from segments; columns as in ASSEMBLED. One row a record, in any order.

    Continuations are grouped by the origin's identifier (the first segment's own) and ordered by segment number; chunked
    framing of the payload is then decoded. Records without a segment number need no shuffle. status: ok, or
    missing_segment (a number from 1 on lacks, or the last segment's total length lacks), conflicting_segment (one number with
    different blocks; equal repeats count once), length_mismatch (the sum isn't the total length), bad_http, bad_chunks.
    payload_bytes and payload_sha1 (base32) are of the whole payload, however long: segments are decoded one after the other
    as they come, sorted, from the shuffle, so a record is never held in memory. The payload itself is null over
    max_payload_bytes (0: never kept but for empty ones), and like these unless ok. A revisit has a head alone. Null blocks are
    empty. Null identifiers of segments form a group. Columns besides those of RECORDS are not read.
    """
    import pyarrow as pa

    spark = records.sparkSession
    bounded_batches(spark)
    head = ["record_id", "warc_type", "target_uri", "page", "refers_to_page", "payload_digest"]
    names = [c.split()[0] for c in ASSEMBLED.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in ASSEMBLED.split(", ")]
    # both branches read the records: they are kept so that archives are parsed once
    records = saved(records.select(*[c.split()[0] for c in RECORDS.split(", ")]).withColumn("block", F.coalesce("block", F.lit(b""))).withColumn("sum", F.when(F.col("segment_number").isNotNull(), F.md5("block"))), "records")

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def one(fields, n, blocks, total):
        if fields[1] == "revisit":  # a head alone: its payload is elsewhere
            text = b"".join(blocks).partition(_GAP)[0].decode("latin-1")
            return (*fields, n, total, text, None, None, None, "ok")
        stream = PayloadStream(max_payload_bytes)
        for x in blocks:
            stream.feed(x)
        return (*fields, n, total, *stream.end())

    def bounded(rows):
        """Rows in batches of bounded size."""
        out, size = [], 0
        for r in rows:
            out.append(r)
            size += len(r[9] or b"")
            if size > _BATCH or len(out) >= 4096:
                yield made(out)
                out, size = [], 0
        if out:
            yield made(out)

    def decoded(batches):
        yield from bounded(one(fields, 1, [block], len(block)) for batch in batches for *fields, block in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    whole = records.where("segment_number is null").select(*head, "block").mapInArrow(decoded, ASSEMBLED)

    parts = records.where("segment_number is not null").withColumn("origin", F.coalesce("segment_origin", "record_id"))
    once = parts.groupBy("origin", "segment_number", "sum").agg(F.max(F.length("block")).alias("size"), F.max("segment_total").alias("total"), F.max(F.when(F.col("segment_origin").isNull(), F.struct(*head))).alias("head"))
    sizes = once.groupBy("origin").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("segment_number").alias("numbers"), F.min("segment_number").alias("first"), F.max("segment_number").alias("last"), F.max("total").alias("total"), F.max(F.struct(F.col("total").isNotNull().alias("x"), F.col("segment_number").alias("y"))).alias("end"), F.max("head").alias("head"))
    verdict = F.when(F.col("n") > F.col("numbers"), "conflicting_segment").when((F.col("first") != 1) | (F.col("last") != F.col("n")) | F.col("head").isNull() | F.col("total").isNull() | (F.col("end.y") != F.col("last")), "missing_segment").when(F.col("bytes") != F.col("total"), "length_mismatch").otherwise("ok")
    own = [F.coalesce(F.col(f"head.{c}"), F.col("origin") if c == "record_id" else F.lit(None)).alias(c) for c in head]
    # an origin's verdict comes before its segments, in one sorted stream
    first = sizes.select("origin", F.lit(0).cast("long").alias("segment_number"), F.lit(0).alias("kind"), *own, "n", "bytes", verdict.alias("status"), F.lit(None).cast("binary").alias("block"))
    blocks = parts.select("origin", "segment_number", F.lit(1).alias("kind"), *[F.lit(None).cast("string").alias(c) for c in head], F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("status"), "block")
    stream = first.unionByName(blocks).repartition("origin").sortWithinPartitions("origin", "kind", "segment_number")

    def joined(batches):
        def rows():
            yield from (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))

        def each():
            it = rows()
            now = next(it, None)
            while now is not None:
                _, _, _, *fields, n, total, status, _ = now

                def own():
                    nonlocal now
                    last = 0
                    while (now := next(it, None)) is not None and now[2]:
                        if now[1] != last:  # an equal repeat counts once
                            yield now[-1]
                        last = now[1]

                mine = own()
                out = one(fields, n, mine, total) if status == "ok" else (*fields, n, total, None, None, None, None, status)
                for _ in mine:
                    pass
                yield out

        yield from bounded(each())

    return whole.unionByName(stream.mapInArrow(joined, ASSEMBLED))


def page_digests(records: DataFrame) -> DataFrame:
    """Per reassembled record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, status.

    A revisit has the payload of the response with the same digest; it is looked up on that digest, of which the responses
    have one row; a digest that a third of the records share is spread over several tasks. A revisit whose response
    isn't there has status missing_response.
    """
    response = F.col("warc_type") == "response"
    # both branches of the join below read the same records: they are kept so that they are decoded once
    slim = saved(records.select("page", "refers_to_page", "warc_type", "target_uri", "status", F.when(response, F.col("payload_bytes")).alias("bytes"), F.when(response, F.col("payload_sha1")).otherwise(F.col("payload_digest")).alias("digest")), "warc")
    seen = slim.where("warc_type = 'response' and digest is not null").groupBy("digest").agg(F.max("bytes").alias("payload_bytes"))
    first = slim.where("warc_type <> 'revisit'").withColumn("payload_bytes", F.col("bytes"))
    again = slim.where("warc_type = 'revisit'").transform(lambda d: spread_join(d, seen, "digest", "page", "left")).withColumn("status", F.when(F.col("payload_bytes").isNull(), "missing_response").otherwise(F.col("status")))
    cols = [F.expr("try_cast(page as bigint)").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.expr("try_cast(refers_to_page as bigint)").alias("refers_to"), "target_uri", "status"]
    return first.select(*cols).unionByName(again.select(*cols))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder, read back and reassembled; null html is an empty payload. Only lengths and digests are asked for, so payloads aren't kept."""
    path = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "archives"))
    return page_digests(reassemble(read_archives(spark, path), max_payload_bytes=0))


OP1_SQL = """
with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, url, octet_length(encode(html)) as n, array_to_string(list_transform(range(0, 8), lambda i: translate(to_base(('0x' || substr(h, 1 + 5 * i::int, 5))::bigint, 32, 4), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') as digest from p),
m as (select *, min(page_id) over (partition by digest, n) as least from d)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when page_id = least then 'response' else 'revisit' end as record_type,
  case when page_id = least then null else least end as refers_to, url as target_uri, 'ok' as status from m
"""
