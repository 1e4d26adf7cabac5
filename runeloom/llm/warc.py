"""WARC archives: pages are written as records and read back.

Writing. A page becomes a response record whose block is an HTTP response in chunked transfer framing; of pages with
equal payloads of at least REVISITED bytes that with the largest id does, the others become revisit records that refer
to it. A block longer than SEGMENT bytes is cut into a first record and continuation records. Spark's own text
writer puts the records into files of the shared folder, with the end of a record as line separator; files hold at
most RECORDS records, the first of which describes the file, so their size is bounded and no store but Spark's needs to be
reached. That writer compresses a file as a whole: archives are to be read from their beginning, not from a record within.
Which page others refer to is found from digests alone; a payload that very many pages hold isn't gathered in one task.

Reading. All files of a folder are read, of this writer or of others, plain or gzip-compressed as a whole or by record. Records
are taken apart by their Content-Length. Continuations are grouped by the identifier of their
origin, put in order by segment number and joined; numbers must run from 1 without a gap and the total length must be that which the last one
states. Then the chunked framing is undone. A broken record raises ValueError. Records of other types than response, revisit and
continuation are passed over by read().

A null payload counts as empty, a null address is written as an empty one; an empty table gives no records, and other columns have no
part. Repeated pages become records each; those with the largest id of equal payloads are all responses. A page with a null id is
written and read with a null id, and never referred to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import map_slices
from .shared import cut, frequent, join_counted, shared_path

SEGMENT, RECORDS, CHUNK, REVISITED = 64 << 10, 1000, 8 << 10, 1000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _cuts(data: bytes, size: int) -> list[bytes]:
    """The data in pieces of at most `size` bytes (4 at least) that are whole UTF-8."""
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + max(4, size))
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to -= 1
        out.append(data[at:to])
        at = to
    return out


def framed(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in _cuts(payload, size)) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    """Undoes chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked framing ends without a last chunk")
        size = int(body[at:line].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        at = line + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        out.append(body[at : at + size])
        at += size + 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def info(name: str) -> bytes:
    """The record that describes a file, named after the first page in it."""
    block = b"software: runeloom\r\nformat: WARC File Format 1.1\r\n"
    return _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{name}:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]) + block


def records_of(name: str, url: str, payload: bytes, digest: str, refers: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, without the two line ends that close each."""
    url = "".join(c if c > " " else "%%%02X" % ord(c) for c in url)
    common = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield _head([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Length", len(block))]) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + framed(payload)
    if len(block) <= segment:
        yield _head([("WARC-Type", "response"), *common, ("Content-Length", len(block))]) + block
        return
    parts = _cuts(block, segment)
    for k, part in enumerate(parts, 1):
        if k == 1:
            yield _head([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1), ("Content-Length", len(part))]) + part
        else:
            last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
            yield _head([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", k), *last, ("Content-Length", len(part))]) + part


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes the pages' archives below path."""
    rows = pages.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    rows = rows.withColumns({"sha": F.sha1(body), "mark": F.xxhash64("html"), "size": F.octet_length("html")})
    # Only payloads that occur again need to be known to the others.
    payload = F.struct("sha", "mark", "size").alias("payload")
    first = rows.where(F.col("size") >= REVISITED).groupBy(payload).agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    first = cut(first)
    hot, _ = frequent(first)
    if hot.isEmpty():
        rows = rows.withColumn("payload", payload).join(first.drop("n"), "payload", "left")
    else:  # rows of a frequent payload learn of it where they are, and move by a key of their own
        hot = F.broadcast(cut(hot.select(F.col("payload").alias("_hot"), F.col("first").alias("_first"))))
        rows = rows.withColumn("payload", payload).join(hot, F.col("payload") == F.col("_hot"), "left")
        alone = F.struct(F.when(F.col("_hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))).alias("sha"), "mark", "size")
        rows = rows.withColumn("payload", alone).join(first.drop("n"), "payload", "left").withColumn("first", F.coalesce("_first", "first"))
    name = lambda x: F.concat(F.lit("urn:page:"), F.coalesce(x.cast("string"), F.lit("null")))
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), name(F.col("first")))
    # Record names must differ where pages are repeated, but a response that others refer to goes by its page alone.
    unique = F.concat(name(F.col("id")), F.when(F.col("first").eqNullSafe(F.col("id")) & F.col("first").isNotNull(), F.lit("")).otherwise(F.concat(F.lit(":row"), F.monotonically_increasing_id().cast("string"))))
    rows = rows.select(unique.alias("name"), "url", "html", "sha", refers.alias("refers"))

    def make():
        written = 0

        def step(part: pa.RecordBatch) -> dict:
            nonlocal written
            out = []
            for name, url, html, sha, refers in zip(*(c.to_pylist() for c in part.columns)):
                for record in records_of(name, url, html.encode(), sha, refers):
                    if not written % RECORDS:  # here the writer begins a file
                        out.append(info(name).decode())
                        written += 1
                    out.append(record.decode())
                    written += 1
            return {"record": out}

        return step

    made = map_slices(rows, make, "record string", text="html")
    made.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields, by lower-case name, and block of each record of an archive, gzip-compressed or not."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:  # members one after another
            one = zlib.decompressobj(31)
            plain.append(one.decompress(data) + one.flush())
            if not one.eof:
                raise ValueError("an archive ends within a compressed member")
            data = one.unused_data
        data = b"".join(plain)
    at = 0
    while at < len(data):
        if data.startswith((b"\r", b"\n"), at):  # more line ends than two after a record
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = end + 4
        at = begin + int(fields["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} is not as long as it says")
        yield fields, data[begin:at]
        at += 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, refers_to, digest, segment, total, block) of every record; id is the origin's for continuations."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows, size = [], 0
                bare = lambda x: x and x.strip("<>")
                for f, block in parse(content):
                    n, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    rows.append((bare(f.get("warc-segment-origin-id") or f["warc-record-id"]), f["warc-type"], bare(f.get("warc-refers-to")), f.get("warc-payload-digest"), n and int(n), total and int(total), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["id", "type", "refers_to", "digest", "segment", "total", "block"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "id string, type string, refers_to string, digest string, segment long, total long, block binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, refers_to, digest, payload) of every response and revisit; a revisit's payload is null."""

    def payloads(batches):
        for batch in batches:
            at = 0
            ids, kinds, refers, digests, blocks, parts = (batch.column(k) for k in range(6))
            for at in range(0, len(batch), 64):
                out = []
                kept = zip(kinds[at : at + 64].to_pylist(), blocks[at : at + 64].to_pylist(), parts[at : at + 64].to_pylist(), ids[at : at + 64].to_pylist())
                for kind, block, segments, id in kept:
                    if segments is not None:
                        if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                            raise ValueError(f"record {id} lacks a segment or has one twice")
                        block = b"".join(s["block"] for s in segments)
                        if segments[-1]["total"] != len(block):
                            raise ValueError(f"record {id} has {len(block)} bytes; its last segment states {segments[-1]['total']}")
                    if kind == "revisit":
                        out.append(None)
                        continue
                    head, mark, body = block.partition(b"\r\n\r\n")
                    if not mark:
                        raise ValueError(f"record {id} holds no HTTP response")
                    chunked = any(x.lower().replace(b" ", b"").startswith(b"transfer-encoding:") and b"chunked" in x.lower() for x in head.split(b"\r\n")[1:])
                    out.append(unframed(body) if chunked else body)
                cut = lambda x: x[at : at + 64]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([cut(ids), cut(kinds), cut(refers), cut(digests), pa.array(out, pa.binary())], names=["id", "type", "refers_to", "digest", "payload"])

    records = read_records(spark, path).where(F.col("type").isin("response", "revisit", "continuation"))
    whole = records.where("segment is null").select("id", "type", "refers_to", "digest", "block", F.lit(None).cast("array<struct<segment: long, total: long, block: binary>>").alias("parts"))
    cut = records.where("segment is not null").groupBy("id").agg(
        F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"), F.max("refers_to").alias("refers_to"), F.max("digest").alias("digest"),
        F.array_sort(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"),
    ).select("id", "type", "refers_to", "digest", F.lit(None).cast("binary").alias("block"), "parts")
    return whole.unionByName(cut).mapInArrow(payloads, "id string, type string, refers_to string, digest string, payload binary")


def archived(pages: DataFrame, path: str | None = None, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages' archives and reads them: (id, record_type, refers_to, payload_bytes, payload_digest), the last two of
    the full payload, which for a revisit is that of the record it refers to."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write(pages, path, id, url, html)
    page = lambda x: F.try_to_number(F.split(x, ":")[2], F.lit("S9999999999999999999")).cast("long")
    found = cut(read(spark, path).select(
        page(F.col("id")).alias("id"), "type", page(F.col("refers_to")).alias("refers_to"), F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha"),
        F.substring_index("digest", ":", -1).alias("digest"),
    ))  # the archives are read once
    revisits = found.where("type = 'revisit'").select(F.col("id").alias("page"), "refers_to", "digest")
    asked = cut(revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n")))
    referred = found.where("type = 'response'").groupBy("id").agg(F.max("size").alias("size"), F.max("sha").alias("sha")).withColumnRenamed("id", "refers_to")
    known = cut(asked.join(referred, "refers_to", "left"))
    same = F.when(F.col("sha") == F.col("digest"), F.col("sha"))
    out = found.where("type = 'response'").select(F.col("id").alias(id), "size", same.alias("sha"), "type", F.lit(None).cast("long").alias("refers_to"))
    more = join_counted(revisits, known, "refers_to").select(F.col("page").alias(id), "size", same.alias("sha"), F.lit("revisit").alias("type"), "refers_to")
    return out.unionByName(more).select(id, F.col("size").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
