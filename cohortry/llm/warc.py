"""WARC archives: written from rows, read back, and assembled into captures.

``write`` makes a request, a response (or revisit) and a metadata record of every
row, linked by WARC-Concurrent-To, and writes them with Spark's text writer, each record
ended by the two line ends that the format asks for. ``read`` parses archives,
compressed or not, by the length each record states, so a payload may hold anything.
``captures`` joins the records of a transaction into one nested row.

Of records with equal payloads the one of the smallest key is the response, the
others are revisits that refer to it. Equal payloads are found by their digest and
length through one aggregation; no group of copies is gathered. Payload sizes and digests
are taken from the blocks that were read, and held against what the headers state.

Archives are read file by file: ``write`` keeps them near ``file_bytes`` of payload by a number of records
per file, and a file from elsewhere must fit in an executor's memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.session import shared_folder, stored

END = "\r\n"
VERSION = "WARC/1.1"
#: Payload bytes that one archive should hold.
FILE_BYTES = 16 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = {
    b"warc-record-id": 0, b"warc-concurrent-to": 1, b"warc-type": 2, b"warc-target-uri": 3, b"warc-date": 4,
    b"warc-payload-digest": 5, b"warc-refers-to-target-uri": 6, b"warc-refers-to": 7,
}


def digest(payload: Column) -> Column:
    """Base32 of the SHA-1 of a payload, in capitals."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str, key: Column) -> Column:
    """A stable urn:uuid of a record: reruns write the same archives."""
    hexed = F.md5(F.concat(F.lit(f"{kind}:"), key))
    parts = [F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write(df: DataFrame, path: str, key: str, url: str, payload: str, date: str = "2026-01-01T00:00:00Z", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Archives under ``path`` (gzip) with three records per row of ``df``.

    A null payload is empty, a null address is ``about:blank``; line ends in an address are
    taken out. Payloads below ``least_bytes`` are always responses. Every row has a transaction of its own, whatever it
    shares with others: rows that repeat key, address and payload get a number each. Of several rows of the smallest key all are
    responses, and a revisit of them names their address and digest but no record. A null key is written as an
    empty one; it has no place in the order, so it is always a response and never referred to. An empty table gives archives without records.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.regexp_replace(F.col(url), r"[\r\n]", ""), F.lit("about:blank")).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    sized = rows.withColumns({"digest": digest(F.col("payload")), "size": F.octet_length("payload").cast("long")})
    # a row for each different (key, address, payload), with its number of copies
    keyed = stored(sized.groupBy("key", "url", "digest", "size").agg(F.count("*").alias("copies")))
    named = keyed.where((F.col("size") >= least_bytes) & F.col("key").isNotNull())
    firsts = stored(named.groupBy("digest", "size").agg(F.min(F.struct("key", "url")).alias("first")))
    # how many rows of the smallest key there are: a record can be named only if it is the only one
    lone = named.join(firsts, ["digest", "size"]).where(F.col("key") == F.col("first.key")).groupBy("digest", "size").agg(F.sum("copies").alias("n"))
    firsts = stored(firsts.join(stored(lone), ["digest", "size"]))
    linked = keyed.join(firsts, ["digest", "size"], "left")
    refers = F.col("key") != F.col("first.key")
    linked = stored(linked.select(
        F.col("key").alias("_key"), F.col("url").alias("_url"), F.col("digest").alias("_digest"), "copies",
        F.when(refers, F.col("first.key")).alias("refers"), F.when(refers, F.col("first.url")).alias("refers_url"), F.col("n").alias("rivals"),
    ))
    facts = keyed.agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows")).first()
    per_file = max(1, 3 * (facts["rows"] or 0) * file_bytes // max(facts["bytes"] or 0, 1))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("url") == F.col("_url")) & (F.col("digest") == F.col("_digest"))
    # rows that are all alike are told apart by where they stand in their task; no other record names theirs
    met = sized.join(linked, same).withColumn("copy", F.when(F.col("copies") > 1, F.monotonically_increasing_id()))

    parts = [F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("digest"), F.md5("url"), F.coalesce(F.col("copy").cast("string"), F.lit(""))]
    name = F.concat_ws(":", *parts)
    response, request, metadata = (_record_id(kind, name) for kind in ("response", "request", "metadata"))

    def record(kind: Column, own_id: Column, fields: list[Column], block: Column) -> Column:
        lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), own_id), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), F.col("url"))]
        size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
        head = F.concat_ws(END, *lines, *fields, size, F.lit(""))
        return F.concat(head.cast("binary"), F.lit(END).cast("binary"), block.cast("binary"))

    # A payload is of any bytes; the text writer passes a string's bytes on as they are.
    body = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}").cast("binary"), F.col("payload"))
    is_visit = F.col("refers").isNotNull()
    first_id = _record_id("response", F.concat_ws(":", F.col("refers").cast("string"), F.col("digest"), F.md5("refers_url"), F.lit("")))
    named_first = F.when(F.col("rivals") == 1, F.concat(F.lit("WARC-Refers-To: "), first_id, F.lit(END)))
    full_digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    answer = record(
        F.when(is_visit, "revisit").otherwise("response"), response,
        [full_digest, F.lit("Content-Type: application/http; msgtype=response"),
         F.when(is_visit, F.concat(F.coalesce(named_first, F.lit("")), F.lit("WARC-Refers-To-Target-URI: "), F.coalesce("refers_url", F.lit("")), F.lit(f"{END}WARC-Profile: {_PROFILE}")))],
        F.when(is_visit, F.lit(f"HTTP/1.1 200 OK{END}{END}").cast("binary")).otherwise(body),
    )
    linked_to = F.concat(F.lit("WARC-Concurrent-To: "), response)
    asked = record(F.lit("request"), request, [linked_to, F.lit("Content-Type: application/http; msgtype=request")], F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{END}{END}")))
    about = F.concat(F.lit("key: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(f"{END}size: "), F.col("size").cast("string"), F.lit(f"{END}refers-to-key: "), F.coalesce(F.col("refers").cast("string"), F.lit("")), F.lit(END))
    told = record(F.lit("metadata"), metadata, [linked_to, F.lit("Content-Type: application/warc-fields")], about)
    records = met.select(F.explode(F.array(asked, answer, told)).alias("record"))
    written = records.select(F.col("record").cast("string")).write.option("lineSep", END + END).option("compression", "gzip")
    written.option("maxRecordsPerFile", per_file).text(path)


def _inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive in parts; compressed archives may have many members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at = 0
    while at < len(content):
        member, step = zlib.decompressobj(31), 1 << 12
        while not member.eof and at < len(content):
            part = content[at : at + step]
            yield member.decompress(part)
            # what the member did not use begins the next one; nothing else of the file is copied for it
            at += len(part) - len(member.unused_data)
            step = min(2 * step, 1 << 20)


def parse(content: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers with names in lower case, block) of each record; what is cut off at the end is left out."""
    parts, data, at = _inflated(content), bytearray(), 0

    def have(upto: int) -> bool:
        nonlocal data
        while len(data) < upto:
            more = next(parts, None)
            if more is None:
                return False
            data += more
        return True

    while True:
        if at > 1 << 20:
            del data[:at]
            at = 0
        while have(at + 2) and data[at : at + 2] == b"\r\n":
            at += 2
        searched = at
        while (end := data.find(b"\r\n\r\n", searched)) < 0:
            searched = max(at, len(data) - 3)
            if not have(len(data) + 1):
                return
        lines = bytes(data[at:end]).split(b"\r\n")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(b":") for line in lines[1:])}
        size = int(headers.get(b"content-length", b"0"))
        if not have(end + 4 + size):
            return
        yield headers, bytes(data[end + 4 : end + 4 + size])
        at = end + 4 + size


RECORD = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("record_id", "concurrent_to", "record_type", "target_uri", "date", "payload_digest", "refers_to_uri", "refers_to")]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("block_digest", T.StringType()), T.StructField("block", T.BinaryType())]
)


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; ``blocks=False`` leaves the blocks of responses out.

    payload_bytes is the size of a block without its HTTP head and block_digest the base32 of its SHA-1, both of what the archive
    holds. A header that a record lacks is null.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                held = 0
                for headers, block in parse(batch.column(0)[i].as_buffer().to_pybytes()):
                    found: list = [None] * 8
                    for name, at in _HEADERS.items():
                        if name in headers:
                            found[at] = headers[name].decode("utf-8", "replace")
                    payload = memoryview(block)
                    if headers.get(b"content-type", b"").startswith(b"application/http"):
                        payload = payload[block.find(b"\r\n\r\n") + 4 :]
                    summed = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    light = not blocks and found[2] in ("response", "revisit", "request")
                    rows.append((*found, len(payload), summed, None if light else block))
                    held += 0 if light else len(block)
                    if held > 1 << 22 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORD.names)

    return files.mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One row per response or revisit, with its request and its metadata records nested in.

    Records name the one they belong to by their concurrent-to identifier; the response's own identifier is
    the transaction's. Records that are wholly alike count once. A response without a request or metadata has null
    or an empty list there; a request or metadata whose response is missing is left out, as it belongs to no capture.
    """
    names = [c for c in records.columns if c not in ("record_id", "concurrent_to")]
    kind = F.col("record_type")
    is_answer = kind.isin("response", "revisit")
    told = records.where(is_answer | (kind.isin("request", "metadata") & F.col("concurrent_to").isNotNull()))
    whole = F.struct("record_id", *names)
    # a transaction has a handful of records; a page's copies each have their own
    met = told.select(F.when(is_answer, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("transaction"), kind.alias("kind"), whole.alias("record")).groupBy("transaction").agg(
        F.min(F.when(kind_is("request"), F.col("record"))).alias("request"),
        F.min(F.when(~kind_is("request", "metadata"), F.col("record"))).alias("response"),
        F.array_sort(F.collect_set(F.when(kind_is("metadata"), F.col("record")))).alias("metadata"),
    )
    return met.where(F.col("response").isNotNull()).select("transaction", "request", "response", "metadata")


def kind_is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def field(block: Column, name: str) -> Column:
    """A named line of a metadata block, null if it is empty."""
    found = F.regexp_extract(block.cast("string"), rf"(?m)^{re.escape(name)}: ?([^\r\n]*)", 1)
    return F.when(found != "", found)


def checked(found: DataFrame) -> DataFrame:
    """Captures with payload_bytes and payload_digest (bare base32) of their payload, from the blocks that were read.

    A revisit's are those of a response in ``found`` with the digest that the revisit states. The query
    fails where a response's block is not what its header says, or a revisit's response is missing.
    """
    stated = F.regexp_replace(F.col("response.payload_digest"), "^sha1:", "")
    visit = F.col("response.record_type") == "revisit"
    read_here = found.where(~visit).select(F.col("response.block_digest").alias("_digest"), F.col("response.payload_bytes").alias("_bytes"))
    once = stored(read_here.groupBy("_digest").agg(F.max("_bytes").alias("_bytes")))
    met = found.withColumn("_stated", stated).join(once, (F.col("_digest") == F.col("_stated")), "left")
    wrong = F.when(F.col("_digest").isNull() | (~visit & (F.col("response.block_digest") != F.col("_stated"))), F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("transaction"))))
    digest = F.coalesce(wrong.cast("string"), F.col("_digest"))
    return met.select(*found.columns, F.col("_bytes").alias("payload_bytes"), digest.alias("payload_digest"))


def page_records(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The pages written as archives to the shared folder, read back and assembled: one row per row of ``df``.

    Columns: key, payload_bytes, payload_digest, record_type, refers_to. Size and digest are those of the payload in the archive. A row with a null
    key is a response; so are all rows of the smallest key of a payload.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    write(df, path, key, url, html)
    whole = checked(stored(captures(read(df.sparkSession, path, blocks=False))))
    about = F.col("metadata")[0]["block"]
    return whole.select(
        field(about, "key").cast("long").alias(key), "payload_bytes", "payload_digest", F.col("response.record_type").alias("record_type"),
        field(about, "refers-to-key").cast("long").alias("refers_to"),
    )
