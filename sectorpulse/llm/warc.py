"""Operator 7, WARC archives by way of a chunked record table.

A payload is cut into rows of (record, chunk number, bytes), and from there on only chunks move: each
becomes a WARC record of its own, the first a ``response``, later ones ``continuation`` segments, as
the standard has it for records over several files. A record's chunks carry a running digest, so the
writer needs no second look at the payload and a reader can check every prefix. An archive file is
closed once it holds ``archive_bytes``, so no file and no task holds an oversized payload whole.

Of equal payloads of at least ``revisit_from`` bytes the one with the smallest id is a response; the
others are ``revisit`` records that refer to it. Files are written by Spark's own text writer, one row
and one gzip file for each archive, so its commit protocol covers lost tasks; its row separator is the
line end that closes the last record.

Reading parses each file; records of one chunk are done there, the chunks of longer ones are sorted by
record and number and stream through a digest.

Defined results: a null payload counts as empty; a null url is left out; rows without an id are
responses unless they repeat the payload of a row with one; rows that repeat an id and a payload are all
responses if theirs is the smallest id; an empty table gives no file and an empty result; other columns
are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorpulse.llm.common import BROADCAST_KEYS, text_or_empty, written

CHUNK_BYTES = 1 << 16
ARCHIVE_BYTES = 4 << 20
REVISIT_FROM = 100
#: Capture time in the records; a parameter, so that the same pages give the same archives.
DATE = "1970-01-01T00:00:00Z"

END = b"\r\n"
#: Characters that stay as they are in a target URI.
URI_SAFE = ":/?#[]@!$&'()*+,;=%-._~"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{name}: {value}".encode() for name, value in fields if value is not None)]
    lines.append(b"Content-Length: %d" % len(block))
    return END.join([*lines, b"", block, b"", b""])


def records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(fields, block) of the records of an archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].split(END)
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.decode().split(": ", 1) for line in lines)
        start = end + 4
        size = int(fields["Content-Length"])
        yield fields, view[start : start + size]
        at = start + size + 4


def _http(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def _page(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def chunk_records(rows: Iterator[dict], task: int, date: str) -> Iterator[bytes]:
    """A WARC record for each row of the chunked record table, which has a record's chunks in order."""
    serial, digest = -1, None
    for row in rows:
        k, last = row["chunk"], row["chunk"] == row["n_chunks"] - 1
        if k == 0:
            serial, digest, sent = serial + 1, hashlib.sha256(), 0
        digest.update(row["bytes"])
        http = _http(row["n_bytes"]) if k == 0 else b""
        block = http + row["bytes"]
        sent += len(block)
        url = row["url"] and quote(row["url"], safe=URI_SAFE)
        fields = [("WARC-Date", date), ("WARC-Target-URI", url), ("X-Record", f"{task}-{serial}")]
        if row["revisit"]:
            profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
            fields += [("WARC-Type", "revisit"), ("WARC-Record-ID", _page(row["id"])), ("WARC-Profile", profile)]
            fields += [("WARC-Refers-To", _page(row["refers_to"])), ("WARC-Payload-Digest", f"sha256:{row['digest']}")]
        elif k == 0:
            fields += [("WARC-Type", "response"), ("WARC-Record-ID", _page(row["id"]))]
            fields += [("WARC-Payload-Digest", f"sha256:{row['digest']}")]
        else:
            fields += [("WARC-Type", "continuation"), ("WARC-Record-ID", _page(row["id"])[:-1] + f":{k + 1}>")]
            fields += [("WARC-Segment-Origin-ID", _page(row["id"]))]
        fields.append(("Content-Type", "application/http; msgtype=response"))
        if row["n_chunks"] > 1:
            fields.append(("WARC-Segment-Number", k + 1))
            fields.append(("X-Running-Digest", f"sha256:{digest.hexdigest()}"))
            fields.append(("WARC-Segment-Total-Length", sent if last else None))
        yield record(fields, block)


def write(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    chunk_bytes: int = CHUNK_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    revisit_from: int = REVISIT_FROM,
    date: str = DATE,
) -> None:
    """Write the archives of ``pages`` into ``folder``."""
    payload = text_or_empty(payload_column).cast("binary")
    rows = pages.select(
        F.col(id_column).alias("id"),
        F.col(url_column).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
        F.sha2(payload, 256).alias("digest"),
    )
    # One row for each payload that occurs again, combined before the shuffle.
    again = rows.where(F.col("n_bytes") >= revisit_from).groupBy("digest")
    again = again.agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(again.select("digest", "original"), "repeated-payloads")
    small = again.count() <= BROADCAST_KEYS
    rows = rows.join(F.broadcast(again) if small else again, "digest", "left")
    revisit = F.coalesce(F.col("id").isNull() | (F.col("id") != F.col("original")), F.lit(True)) & F.col("original").isNotNull()
    n_chunks = F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk_bytes))).cast("int")
    chunks = rows.select("*", revisit.alias("revisit"), n_chunks.alias("n_chunks")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk")
    )
    part = F.substring(F.col("payload"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    table = chunks.select(
        "id",
        "url",
        "n_bytes",
        "digest",
        "revisit",
        F.when(F.col("revisit"), F.col("original")).alias("refers_to"),
        "n_chunks",
        "chunk",
        F.when(F.col("revisit"), F.lit(b"")).otherwise(part).alias("bytes"),
    )

    def archives(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
        for made in chunk_records(rows, TaskContext.get().partitionId(), date):
            held.append(made)
            size += len(made)
            if size >= archive_bytes:
                yield _archive(held)
                held, size = [], 0
        if held:
            yield _archive(held)

    files = table.mapInArrow(archives, "content binary").select(F.col("content").cast("string"))
    options = {"maxRecordsPerFile": 1, "lineSep": END.decode(), "compression": "gzip"}
    files.write.options(**options).text(folder)


def _archive(held: list[bytes]) -> pa.RecordBatch:
    # The writer's row separator is the last line end.
    return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[: -len(END)]], pa.binary())], ["content"])


PARSED = (
    "id long, record string, record_type string, refers_to long, segment long, n_bytes long, digest string, chunk binary"
)


def _number(urn: str | None) -> int | None:
    name = urn and urn.split(":")[2].rstrip(">")
    return None if name in (None, "none") else int(name)


def _parsed(fields: dict[str, str], block: memoryview) -> tuple:
    """A row of ``PARSED``: with the digest if the record is whole, else with its chunk."""
    kind, segment = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 0))
    body, n_bytes = block, len(block)
    if kind != "continuation":
        head = bytes(block[:400]).index(b"\r\n\r\n") + 4
        http = dict(line.split(": ", 1) for line in bytes(block[: head - 4]).decode().split("\r\n")[1:])
        body, n_bytes = block[head:], int(http["Content-Length"])
    page = _number(fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]))
    start = (page, fields["X-Record"], kind, _number(fields.get("WARC-Refers-To")), segment, n_bytes)
    if kind == "revisit":
        return (*start, fields["WARC-Payload-Digest"].removeprefix("sha256:"), None)
    if segment:
        return (*start, None, bytes(body))
    return (*start, hashlib.sha256(body).hexdigest(), None)


RECORDS = "id long, n_bytes long, digest string, record_type string, refers_to long"


def _whole(batches) -> Iterator[pa.RecordBatch]:
    """Records of several chunks, which come in order: a digest over the chunks as they pass."""
    name, first, digest, size = None, None, None, 0
    for batch in batches:
        done = []
        for k in range(batch.num_rows):
            (row,) = batch.slice(k, 1).to_pylist()
            if row["record"] != name:
                if name is not None:
                    done.append((first["id"], size, digest.hexdigest(), "response", None))
                name, first, digest, size = row["record"], row, hashlib.sha256(), 0
            digest.update(row["chunk"])
            size += len(row["chunk"])
        if done:
            yield _rows(done, RECORDS)
    if name is not None:
        yield _rows([(first["id"], size, digest.hexdigest(), "response", None)], RECORDS)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    arrays = [pa.array(x, kinds[kind]) for x, kind in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(id, n_bytes, digest, record_type, refers_to) of every record in the archives of ``folder``."""

    def parse(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = gzip.decompress(content.as_py())
                if data:  # Spark's writer leaves an empty file for an empty table
                    yield _rows([_parsed(*found) for found in records(data)], PARSED)

    files = spark.read.format("binaryFile").load(folder).select("content")
    parsed = written(files.mapInArrow(parse, PARSED), "warc-records")
    single = parsed.where("digest IS NOT NULL").select("id", "n_bytes", "digest", "record_type", "refers_to")
    chunks = parsed.where("digest IS NULL").select("id", "record", "segment", "chunk")
    chunks = chunks.repartition("record").sortWithinPartitions("record", "segment")
    return single.union(chunks.mapInArrow(_whole, RECORDS))
