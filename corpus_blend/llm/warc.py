"""WARC archives: a writer that stores equal payloads once, and a reader that splits files.

An archive is a file of gzip members, one per record. The reader deals out byte ranges: a task
looks for the first gzip magic in its range whose member really inflates to a record header, owns
every record that starts inside the range, and reads on past its end to finish the last.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_blend.llm.common import new_folder, open_input, stage, write_file

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SPLIT_BYTES = 16 << 20
FILE_BYTES = 256 << 20
LEVEL = 6
CHUNK = 1 << 20

READ_SCHEMA = (
    "file string, offset bigint, record_id string, record_type string, target_uri string, "
    "refers_to string, payload binary, payload_bytes bigint, payload_digest string"
)


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row under ``folder``; returns a row per file: ``path, records, bytes``.

    Rows with equal payloads of at least ``min_bytes`` (UTF-8 bytes of the text) are stored once:
    the smallest id is a ``response``, the others are ``revisit`` records that refer to it.
    A null payload is empty, a null url is left out of the header. Rows that repeat the id of the
    response are responses themselves. A null id is written as ``null`` and is no response if its
    payload has any other id. No rows give no files.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.encode(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= min_bytes
    # Written first, so that its true size decides between a broadcast and a shuffle of payloads.
    originals = stage(
        rows.where(large)
        .groupBy("digest")
        .agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "original"),
        "warc-originals",
    )
    linked = rows.join(originals, "digest", "left").withColumn(
        "original",
        F.when(large & F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original")), F.col("original")),
    )
    write = _writer(folder, date, file_bytes)
    done = linked.select("id", "url", "payload", "original").mapInArrow(
        write, "path string, records bigint, bytes bigint"
    )
    return stage(done, "warc-files")


def _writer(folder: str, date: str, file_bytes: int):
    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = (
            row
            for batch in batches
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "original")), strict=True)
        )
        waiting = next(rows, None)
        number = 0
        while waiting is not None:
            path = f"{folder}/part-{part:06d}-{number:04d}.warc.gz"
            records = size = 0
            with write_file(path) as out:
                while waiting is not None and size < file_bytes:
                    member = _member(record(*(x.as_py() for x in waiting), date))
                    out.write(member)
                    records, size = records + 1, size + len(member)
                    waiting = next(rows, None)
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    return write


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _urn(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page, url, payload: bytes, original, date: str) -> bytes:
    """One record. A revisit holds the answer's header only, whose length still is the payload's."""
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = answer.encode() + (payload if original is None else b"")
    fields = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", _urn(page)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if original is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(original))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the archives in ``folder``, once, in ranges of ``split_bytes``.

    ``payload`` is null in a revisit; length and digest of its full payload come from its headers.
    For other records they are taken from the payload that was read. A record that breaks off, or
    whose payload belies its digest, is an error: silent loss is worse. An empty folder must exist
    and gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.where("length > 0").select("path", "length")
    ranges = files.select(
        "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes))).alias("start")
    )
    n = ranges.count()
    read = _reader(split_bytes)
    return ranges.repartition(max(1, min(n, 20_000)), "path", "start").mapInArrow(read, READ_SCHEMA)


def _reader(split_bytes: int):
    schema = pa.schema(
        [
            ("file", pa.string()),
            ("offset", pa.int64()),
            ("record_id", pa.string()),
            ("record_type", pa.string()),
            ("target_uri", pa.string()),
            ("refers_to", pa.string()),
            ("payload", pa.binary()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
        ]
    )

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, size = [], 0
                with open_input(path) as source:
                    for offset, data in records(source, start, start + split_bytes):
                        rows.append({"file": path, "offset": offset, **parse(data)})
                        size += len(data)
                        if size > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def records(source, start: int, end: int):
    """``(offset, inflated record)`` of every record that starts in ``[start, end)``."""
    place = _next_member(source, start, end)
    while place is not None:
        data, after = _inflate(source, place)
        yield place, data
        place = _next_member(source, after, end)


def _next_member(source, start: int, end: int) -> int | None:
    """The first place in ``[start, end)`` where a record begins; magic bytes may straddle the end."""
    size = source.size()
    while start < min(end, size):
        source.seek(start)
        data = source.read(min(CHUNK, end - start) + len(MAGIC) - 1)
        found = data.find(MAGIC)
        while found >= 0:
            if _is_record(source, start + found):
                return start + found
            found = data.find(MAGIC, found + 1)
        start += CHUNK
    return None


def _is_record(source, place: int) -> bool:
    """Magic bytes also turn up inside compressed data: inflate some bytes and look for the header."""
    source.seek(place)
    try:
        head = zlib.decompressobj(31).decompress(source.read(4096), 64)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.") and b"\r\n" in head


def _inflate(source, place: int) -> tuple[bytes, int]:
    unpacker, parts, at = zlib.decompressobj(31), [], place
    source.seek(place)
    while not unpacker.eof:
        data = source.read(64 << 10)
        if not data:
            raise ValueError(f"the record at {place} breaks off")
        parts.append(unpacker.decompress(data))
        at += len(data)
    return b"".join(parts), at - len(unpacker.unused_data)


def parse(data: bytes) -> dict:
    """Headers and payload of one inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {
        k.strip().lower(): v.strip()
        for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    }
    block = rest[: int(fields["content-length"])]
    answer, _, payload = block.partition(b"\r\n\r\n")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    row = {
        "record_id": fields["warc-record-id"].strip("<>"),
        "record_type": fields["warc-type"],
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
    }
    if row["record_type"] == "revisit":
        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", answer)[1])
        return row | {"payload": None, "payload_bytes": length, "payload_digest": said}
    if not fields.get("content-type", "").startswith("application/http"):
        payload = block
    found = digest(payload)
    if said and said != found:
        raise ValueError(f"{row['record_id']}: the payload's digest is {found}, the header says {said}")
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}
