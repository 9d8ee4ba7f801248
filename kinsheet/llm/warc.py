"""WARC archives: written by Spark's own file commit, read back by byte ranges.

Every record is a gzip member of its own. Spark's text writer puts the members into files: a
member's last byte is the top byte of its length, zero below 16 MiB, so the member without it
is a "line" and the zero byte the line separator. Longer records are followed by an empty
member, which ends in zero as well. Files so have nothing but gzip members.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsheet.llm import common

#: Payloads below this many bytes are always stored.
REVISIT_BYTES = 1000
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
#: Formats. Fixed values.
MAGIC = b"\x1f\x8b\x08"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003030000000000000000" + "00")


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page_id, url, payload: bytes, size: int, digest: str, keeper) -> bytes:
    """One record. A revisit (``keeper`` set) has the HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    body = http.encode() + (b"" if keeper is not None else payload)
    head = [
        VERSION,
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if keeper is not None:
        head += [f"WARC-Refers-To: {_name(keeper)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def with_keepers(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, payload, digest, size, keeper)``; ``keeper`` is set for revisits.

    Payloads are equal if their SHA-1 and length are. The digests that occur more than once
    are found from ids and digests alone, aggregated before the shuffle; a digest of a third
    of all pages is one row there and a hot key only in a join that Spark can split.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    many = (
        rows.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND best IS NOT NULL")
        .drop("n")
    )
    keeper = F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))
    return rows.join(many, ["digest", "size"], "left").withColumn("keeper", keeper).drop("best")


def write_archive(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """A record a page; of equal payloads of ``least`` bytes or more the largest id's is kept.

    A null html is an empty payload. Rows that repeat the kept id are responses too; a group
    whose ids are all null has no name to refer to and is stored whole. A null url has no
    target header. An empty table writes no records. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "payload"):
                members = []
                for row in part.to_pylist():
                    data = record(
                        row["page_id"],
                        row["url"],
                        row["payload"],
                        row["size"],
                        row["digest"],
                        row["keeper"],
                    )
                    member = _gzip(data)
                    if member[-1]:
                        member += EMPTY_MEMBER
                    members.append(member[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    members = with_keepers(pages, least).mapInArrow(run, "member binary")
    lines = members.select(F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("compression", "none").text(path)


# Reading -------------------------------------------------------------------------------------


class _Range:
    """Bytes of a file from a start on, read as they are asked for and dropped when passed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.size = file, size
        self.start, self.data = start, b""

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.start + len(self.data)
        if end > have:
            self.file.seek(have)
            self.data += self.file.read(max(READ_BYTES, end - have))

    def drop(self, start: int) -> None:
        self.upto(start)
        self.data = self.data[start - self.start :]
        self.start = start


def _member(window: _Range, at: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at ``at`` and the member's end; None if it is none.

    The member's own header and the first bytes it decodes to are checked before the rest.
    """
    window.upto(at + 10)
    head = window.data[at - window.start : at - window.start + 10]
    if len(head) < 10 or head[3] & 0xE0:
        return None
    opened = zlib.decompressobj(31)
    mark = VERSION[:5].encode()
    parts: list[bytes] = []
    first, position, step = b"", at, 512
    while not opened.eof:
        window.upto(position + step)
        chunk = window.data[position - window.start : position - window.start + step]
        if not chunk:
            return None
        try:
            parts.append(opened.decompress(chunk))
        except zlib.error:
            return None
        position += len(chunk)
        if len(first) < len(mark):
            first = (first + parts[-1])[: len(mark)]
            if not mark.startswith(first):
                return None
        step = READ_BYTES
    return (b"".join(parts), position - len(opened.unused_data)) if first == mark else None


def scan(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """Records whose gzip member starts in ``[start, end)`` of a file of ``size`` bytes."""
    window = _Range(file, start, size)
    at = start
    while at < end:
        if at - window.start > READ_BYTES:
            window.drop(at)
        window.upto(at + 4096)
        found = window.data.find(MAGIC, at - window.start)
        if found < 0:
            have = window.start + len(window.data)
            if have >= size:
                return
            # A magic number may lie across the end of what is read: look at its last bytes again.
            at = max(at + 1, have - len(MAGIC) + 1)
            continue
        at = window.start + found
        if at >= end:
            return
        got = _member(window, at)
        if got is None:
            at += 1
        else:
            yield got[0]
            at = got[1]


def parse(data: bytes) -> dict:
    """Fields of a record. The digest of a stored payload is computed, not believed."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (
        hashlib.sha1(payload).hexdigest() != digest or len(payload) != size
    ):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload": payload if fields["warc-type"] == "response" else None,
    }


FIELDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def read_archive(
    spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payloads: bool = False
) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of all records.

    Files are listed by Spark without their content and cut into byte ranges; a task looks
    for records in its ranges and reads on beyond the end for the last one it owns. The
    archive has to be where all executors can open it by URI.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes)))
    ranges = files.where("length > 0").select("path", "length", begin.alias("begin"))
    ranges = ranges.repartition(common.parallelism(spark))
    schema = FIELDS.append(pa.field("payload", pa.binary())) if payloads else FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uri = re.sub(r"^file:/+", "file:///", row["path"])
                system, where = fs.FileSystem.from_uri(uri)
                with system.open_input_file(where) as file:
                    held, size = [], 0
                    end = row["begin"] + split_bytes
                    for data in scan(file, row["begin"], end, row["length"]):
                        held.append(parse(data))
                        size += len(data) if payloads else 256
                        if not payloads:
                            held[-1].pop("payload")
                        if size > common.SLICE_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return ranges.mapInArrow(run, columns + (", payload binary" if payloads else ""))
