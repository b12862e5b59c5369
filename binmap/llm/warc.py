"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offset.

The writer puts the records of a partition into files that are one gzip stream each, as some crawlers do; nothing in
such a file can be read without all before it. The normaliser inflates each file once, writes every
record as a gzip member of its own, and beside it an index of the members' offsets and lengths.
The reader seeks by that index. Every step holds one record at a time.

Records with equal payloads of at least MIN_REVISIT bytes: the one with the largest page_id is a response
and the others are revisits of it (rows that repeat that page_id are responses too). Smaller payloads are
always responses. Null html is an empty payload; a null page_id stays null, and is smaller than any other.
An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, open_file, write_file, written

MIN_REVISIT = 1000
LEVEL = 3
#: Payload bytes after which a partition's next record begins a new file.
FILE_BYTES = 128 << 20
BLOCK = 1 << 18

RECORD = "page_id long, url string, html binary, digest string, record_type string, refers_to long"
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_types(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as records to write, with digest, record_type and refers_to."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("html"), F.sha1(payload).alias("digest"))
    same = plain.where(F.length("html") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    # Only digests that occur again are joined; AQE splits a digest that many pages share.
    same = same.where((F.col("n") > 1) & F.col("owner").isNotNull()).select(F.col("digest").alias("same"), "owner")
    other = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    # Small payloads can't match, so the many equal ones don't meet.
    large = plain.where(F.length("html") >= MIN_REVISIT).join(same, F.col("digest") == F.col("same"), "left")
    joined = large.unionByName(plain.where(F.length("html") < MIN_REVISIT), allowMissingColumns=True)
    return joined.select("page_id", "url", "html", "digest", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("owner")).alias("refers_to"))


def record(page_id: int | None, url: str | None, html: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the payload's digest and length but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http + (b"" if kind == "revisit" else html)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%-._~')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A row of ROW from a record; a response whose payload doesn't have its digest raises ValueError."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: None if (x := fields.get(name, "<urn:page:null>")[10:-1]) == "null" else int(x)
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To")}


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Files (path, records) that hold the records, one gzip stream a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to")), strict=True))
        pending = next(rows, None)
        part, number = TaskContext.get().partitionId(), 0
        while pending is not None:
            written_records = 0

            def stream() -> Iterator[bytes]:
                nonlocal pending, written_records
                packer, held = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                while pending is not None and held < FILE_BYTES:
                    yield packer.compress(record(*pending))
                    held += len(pending[2])
                    written_records += 1
                    pending = next(rows, None)
                yield packer.flush()

            path = f"{folder}/whole-{part:06d}-{number:04d}.warc.gz"
            write_file(path, stream())
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([written_records], pa.int64())})
            number += 1

    return records.mapInArrow(run, "path string, records long")


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The whole records of a gzip file of one or more members, each inflated once."""
    unpacker, data = zlib.decompressobj(31), bytearray()
    need = None  # bytes of the record at hand, once its header is there

    def whole() -> Iterator[bytes]:
        nonlocal need
        at = 0
        while True:
            if need is None:
                if (end := data.find(b"\r\n\r\n", at)) < 0:
                    break
                length = next(line for line in bytes(data[at:end]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
                need = end - at + 4 + int(length.split(b":")[1]) + 4
            if len(data) - at < need:
                break
            yield bytes(data[at : at + need])
            at, need = at + need, None
        del data[:at]

    for chunk in chunks:
        while chunk:
            data += unpacker.decompress(chunk, BLOCK)  # so many bytes at once, however well they were packed
            chunk = unpacker.unconsumed_tail
            if unpacker.eof and unpacker.unused_data:
                chunk, unpacker = unpacker.unused_data, zlib.decompressobj(31)
            yield from whole()
    while not unpacker.eof and (more := unpacker.decompress(unpacker.unconsumed_tail, BLOCK)):
        data += more
        yield from whole()
    if data or not unpacker.eof:
        raise ValueError("the archive ends within a record")


def normalise_file(path: str, to: str) -> tuple[int, int]:
    """Rewrite a file so that each record is a gzip member of its own, with an index beside it (to + ".idx"). Records and bytes written."""
    index: list[bytes] = []
    offset = 0

    def blocks(f) -> Iterator[bytes]:
        while got := f.read(BLOCK):
            yield got

    def members() -> Iterator[bytes]:
        nonlocal offset
        with open_file(path) as f:
            for raw in inflate(blocks(f)):
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                name = raw[raw.index(b"WARC-Record-ID: ") + 16 :].split(b"\r\n", 1)[0].decode()
                index.append(json.dumps({"offset": offset, "length": len(member), "id": name}).encode() + b"\n")
                offset += len(member)
                yield member

    write_file(to, members())
    write_file(f"{to}.idx", index)
    return len(index), offset


def normalise(files: DataFrame) -> DataFrame:
    """The normalised files (path, records, bytes) of monolithic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                to = path.replace("/whole-", "/members-")
                n, size = normalise_file(path, to)
                yield pa.RecordBatch.from_pydict({"path": [to], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return files.select("path").mapInArrow(run, "path string, records long, bytes long")


def read_members(path: str, wanted: set[str] | None = None) -> Iterator[bytes]:
    """Records of a normalised file by its index: all, or those with these ids; other members aren't inflated."""
    with open_file(f"{path}.idx") as f:
        entries = [json.loads(line) for line in f.read().splitlines()]
    with open_file(path) as f:
        for e in entries:
            if wanted is None or e["id"] in wanted:
                f.seek(e["offset"])
                yield zlib.decompress(f.read(e["length"]), 31)


def read(files: DataFrame) -> DataFrame:
    """A row of ROW for every record of normalised files."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    schema = pa.schema([(c, pa.string() if c in ("payload_digest", "record_type") else pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for raw in read_members(path):
                    rows.append(parse(raw))
                    if len(rows) == 5_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path").mapInArrow(run, ROW)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to monolithic archives, normalise them, and read every record back by offset."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    whole = written(write_monolithic(with_types(pages), folder), "warc-files")
    spread = lambda df: df.repartition(max(1, df.count()))  # noqa: E731  a task for each file
    members = written(normalise(spread(whole)), "warc-members")
    return read(spread(members))
