"""WARC archives in seekable Zstandard bundles.

Each task writes one bundle: whole records are grouped into frames that decompress on their own, and a skippable frame
at the end lists the frames' sizes (the public seekable format), so a reader can fetch one frame by its offset.  The
index maps each record's id to its bundle, frame and offset within the frame.  Records of equal payloads are found
by digest; one of them is a response and the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, need, new_path, salted_join

# fixed values of the Zstandard seekable format
SKIPPABLE, SEEKABLE, MAX_FRAME = 0x184D2A5E, 0x8F92EAB1, 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, bundle string, frame int, frame_offset long, frame_bytes long, offset long, length long"


def record_id(seed: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(seed.encode()).digest()[:16], version=5)}>"


def b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _header_value(s: str) -> str:
    """A URL as a header may hold it: control characters, spaces and anything beyond ASCII escaped."""
    return quote(s, safe="!#$%&'()*+,/:;=?@[]~-._")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to``) holds no payload."""
    digest = b32(hashlib.sha1(payload).digest())
    uri = _header_value(url) if url else f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(f'page:{page_id}')}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(f'page:{refers_to}')}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record in decompressed bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(headers["Content-Length"])
        yield at, headers, data[end + 4 : end + 4 + n]
        at = end + 8 + n


class BundleWriter:
    """Frames of whole records, then the seek table."""

    def __init__(self, out, frame_bytes: int, level: int = 3):
        self.out, self.frame_bytes, self.level = out, frame_bytes, level
        self.frames: list[tuple[int, int]] = []
        self.at, self.held, self.size = 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame that will hold the record, and the offset in it."""
        if self.held and self.size + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            data = zstandard.ZstdCompressor(level=self.level).compress(b"".join(self.held))
            if self.size >= MAX_FRAME << 1 or len(data) >= 1 << 32:
                raise ValueError("a record is too large for the seek table")
            self.out.write(data)
            self.frames.append((len(data), self.size))
            self.at += len(data)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the last bytes of a bundle."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("not a seekable bundle")
    f.seek(size - 9 - 8 * n)
    sizes = struct.iter_unpack("<II", f.read(8 * n))
    out, at = [], 0
    for c, d in sizes:
        out.append((at, c, d))
        at += c
    return out


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_archives(
    pages: DataFrame, out_dir: str, least_revisit_bytes: int = 0, frame_bytes: int = 1 << 20, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write ``pages`` to bundles in ``out_dir`` (a URI that all executors reach) and return the written index.

    Of records whose payloads of ``least_revisit_bytes`` bytes or more are equal, that with the largest id is the
    response and the others revisit it; smaller payloads are all responses.  A bundle is written under a temporary
    name and moved in place when it is whole; its name holds the attempt, and the index, which is committed with the
    tasks, names the bundles of the attempts that count.  A bundle of a lost attempt is in no index and isn't read.

    Null and empty html: an empty payload (a response, or a revisit where equal ones are grouped); a null url: a page
    URN; rows that repeat an id repeat its record id; rows with a null id are responses, and are never
    referred to; rows that repeat the response's id are responses too.  An empty table gives an empty index.
    """
    rows = need(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    rows = rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    groups = rows.select("sha", "page_id", F.octet_length("html").alias("n")).where(f"n >= {int(least_revisit_bytes)}")
    groups = groups.groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha", "first")
    rows = salted_join(rows, groups, "sha", F.col("page_id"), "left")
    # of a row that isn't the first of its group only the payload's length and digest are archived
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    rows = rows.select("page_id", "url", "html", refers.alias("refers_to"))
    fs, root = _open(out_dir)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(out_dir)
        task = TaskContext.get()
        name = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        part = f"{root}/.{name}"
        entries: list[tuple] = []
        writer = out = None
        try:
            for b in batches:
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if writer is None:
                        out = fs.open_output_stream(part, compression=None)
                        writer = BundleWriter(out, frame_bytes)
                        info = b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name)}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        writer.add(head.encode() + info + b"\r\n\r\n")
                    record = make_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, date)
                    frame, offset = writer.add(record)
                    entries.append((page_id, record_id(f"page:{page_id}"), frame, offset, len(record)))
            if writer is not None:
                writer.close()
                out.close()
                fs.move(part, f"{root}/{name}")
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(part)
            raise
        if entries:
            starts, at = [], 0
            for c, _ in writer.frames:
                starts.append((at, c))
                at += c
            cols = list(zip(*[(p, r, f"{out_dir}/{name}", f, *starts[f], o, n) for p, r, f, o, n in entries], strict=True))
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    index = f"{out_dir}/index"
    rows.mapInArrow(run, INDEX).write.parquet(index)
    return pages.sparkSession.read.schema(INDEX).parquet(index)


def fetch(entry: dict) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: one range of the bundle is read."""
    fs, path = _open(entry["bundle"])
    with fs.open_input_file(path) as f:
        f.seek(entry["frame_offset"])
        data = zstandard.ZstdDecompressor().decompress(f.read(entry["frame_bytes"]), max_output_size=MAX_FRAME)
    _, headers, block = next(read_records(data[entry["offset"] : entry["offset"] + entry["length"]]))
    return headers, block


def read_archives(index: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest): the records of all bundles.

    Reads each bundle named in the index by its own seek table, a frame at a time, and verifies block digests.  Records
    without a page id have a null one; records that repeat are returned each; an empty index gives no rows.
    """
    # a bundle a task: the names are few bytes, so their number deals them out and no two are put together
    bundles = materialise(index.select("bundle").distinct(), "bundles")
    bundles = bundles.repartition(max(1, bundles.count()), "bundle")
    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        for b in batches:
            for bundle in b.column(0).to_pylist():
                fs, path = _open(bundle)
                with fs.open_input_file(path) as f:
                    for at, packed, size in seek_table(f, f.size()):
                        f.seek(at)
                        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=max(size, 1))
                        rows = []
                        for _, h, block in read_records(data):
                            if h["WARC-Type"] == "warcinfo":
                                continue
                            if b32(hashlib.sha1(block).digest()) != h["WARC-Block-Digest"][5:]:
                                raise ValueError(f"damaged record {h['WARC-Record-ID']} in {bundle}")
                            head, _, payload = block.partition(b"\r\n\r\n")
                            n = int(head.rsplit(b": ", 1)[1])
                            kind, to, page = h["WARC-Type"], h.get("X-Refers-To-Page"), h["X-Page-ID"]
                            if kind == "response" and (len(payload) != n or b32(hashlib.sha1(payload).digest()) != h["WARC-Payload-Digest"][5:]):
                                raise ValueError(f"damaged payload {h['WARC-Record-ID']} in {bundle}")
                            rows.append((int(page) if page else None, unquote(h["WARC-Target-URI"]), kind, int(to) if to else None, payload if kind == "response" else None, n, h["WARC-Payload-Digest"][5:]))
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return bundles.mapInArrow(run, schema)


def roundtrip(pages: DataFrame, out_dir: str | None = None, **options) -> DataFrame:
    """Write the archives (below the shared folder unless ``out_dir`` is given) and read them back; ids are whole numbers."""
    return read_archives(write_archives(pages, out_dir or new_path(pages.sparkSession, "warc"), **options))


