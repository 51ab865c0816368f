"""WARC archives in ZIP packages, read in ranges.

A package is a ZIP file with two STORED members: ``archive/data.warc.gz``, one
gzip member a record, and ``indexes/index.cdxj``, one line a record with its
place.  The reader parses the end-of-directory records, ZIP64 ones included, and
the central directory, finds where a member's bytes begin, and reads single
records by range: nothing is extracted.

Packages are files in a folder of the shared store, written by the tasks which make
them and listed in a catalogue (path, n_records, n_bytes).  A file is written under
another name and then renamed; what an attempt that was lost leaves isn't listed and
goes with the folder.  The reader opens a listed file, seeks and reads: the directory,
the index, and each record.  ``PackageReader`` takes any function that reads a range.

Payloads which are equal are written once: the row of the largest page_id is a
response, the others are revisits that refer to it.  A null html is an empty
payload; a null page_id counts as the smallest; rows that repeat the largest
page_id are all responses; page_id is a whole number, another one is an error.  A null
url stays null; CR and LF in one are written, and come back, as %0D and %0A.  An
empty table gives no packages.  Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as store
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload bytes of a package, unless one page is longer, and its records at most.
PACKAGE_BYTES, PACKAGE_RECORDS = 16 << 20, 20_000
#: Records that a task reads at once, about; a package is read in so many ranges of its index.
READ_RECORDS = 2000
#: A fixed time, so that reruns write the same bytes.
DATE = "2000-01-01T00:00:00Z"

PACKAGES = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


# -- records ------------------------------------------------------------------


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response, or a revisit without the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _id(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(data: bytes) -> tuple:
    """A RECORDS row of one record's gzip member; payload is null for a revisit."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(body) != length or digest32(body) != digest):
        raise ValueError(f"the record of {fields['WARC-Record-ID']} is damaged")
    return (
        _id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, digest, fields["WARC-Type"],
        _id(fields["WARC-Refers-To"]) if revisit else None, None if revisit else body,
    )


# -- ZIP packages -------------------------------------------------------------


def package(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> Iterator[bytes]:
    """The parts of a ZIP file of STORED members, each given by its parts; zip64
    forces the 64-bit records."""
    at, central = 0, []
    for name, parts in members:
        raw, size, crc = name.encode(), sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        big = zip64 or size >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        sizes = (0xFFFFFFFF, 0xFFFFFFFF) if big else (size, size)
        local = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        version = 45 if big else 20
        yield struct.pack("<4sHHHHHIIIHH", b"PK\3\4", version, 0x800, 0, 0, 0x21, crc, *sizes, len(raw), len(local)) + raw + local
        yield from parts
        central.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", version, version, 0x800, 0, 0, 0x21, crc, *sizes, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + raw + extra)
        at += 30 + len(raw) + len(local) + size
    n, size = len(central), sum(map(len, central))
    yield from central
    if zip64 or n >= 0xFFFF or at + size >= 0xFFFFFFFF:
        yield struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<4sIQI", b"PK\6\7", 0, at + size, 1)
        yield struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    else:
        yield struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, size, at, 0)


class PackageReader:
    """STORED members of a ZIP file, by a function read(offset, length)."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        self.places: dict[str, tuple[int, int]] = {}
        tail_at = max(0, size - 65557)  # the end record and the longest comment
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no ZIP end-of-directory record")
        n, length, at = struct.unpack_from("<HII", tail, end + 10)
        if (n == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF) and tail_at + end >= 20:
            locator = read(tail_at + end - 20, 20)
            if locator[:4] == b"PK\6\7":
                found = read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if found[:4] != b"PK\6\6":
                    raise ValueError("no ZIP64 end-of-directory record")
                n, length, at = struct.unpack_from("<QQQ", found, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, k = read(at, length), 0
        for _ in range(n):
            if directory[k : k + 4] != b"PK\1\2":
                raise ValueError("damaged central directory")
            method = struct.unpack_from("<H", directory, k + 10)[0]
            packed, full, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", directory, k + 20)
            local = struct.unpack_from("<I", directory, k + 42)[0]
            name = directory[k + 46 : k + 46 + name_n].decode()
            extra, e = directory[k + 46 + name_n : k + 46 + name_n + extra_n], 0
            while e + 4 <= len(extra):
                kind, size_n = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # holds, in this order, only what didn't fit
                    wide = list(struct.unpack_from(f"<{size_n // 8}Q", extra, e + 4))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    local = wide.pop(0) if local == 0xFFFFFFFF else local
                e += 4 + size_n
            self.members[name] = method, local, packed
            k += 46 + name_n + extra_n + note_n

    def place(self, name: str) -> tuple[int, int]:
        """Where a STORED member's bytes begin, and their number."""
        if name in self.places:
            return self.places[name]
        method, local, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read in ranges")
        head = self.read(local, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        name_n, extra_n = struct.unpack_from("<HH", head, 26)
        self.places[name] = local + 30 + name_n + extra_n, size
        return self.places[name]

    def entries(self, first: int = 0, n: int | None = None) -> Iterator[dict]:
        """n entries of the index from the first one on; all, if n is None."""
        at, size = self.place(INDEX)
        lines = self.read(at, size).decode().splitlines()
        for line in lines[first : None if n is None else first + n]:
            yield json.loads(line.split(" ", 2)[2])

    def record(self, entry: dict) -> bytes:
        begin, size = self.place(entry["filename"])
        if entry["offset"] + entry["length"] > size:
            raise ValueError("a record ends after its member")
        return self.read(begin + entry["offset"], entry["length"])


def build_package(records: list[tuple[str, str, bytes]], zip64: bool = False) -> Iterator[bytes]:
    """(url, digest, gzip member) of each record, in this order."""
    at, lines = 0, []
    for url, digest, data in records:
        place = {"filename": ARCHIVE, "offset": at, "length": len(data), "digest": digest}
        lines.append(f"{json.dumps(url)[1:-1].replace(' ', '%20') or '-'} {DATE} {json.dumps(place)}")
        at += len(data)
    index = "".join(x + "\n" for x in sorted(lines)).encode()
    return package([(ARCHIVE, [x for _, _, x in records]), (INDEX, [index])], zip64)


# -- the shared store, as tasks see it ----------------------------------------


def open_store(path: str) -> tuple[store.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        path = "file:///" + rest.lstrip("/")
    elif colon and scheme in ("s3a", "s3n"):
        path = "s3:" + rest
    return store.FileSystem.from_uri(path)


def write_file(folder: str, records: list[tuple[str, str, bytes]], zip64: bool = False) -> tuple[str, int]:
    """Path and size of a package of these records.  Its name is that of its
    content, so that a task which is run again writes the same file."""
    name, size = hashlib.sha1(), 0
    for part in build_package(records, zip64):
        name.update(part)
        size += len(part)
    path = f"{folder}/{name.hexdigest()}.wacz"
    where, at = open_store(path)
    draft = f"{at}.{uuid.uuid4().hex}"
    where.create_dir(at.rpartition("/")[0], recursive=True)
    with where.open_output_stream(draft) as out:
        for part in build_package(records, zip64):
            out.write(part)
    where.move(draft, at)
    return path, size


def open_package(path: str) -> tuple[PackageReader, Callable[[], None]]:
    """A reader of a stored package, by seek and read; and what closes it."""
    where, at = open_store(path)
    file = where.open_input_file(at)

    def read(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    return PackageReader(read, file.size()), file.close


# -- DataFrames ---------------------------------------------------------------


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for a response).

    Digests that occur once need no partner, so only those of repeated payloads
    are joined to; a hot payload is one row of that table.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    repeated = base.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    repeated = common.stored(repeated.drop("n"), "repeated")  # so that a hot payload's rows can be split in the join
    refers = F.when(F.coalesce(F.col("page_id") < F.col("first_id"), F.col("first_id").isNotNull()), F.col("first_id"))
    return base.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, *, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write all pages as packages to a folder of the shared store; the stored
    catalogue of them.  Each task makes packages of package_bytes."""
    common.bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path, n_bytes = write_file(folder, held, zip64)
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(held)], "n_bytes": [n_bytes]})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                data = record(page_id, url, payload, b32, refers_to, refers_to is not None)
                held.append((url or "", b32, data))
                size += len(payload)
                if size >= package_bytes or len(held) >= PACKAGE_RECORDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return common.stored(with_revisits(pages).mapInArrow(run, PACKAGES), "catalogue")


def read_packages(catalogue: DataFrame, *, payloads: bool = True) -> DataFrame:
    """RECORDS rows of the packages in a catalogue.  A package is read in ranges of
    its index, by several tasks; each record by its own range."""
    spark = catalogue.sparkSession
    common.bounded_batches(spark)
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, close = open_package(path)
                rows, size = [], 0
                for entry in reader.entries(first, READ_RECORDS):
                    row = parse_record(reader.record(entry))
                    rows.append(row if payloads else (*row[:-1], None))
                    size += len(row[-1] or b"") if payloads else 0
                    if len(rows) >= 1024 or size >= common.PIECE_BYTES:
                        yield rows_to_batch(rows)
                        rows, size = [], 0
                close()
                if rows:
                    yield rows_to_batch(rows)

    ranges = catalogue.select("path", F.explode(F.sequence(F.lit(0), F.col("n_records") - 1, F.lit(READ_RECORDS))).alias("first"))
    tasks = max(spark.sparkContext.defaultParallelism * 2, ranges.count() // 16)
    return ranges.repartition(tasks).mapInArrow(run, RECORDS)
