"""WARC records in ZIP archives: a writer, and a reader that fetches records by byte range without extraction.

The writer's archives are ZIP files whose members are stored, not deflated: ``archive/data.warc.gz`` (one gzip member
per record) and ``indexes/index.cdx`` (a JSON line per record: offset and length inside the first member). The reader
looks for the end-of-central-directory record at the tail, follows its ZIP64 locator if there is one, walks the central
directory and finds where each member's bytes begin. Of any package it takes the members under ``archive/`` that are WARC
files and those under ``indexes/`` that are indexes, of whatever names and however many; other members (page lists, logs)
may be deflated and are never read. Index lines hold a JSON object, behind a key and a time stamp or alone. Records
are read by range; members without an index entry are walked record by record.

Archives are written to the folder the cluster shares, under names of their own for every task attempt; only names in
the returned manifest count, so a repeated or lost attempt leaves nothing but an unread file.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import map_arrow, raw, slices
from kmerloom.storage import materialize, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 32 << 20
U32, U16 = 0xFFFFFFFF, 0xFFFF
#: Members that hold records, and those that say where: names in web archive packages.
ARCHIVES, INDEXES = re.compile(r"^archive/.*\.warc(\.gz)?$"), re.compile(r"^indexes/.*\.(cdxj?|idx)(\.gz)?$")
STORED, DEFLATED = 0, 8
#: Signatures of the ZIP format: fixed values.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


def zip_bytes(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> Iterator[bytes]:
    """A ZIP file of stored members, in chunks; with ZIP64 records where a value needs them, or always if asked."""
    at, central = 0, b""
    for name, chunks in members:
        size, crc, label = sum(map(len, chunks)), 0, name.encode()
        for c in chunks:
            crc = zlib.crc32(c, crc)
        big = zip64 or size >= U32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        short = U32 if big else size
        head = LOCAL + struct.pack("<5H3L2H", 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short, len(label), len(extra)) + label + extra
        far = zip64 or at >= U32
        extra = (struct.pack("<QQ", size, size) if big else b"") + (struct.pack("<Q", at) if far else b"")
        extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
        central += CENTRAL + struct.pack("<6H3L5H2L", 45, 45 if extra else 20, 0x800, 0, 0, 0x21, crc, short, short, len(label), len(extra), 0, 0, 0, 0, U32 if far else at) + label + extra
        yield head
        yield from chunks
        at += len(head) + size
    yield central
    n, big = len(members), zip64 or at >= U32 or len(members) >= U16
    if big:
        yield END64 + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, n, n, len(central), at)
        yield LOCATOR64 + struct.pack("<LQL", 0, at + len(central), 1)
    yield END + struct.pack("<4H2LH", 0, 0, U16 if big else n, U16 if big else n, U32 if big else len(central), U32 if big else at, 0)


class Member(NamedTuple):
    """Where the bytes of a ZIP member lie: they are its content if the method is STORED."""

    start: int
    length: int
    method: int = STORED


def zip_members(read: Callable[[int, int], bytes], size: int) -> dict[str, Member]:
    """The members by name, encrypted ones left out, from directory and local headers alone. read(offset, length) gives
    bytes. Raises ValueError for a file without an end record or with a broken directory."""
    tail_at = max(0, size - 22 - U16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # these bytes were part of the comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    n, length, start = struct.unpack_from("<10xH2L", tail, at)
    if U16 == n or U32 in (length, start):
        where = at + tail_at - 20
        locator = read(where, 20)
        if locator[:4] == LOCATOR64:
            n, length, start = struct.unpack_from("<32xQQQ", read(struct.unpack_from("<8xQ", locator)[0], 56))
    directory, at, found = read(start, length), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method, packed, whole, names, extras, comments, header = struct.unpack_from("<8x2H8x2L3H8xL", directory, at)
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, many = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # holds just the values that didn't fit, in this order
                wide = iter(struct.unpack_from(f"<{many // 8}Q", extra, k + 4))
                whole = next(wide) if whole == U32 else whole
                packed = next(wide) if packed == U32 else packed
                header = next(wide) if header == U32 else header
            k += 4 + many
        if not flags & 1 and not name.endswith("/"):
            local = read(header, 30)
            if local[:4] != LOCAL:
                raise ValueError(f"no local header for {name}")
            found[name] = Member(header + 30 + sum(struct.unpack_from("<26xHH", local)), packed, method)
        at += 46 + names + extras + comments
    return found


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = ((k, str(v).replace("\r", " ").replace("\n", " ")) for k, v in fields if v is not None)
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in clean), "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the record with the same payload."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    return _header([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", url),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>" if revisit else None),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", len(body)),
    ]) + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def _write(root: str, limit: int = ARCHIVE_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        chunks, index, size, at = [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{base}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(name) as out:
                for part in zip_bytes([(DATA, chunks), (INDEX, ["".join(index).encode()])]):
                    out.write(part)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], names=["archive", "records"])

        for batch in slices(batches, "html"):
            rows = zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), raw(batch, "html"), batch.column("digest").to_pylist(), batch.column("refers_to").to_pylist())
            for page_id, url, html, digest, refers_to in rows:
                payload = html or b""
                packed = gzip.compress(record(page_id, url, payload, digest, refers_to), 6, mtime=0)
                chunks.append(packed)
                index.append(json.dumps({"url": url, "offset": at, "length": len(packed)}) + "\n")
                at, size = at + len(packed), size + len(payload)
                if size >= limit:
                    yield close()
                    chunks, index, size, at = [], [], 0, 0
        if index:
            yield close()

    return run


def open_archive(store: fs.FileSystem, name: str):
    """(read, members) of an archive; read(offset, length) is a range request."""
    source = store.open_input_file(name)

    def read(offset: int, length: int) -> bytes:
        return source.read_at(length, offset)

    return read, zip_members(read, source.size())


def _lines(read: Callable[[int, int], bytes], member: Member) -> list[bytes]:
    """The lines of an index, which may be deflated, gzipped or both."""
    data = read(member.start, member.length)
    if member.method == DEFLATED:
        data = zlib.decompress(data, -15)
    return (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).splitlines()


def _walk(read: Callable[[int, int], bytes], member: Member, block: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of a member without an index: of its gzip members, or by their Content-Length."""
    at, end = 0, member.length
    while at < end:
        if read(member.start + at, 2) == b"\x1f\x8b":
            unzip, to = zlib.decompressobj(31), at
            while not unzip.eof and to < end:
                piece = read(member.start + to, min(block, end - to))
                unzip.decompress(piece)
                to += len(piece)
            length = to - at - len(unzip.unused_data)
        else:
            head, size = b"", 0
            while b"\r\n\r\n" not in head and len(head) < end - at:
                size = min(end - at, size + 4096)
                head = read(member.start + at, size)
            blank = head.find(b"\r\n\r\n") + 4
            found = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", head[:blank])
            if not found:
                raise ValueError("a WARC record has no Content-Length")
            length = blank + int(found[1]) + 4
        yield at, min(length, end - at)
        at += length


def entries(store: fs.FileSystem, name: str) -> Iterator[tuple[str, int, int]]:
    """(member, offset, length) of every record of an archive, in the order of its indexes.

    An entry without a file name belongs to the only WARC member. Members that no entry names are walked. A deflated
    WARC member has no byte ranges and raises ValueError.
    """
    read, members = open_archive(store, name)
    archives = {n: m for n, m in members.items() if ARCHIVES.match(n)}
    if packed := sorted(n for n, m in archives.items() if m.method != STORED):
        raise ValueError(f"{name}: {packed[0]} isn't stored, so its records have no byte range")
    seen, done = set(), set()
    for index in sorted(n for n in members if INDEXES.match(n)):
        for line in _lines(read, members[index]):
            at = line.find(b"{")
            entry = json.loads(line[at:]) if at >= 0 else {}
            if "offset" not in entry or "length" not in entry:
                continue  # a header, or a line of an index over indexes
            file = entry.get("filename")
            own = next((n for n in archives if n in (file, f"archive/{file}")), None) if file else next(iter(archives), None)
            if own is None or not file and len(archives) > 1:
                raise ValueError(f"{name}: {index} names no WARC member of this package")
            found = (own, int(entry["offset"]), int(entry["length"]))
            done.add(own)
            if found not in seen:
                seen.add(found)
                yield found
    for own, member in archives.items():
        if own not in done:
            yield from ((own, at, length) for at, length in _walk(read, member))


def read_entry(read: Callable[[int, int], bytes], members: dict[str, Member], member: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record, by a range read."""
    data = read(members[member].start + offset, length)
    return parse_record(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)


def records(store: fs.FileSystem, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive in the order of its indexes, each by a range read of its own."""
    read, members = open_archive(store, name)
    for entry in entries(store, name):
        yield read_entry(read, members, *entry)


def _read(root: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        number = lambda urn: int(urn[10:-1]) if urn and len(urn) > 11 else None
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                out = []
                for f, body in records(store, name):
                    digest = f["warc-payload-digest"].partition(":")[2]
                    if f["warc-type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(f["x-payload-length"])):
                        raise ValueError(f"{name}: payload of {f['warc-record-id']} is damaged")
                    out.append((number(f["warc-record-id"]), f.get("warc-target-uri"), int(f["x-payload-length"]), digest, f["warc-type"], number(f.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def write_archives(pages: DataFrame, root: str, minimum: int = 1000) -> DataFrame:
    """Write a record per page into archives under root; returns the manifest (archive, records).

    Of pages with equal payloads of ``minimum`` bytes or more, that of the largest page_id is a response and the others
    are revisits of it; shorter payloads are responses. Null html is an empty payload. Rows repeated with the largest
    page_id are responses, as are rows of null page_id if no other page has their payload. Extra columns are ignored.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    slim = own.where(F.octet_length("html") >= minimum).select("page_id", "digest")
    keeper = slim.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("keeper")), None).otherwise(F.col("keeper"))
    rows = own.join(keeper, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return materialize(map_arrow(rows, _write(root), "archive string, records long"), "manifest")


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """One row per record of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_arrow(manifest.select("archive").repartition(manifest.sparkSession.sparkContext.defaultParallelism), _read(root), schema)


def read_packages(packages: DataFrame, root: str) -> DataFrame:
    """(archive, member, offset, record_type, record_id, target_uri, fields, block): a row per record of web archive
    packages of any origin; packages has the column archive, names on the file system of root.

    Entries are found first and then dealt over all tasks, so the records of one large package are read by many.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                found = list(zip(*entries(store, name))) or [(), (), ()]
                columns = [pa.array([name] * len(found[0]), pa.string()), *(pa.array(c, t) for c, t in zip(found, (pa.string(), pa.int64(), pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["archive", "member", "offset", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        name, opened = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != name:
                    name, opened = row["archive"], open_archive(store, row["archive"])
                fields, block = read_entry(*opened, row["member"], row["offset"], row["length"])
                known = [fields.get(k) for k in ("warc-type", "warc-record-id", "warc-target-uri")]
                columns = [pa.array([x]) for x in (row["archive"], row["member"], row["offset"])] + [pa.array([x], pa.string()) for x in known]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([list(fields.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], names=names)

    names = ["archive", "member", "offset", "record_type", "record_id", "target_uri", "fields", "block"]
    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = map_arrow(packages.select("archive").repartition(tasks, "archive"), find, "archive string, member string, offset long, length long")
    dealt = found.repartition(tasks, "archive", "member", "offset").sortWithinPartitions("archive", "member", "offset")
    return map_arrow(dealt, fetch, "archive string, member string, offset long, record_type string, record_id string, target_uri string, fields map<string, string>, block binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back."""
    root = new_path(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, root), root)
