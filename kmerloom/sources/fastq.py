"""FASTQ input sets by byte ranges, with a stored index that later scans are planned from.

An input set is an ordered list of file pairs, single files and interleaved files. It is planned as chunks: byte ranges,
of a file pair with the range of the other file that holds the mates, so that both mates and the check of their names are
in one task. Small chunks are packed into tasks by their bytes. Three formats read the same chunks: ``fastq_index`` gives
a row per chunk, ``fastq`` the records, ``fastq_reads`` reads with ids, which it takes from a stored index: neither are
records counted again nor reads sorted or shuffled. Filters on chunk_id and file_no reach the plan, and other chunks
aren't opened.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from kmerloom.sources.fastq_text import Record, pairs_in, pairs_of_files, records_in
from kmerloom.storage import is_stored, materialize

RECORDS = "file_no int, chunk_id int, offset long, row long, header string, seq string, plus string, qual string"
READS = "read_id long, mate_id long, chunk_id int, file_no int, seq string, record string"
INDEX = "chunk_id int, file_no int, first_offset long, n long, file_bytes long, mate_bytes long, digest long"
#: Records of a batch, bytes of a chunk.
ROWS, CHUNK_BYTES = 4096, 64 << 20
#: Tasks of a scan, about, from which on they grow with the input, up to CHUNK_BYTES, instead of their number.
TASKS = 2048
STALE = "the index is of other files or another chunk size"


@dataclass
class Chunk:
    """A byte range of a file, with the other file of a pair. known: its row of a stored index; first_id: reads before it."""

    chunk_id: int
    file_no: int
    path: str
    start: int
    end: int
    size: int
    mate: str | None = None
    mate_size: int = 0
    interleaved: bool = False
    known: dict | None = None
    first_id: int = 0

    @property
    def weight(self) -> int:
        return self.end - self.start + (self.mate_size * (self.end - self.start) // max(self.size, 1) if self.mate else 0)


class Task(InputPartition):
    def __init__(self, chunks: list[Chunk]):
        super().__init__([c.chunk_id for c in chunks])
        self.chunks = chunks


def open_store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def file_sizes(paths: list[str]) -> list[int]:
    """Bytes of every file, asked for many at a time."""
    size = lambda path: (lambda store, name: store.get_file_info(name).size or 0)(*open_store(path))
    with ThreadPoolExecutor(32) as pool:
        return list(pool.map(size, paths))


def _paths(files: dict) -> list[str]:
    return [p for pair in files["paired"] for p in pair] + files["single"] + files["interleaved"]


def plan_chunks(files: dict, sizes: list[int], chunk_bytes: int) -> list[Chunk]:
    """Ranges of chunk_bytes at most that cover every file and never span two; sizes are of all files in order.

    A pair has the ranges of its first file, and one even if that is empty."""
    found, no = [], 0

    def cut(path: str, size: int, **more) -> None:
        for a in range(0, max(size, 1) if more.get("mate_size") else size, chunk_bytes):
            found.append(Chunk(len(found), no, path, a, min(a + chunk_bytes, size), size, **more))

    for left, right in files["paired"]:
        cut(left, sizes[no], mate=right, mate_size=sizes[no + 1])
        no += 2
    for kind in ("single", "interleaved"):
        for path in files[kind]:
            cut(path, sizes[no], interleaved=kind == "interleaved")
            no += 1
    return found


def packed_tasks(chunks: list[Chunk], task_bytes: int) -> list[Task]:
    """Neighbouring chunks put together up to ``task_bytes``, mates counted; a larger chunk is a task of its own.

    Of inputs that would need more than TASKS of these, tasks take more."""
    task_bytes = max(task_bytes, min(CHUNK_BYTES, sum(c.weight for c in chunks) // TASKS))
    tasks, held = [], 0
    for chunk in chunks:
        if not tasks or held + chunk.weight > task_bytes:
            tasks.append([])
            held = 0
        tasks[-1].append(chunk)
        held += chunk.weight
    return [Task(t) for t in tasks]


def chunk_records(chunk: Chunk) -> Iterator[tuple[int, Record]]:
    """(file_no, record) of a chunk; mates follow one another. ValueError names the file of what doesn't fit."""
    store, name = open_store(chunk.path)
    try:
        with store.open_input_file(name) as source:
            if chunk.mate is not None:
                other, mate = open_store(chunk.mate)
                with other.open_input_file(mate) as second:
                    for a, b in pairs_of_files(source, second, chunk.start, chunk.end):
                        yield chunk.file_no, a
                        yield chunk.file_no + 1, b
            elif chunk.interleaved:
                for pair in pairs_in(source, chunk.start, chunk.end):
                    for record in pair:
                        yield chunk.file_no, record
            else:
                for record in records_in(source, chunk.start, chunk.end):
                    yield chunk.file_no, record
    except ValueError as wrong:
        raise ValueError(f"{chunk.path}{' and ' + chunk.mate if chunk.mate else ''}: {wrong}") from None


def checked_records(chunk: Chunk) -> Iterator[tuple[int, Record]]:
    """chunk_records; with a stored row of the index, ValueError unless number and content are those it was made of."""
    n, digest = 0, 0
    for file_no, record in chunk_records(chunk):
        n += 1
        if chunk.known is not None:
            digest = crc32(b"\n".join(record[1:]), digest)
        yield file_no, record
    if chunk.known is not None and (n, digest) != (chunk.known["n"], chunk.known["digest"]):
        raise ValueError(f"{chunk.path} has changed since it was indexed (chunk {chunk.chunk_id})")


def summary(chunk: Chunk) -> tuple:
    n, digest, first = 0, 0, None
    for _, record in chunk_records(chunk):
        first = record[0] if first is None else first
        n, digest = n + 1, crc32(b"\n".join(record[1:]), digest)
    return chunk.chunk_id, chunk.file_no, first, n, chunk.size, chunk.mate_size, digest


def _arrays(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[f[0] for f in fields])


def record_rows(chunk: Chunk) -> Iterator[tuple]:
    for row, (file_no, (at, *text)) in enumerate(checked_records(chunk)):
        yield file_no, chunk.chunk_id, at, row, *(x.decode("latin-1") for x in text)


def read_rows(chunk: Chunk) -> Iterator[tuple]:
    mated = chunk.interleaved or chunk.mate is not None
    for row, (file_no, (_, *text)) in enumerate(checked_records(chunk)):
        read_id = chunk.first_id + row
        mate_id = read_id + 1 - 2 * (row % 2) if mated else None
        yield read_id, mate_id, chunk.chunk_id, file_no, text[1].decode("latin-1"), b"\n".join(text).decode("latin-1")


def stored_rows(path: str) -> list[dict]:
    """A stored index: a row per chunk, as the plan itself."""
    store, name = open_store(path)
    return pa.dataset.dataset(name, filesystem=store, format="parquet", exclude_invalid_files=True).to_table().to_pylist()


def known_chunks(chunks: list[Chunk], index: list[dict]) -> list[Chunk]:
    """The chunks with their rows of an index and the number of reads before each. ValueError if the index isn't of these
    chunks, or a file has another size than it had then."""
    rows, before = {r["chunk_id"]: r for r in index}, 0
    if len(rows) != len(index) or rows.keys() != {c.chunk_id for c in chunks}:
        raise ValueError(STALE)
    for c in chunks:
        c.known = rows[c.chunk_id]
        first = c.known["first_offset"]
        if c.known["file_no"] != c.file_no or first is not None and not c.start <= first < c.end:
            raise ValueError(STALE)
        if (c.known["file_bytes"], c.known["mate_bytes"]) != (c.size, c.mate_size):
            raise ValueError(f"{c.path} has changed since it was indexed: it has another size")
        c.known = {x: c.known[x] for x in ("n", "digest")}  # a task gets no more than it checks
        c.first_id, before = before, before + c.known["n"]
    return chunks


class ChunkReader(DataSourceReader):
    """Plans chunks from files and options, drops those that filters exclude and yields what ``rows`` makes of each."""

    TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, y: x in y}

    def __init__(self, options: dict, schema: str, rows: Callable[[Chunk], Iterator[tuple]], by_file: bool):
        self.files, self.index = json.loads(options["files"]), options.get("index")
        self.chunk_bytes, self.task_bytes = int(options["chunkbytes"]), int(options["taskbytes"])
        self.columns, self.rows, self.by_file, self.filters = schema, rows, by_file, []

    def __getstate__(self) -> dict:
        """What tasks get: without the list of files, as long as the input; their chunks name those that they read."""
        return self.__dict__ | {"files": None, "index": None}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            known = type(f) in self.TESTS and f.attribute in (("chunk_id",), ("file_no",))
            if known:
                self.filters.append(f)
            if not known or f.attribute == ("file_no",) and not self.by_file:
                yield f  # both files of a pair are in one chunk, so rows are filtered again

    def wanted(self, chunk: Chunk) -> bool:
        def test(f) -> bool:
            numbers = [chunk.chunk_id] if f.attribute == ("chunk_id",) else [chunk.file_no, chunk.file_no + 1][: 2 if chunk.mate and not self.by_file else 1]
            return any(self.TESTS[type(f)](x, f.value) for x in numbers)

        return all(map(test, self.filters))

    def partitions(self) -> list[Task]:
        chunks = plan_chunks(self.files, file_sizes(_paths(self.files)), self.chunk_bytes)
        if self.index:
            chunks = known_chunks(chunks, stored_rows(self.index))
        return packed_tasks([c for c in chunks if self.wanted(c)], self.task_bytes)

    def read(self, task: Task) -> Iterator[pa.RecordBatch]:
        held = []
        for chunk in task.chunks if task else ():
            for row in self.rows(chunk):
                held.append(row)
                if len(held) == ROWS:
                    yield _arrays(self.columns, held)
                    held = []
        yield _arrays(self.columns, held)


class FastqSource(DataSource):
    """Records. Options: path, paths (one per line) or files (an input set as JSON), chunkBytes, taskBytes, index."""

    COLUMNS, BY_FILE = RECORDS, False

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return self.COLUMNS

    def rows(self) -> Callable:
        return record_rows

    def reader(self, schema) -> ChunkReader:
        given = {k.lower(): v for k, v in self.options.items()}
        single = [p for p in given.get("paths", given.get("path", "")).split("\n") if p]
        options = {"files": json.dumps({"paired": [], "single": single, "interleaved": []}), "chunkbytes": CHUNK_BYTES} | given
        return ChunkReader({"taskbytes": options["chunkbytes"]} | options, self.COLUMNS, self.rows(), self.BY_FILE)


class FastqReads(FastqSource):
    """Reads with ids, by a stored index. Options as of FastqSource."""

    COLUMNS = READS

    @classmethod
    def name(cls) -> str:
        return "fastq_reads"

    def rows(self) -> Callable:
        return read_rows


class FastqIndex(FastqSource):
    """A row per chunk."""

    COLUMNS, BY_FILE = INDEX, True

    @classmethod
    def name(cls) -> str:
        return "fastq_index"

    def rows(self) -> Callable:
        return lambda chunk: iter([summary(chunk)])


def _load(spark: SparkSession, source: type[FastqSource], files: dict, chunk_bytes: int, task_bytes: int | None, index: str | None = None) -> DataFrame:
    if not any(files.values()):
        return spark.createDataFrame([], source.COLUMNS)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the session keeps that
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("files", json.dumps(files)).option("chunkBytes", chunk_bytes).option("taskBytes", task_bytes or max(chunk_bytes, CHUNK_BYTES))
    return (reader.option("index", index) if index else reader).load()


def scan_fastq(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK_BYTES, task_bytes: int | None = None) -> DataFrame:
    """The records of FASTQ files, a row each: file_no is the position in ``paths``, chunk_id that of the byte range and
    row the position in it. No paths give no rows."""
    return _load(spark, FastqSource, {"paired": [], "single": list(paths), "interleaved": []}, chunk_bytes, task_bytes or chunk_bytes)


def input_set(paired: list[tuple[str, str]] = (), single: list[str] = (), interleaved: list[str] = ()) -> dict:
    return {"paired": [list(p) for p in paired], "single": list(single), "interleaved": list(interleaved)}


def fastq_index(
    spark: SparkSession, paired: list[tuple[str, str]] = (), single: list[str] = (), interleaved: list[str] = (), chunk_bytes: int = CHUNK_BYTES, task_bytes: int | None = None
) -> DataFrame:
    """(chunk_id, file_no, first_offset, n, file_bytes, mate_bytes, digest) of an input set, a row per chunk.

    first_offset is null for a chunk in which no record begins; n counts both mates; the sizes are of the whole files;
    digest is the crc32 of the chunk's records. Mates are checked as in read_fastq.
    """
    return _load(spark, FastqIndex, input_set(paired, single, interleaved), chunk_bytes, task_bytes)


def _stored(index: DataFrame) -> DataFrame:
    """The index, stored; what doesn't fit in the files raises ValueError, as it does in the task that finds it."""
    try:
        return materialize(index, "index")
    except PySparkException as failed:
        if found := re.search(r"ValueError: (.*)", str(failed)):
            raise ValueError(found[1]) from None
        raise


def read_fastq(
    spark: SparkSession,
    paired: list[tuple[str, str]] = (),
    single: list[str] = (),
    interleaved: list[str] = (),
    chunk_bytes: int = CHUNK_BYTES,
    index: DataFrame | None = None,
    task_bytes: int | None = None,
) -> DataFrame:
    """(read_id, mate_id, chunk_id, file_no, seq, record) of an ordered input set: paired files, then single, then interleaved.

    Ids are dense. Records of the same place of a file pair are mates and get ids 2i and 2i + 1 from the pair's base on;
    in an interleaved file records 2j and 2j + 1 are mates; single reads have no mate. Mates must have one name, up to a
    slash or blank, and the name must be no other pair's of the files. Unequal counts and mates of different names raise
    an error that names the files, while the index is made.

    A record's id is its place in its chunk plus the records of the chunks before, so reads are never sorted or shuffled.
    ``index`` is a stored fastq_index of the same files in this order and with these chunk_bytes; without it one is made,
    which reads the files once more. It must be of the files as they are: planning raises an error if a size differs, and
    the scan if a chunk's number of records or content does. Chunks are put together to tasks of ``task_bytes``.
    """
    files = input_set(paired, single, interleaved)
    if not any(files.values()):
        return spark.createDataFrame([], READS)
    if index is None:
        index = _stored(fastq_index(spark, paired, single, interleaved, chunk_bytes, task_bytes))
    else:
        index = index if is_stored(index) else materialize(index, "index")
        known_chunks(plan_chunks(files, file_sizes(_paths(files)), chunk_bytes), stored_rows(index._kmerloom_path))
    return _load(spark, FastqReads, files, chunk_bytes, task_bytes, index._kmerloom_path)
