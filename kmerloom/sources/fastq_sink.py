"""FASTQ out, committed as a whole.

``write.format("fastq")`` takes rows (part_id, record). A task writes files of its own attempt, one for each partition
that it holds rows of, and reports them; the driver lists what was reported in one manifest and removes what failed or
repeated attempts left behind. A job that fails removes the files of its finished tasks; those of tasks that it stops may
stay until the next output is committed to the folder. Readers go by the manifest: a folder without one is unfinished.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from kmerloom.sources.fastq import FastqSource, open_store, scan_fastq

MANIFEST = "_manifest.json"
#: Reads of a file, about.
FILE_READS = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: (name below the folder, part_id, records)."""

    files: list[tuple[str, int, int]]


class FastqWriter(DataSourceArrowWriter):
    """Rows come sorted by part_id, so that one file is open at a time."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _attempt(self) -> str:
        task = TaskContext.get()
        return f"{task.partitionId():05}-{task.taskAttemptId()}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.path)
        files, attempt, part, out = [], self._attempt(), None, None
        try:
            for batch in batches:
                for part_id, record in zip(batch.column("part_id").to_pylist(), batch.column("record").to_pylist()):
                    if out is None or part_id != part:
                        if out:
                            out.close()
                        part, name = part_id, f"part_id={part_id}/part-{attempt}-{len(files)}.fq"
                        store.create_dir(f"{root}/part_id={part_id}", recursive=True)
                        out = store.open_output_stream(f"{root}/{name}")
                        files.append([name, part_id, 0])
                    out.write(record.encode("latin-1") + b"\n")
                    files[-1][2] += 1
            if out:
                out.close()
        except BaseException:
            self._remove(name for name, *_ in files)
            raise
        return Written([tuple(f) for f in files])

    def _remove(self, names) -> None:
        store, root = open_store(self.path)
        for name in names:
            try:
                store.delete_file(f"{root}/{name}")
            except FileNotFoundError:
                pass

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_store(self.path)
        files = sorted(f for m in messages if m for f in m.files)
        kept = {name for name, *_ in files}
        store.create_dir(root, recursive=True)
        below = store.get_file_info(pa.fs.FileSelector(root, recursive=True))
        there = (x.path[len(root) + 1 :] for x in below if x.type == pa.fs.FileType.File)
        self._remove(name for name in there if name.startswith("part_id=") and name not in kept)
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write("".join(json.dumps({"file": name, "part_id": part, "records": n}) + "\n" for name, part, n in files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(name for m in messages if m for name, *_ in m.files)


class FastqSink(FastqSource):
    """The source's format, to write."""

    def writer(self, schema, overwrite: bool) -> FastqWriter:
        path = {k.lower(): v for k, v in self.options.items()}["path"]
        store, root = open_store(path)
        if store.get_file_info(f"{root.rstrip('/')}/{MANIFEST}").type != pa.fs.FileType.NotFound:
            raise ValueError(f"{path} holds an output already")
        return FastqWriter(path)


def write_records(rows: DataFrame, path: str) -> None:
    """Write rows (part_id, record) below ``path``; a task's rows should come sorted by part_id."""
    rows.sparkSession.dataSource.register(FastqSink)
    rows.select(F.col("part_id").cast("int"), "record").write.format("fastq").mode("append").option("path", path).save()


def write_partitions(manifest: DataFrame, reads: DataFrame, path: str, file_reads: int = FILE_READS) -> None:
    """Write each partition's records as FASTQ text under path/part_id=<p>/, in files of about ``file_reads`` records.

    Records join late, on read_id alone. A partition's rows are dealt over as many files as its size asks for, so one
    large partition is written by many tasks. Failed and repeated tasks leave no record twice: see written_files.
    """
    sizes = manifest.groupBy("part_id").agg(F.ceil(F.count("*") / file_reads).alias("files"))
    rows = manifest.join(reads.select("read_id", "record"), "read_id").join(F.broadcast(sizes), "part_id")  # a row per partition
    dealt = rows.repartition("part_id", F.pmod(F.xxhash64("read_id"), F.col("files")))
    write_records(dealt.sortWithinPartitions("part_id", "read_id"), path)


def write_largest_component(labels: DataFrame, reads: DataFrame, largest: int, path: str) -> None:
    """Write the records of one component under path/part_id=1, and of all others under path/part_id=0."""
    rows = labels.join(reads.select("read_id", "record"), "read_id")
    write_records(rows.select((F.col("comp_id") == largest).cast("int").alias("part_id"), "record").sortWithinPartitions("part_id"), path)


def written_files(path: str) -> list[tuple[str, int, int]]:
    """(file, part_id, records) of a finished output. FileNotFoundError if it isn't finished."""
    store, root = open_store(path.rstrip("/"))
    with store.open_input_stream(f"{root}/{MANIFEST}") as source:
        rows = [json.loads(line) for line in source.read().decode().splitlines()]
    return [(f"{path.rstrip('/')}/{r['file']}", r["part_id"], r["records"]) for r in rows]


def read_partitions(spark: SparkSession, path: str, chunk_bytes: int = 64 << 20, task_bytes: int | None = None) -> DataFrame:
    """(part_id, header, seq, plus, qual): the records of a finished output, by its manifest."""
    files = written_files(path)
    parts = spark.createDataFrame([(i, part) for i, (_, part, _) in enumerate(files)], "file_no int, part_id int")
    rows = scan_fastq(spark, [f for f, *_ in files], chunk_bytes, task_bytes).join(F.broadcast(parts), "file_no")  # a row per file
    return rows.select("part_id", "header", "seq", "plus", "qual")
