import json
import pickle
import random

import pyarrow as pa
import pytest
from pyarrow import fs

from kmerloom.sources import fastq, fastq_sink, fastq_text
from kmerloom.storage import materialize


def record(i, rng, name=None):
    n = rng.randrange(0, 60)
    seq = "".join(rng.choice("ACGTN") for _ in range(n))
    return f"@{name or f'r{i}'}", seq, rng.choice(["+", f"+r{i}"]), "".join(rng.choice("@+I#") for _ in range(n))


def write(path, records, end="\n"):
    path.write_text("".join(end.join(r) + end for r in records), newline="")
    return str(path)


@pytest.mark.parametrize("chunk", [1, 7, 50, 333, 1 << 20])
def test_any_split_reads_every_record_once(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    files = [[record(i, rng) for i in range(n)] for n in (40, 1, 25)]
    paths = [write(tmp_path / f"{i}.fastq", r) for i, r in enumerate(files)]
    if chunk == 1:
        found = []
        for i, p in enumerate(paths):
            with fs.LocalFileSystem().open_input_file(p) as source:
                for c in fastq.plan_chunks(fastq.input_set(single=[p]), [source.size()], chunk):
                    found += [(i, *(x.decode() for x in r[1:])) for r in fastq_text.records_in(source, c.start, c.end)]
    else:
        found = [(r.file_no, r.header, r.seq, r.plus, r.qual) for r in fastq.scan_fastq(spark, paths, chunk).orderBy("file_no", "offset").collect()]
    assert found == [(i, *r) for i, f in enumerate(files) for r in f]


def test_input_set_layouts(spark, tmp_path):
    rng = random.Random(2)
    left, right = ([record(i, rng, f"p{i}/{side}") for i in range(5)] for side in (1, 2))
    single, mixed = [record(i, rng, f"s{i}") for i in range(3)], [record(i, rng, f"m{i // 2} {i % 2 + 1}:N") for i in range(4)]
    paths = [write(tmp_path / f"{i}.fq", r) for i, r in enumerate((left, right, single, mixed))]
    rows = fastq.read_fastq(spark, [(paths[0], paths[1])], [paths[2]], [paths[3]], chunk_bytes=100).orderBy("read_id").collect()
    assert [r.read_id for r in rows] == list(range(17))
    names = [r.record.split("\n")[0][1:] for r in rows]
    assert names[:10] == [f"p{i}/{x}" for i in range(5) for x in (1, 2)] and names[10:] == ["s0", "s1", "s2", "m0 1:N", "m0 2:N", "m1 1:N", "m1 2:N"]
    assert [r.mate_id for r in rows] == [1, 0, 3, 2, 5, 4, 7, 6, 9, 8, None, None, None, 14, 13, 16, 15]
    assert fastq.read_fastq(spark).count() == 0
    with pytest.raises(ValueError):
        fastq.read_fastq(spark, [(paths[0], paths[2])])
    with pytest.raises(ValueError):
        fastq.read_fastq(spark, interleaved=[paths[0]])


def test_mates_need_one_name(spark, tmp_path):
    rng = random.Random(7)
    pair = [[record(i, rng, f"r{i}/{side}") for i in range(6)] for side in (1, 2)]
    swapped = [*pair[1][:2], pair[1][3], pair[1][2], *pair[1][4:]]
    a, b, c = (write(tmp_path / f"{i}.fq", r) for i, r in enumerate((*pair, swapped)))
    assert fastq.read_fastq(spark, [(a, b)]).count() == 12
    with pytest.raises(ValueError, match="2.fq: reads whose mates"):
        fastq.read_fastq(spark, [(a, b), (a, c)])
    mixed = [x for two in zip(*pair) for x in two]
    off = write(tmp_path / "off.fq", mixed[1:] + mixed[:1])
    assert fastq.read_fastq(spark, interleaved=[write(tmp_path / "mixed.fq", mixed)]).count() == 12
    with pytest.raises(ValueError, match="off.fq: reads whose mates"):
        fastq.read_fastq(spark, interleaved=[off])


def indexed(spark, tmp_path, seed=8):
    rng = random.Random(seed)
    paths = [write(tmp_path / f"{i}.fq", [record(i, rng) for i in range(n)]) for i, n in enumerate((30, 0, 17))]
    return paths, materialize(fastq.fastq_index(spark, single=paths, chunk_bytes=300), "index")


def by_id(df):
    return sorted(df.collect(), key=lambda r: r.read_id)


def test_stored_index(spark, tmp_path):
    paths, index = indexed(spark, tmp_path)
    want = by_id(fastq.read_fastq(spark, single=paths, chunk_bytes=300))
    assert by_id(fastq.read_fastq(spark, single=paths, chunk_bytes=300, index=index)) == want
    assert by_id(fastq.read_fastq(spark, single=paths, chunk_bytes=300, index=index.where("n >= 0"))) == want
    assert [r.read_id for r in want] == list(range(47))
    for files, size in ((paths, 200), (paths[::-1], 300), (paths[:2], 300)):
        with pytest.raises(ValueError, match="other files|another size"):
            fastq.read_fastq(spark, single=files, chunk_bytes=size, index=index)
    with pytest.raises(ValueError, match="other files"):
        fastq.read_fastq(spark, single=paths, chunk_bytes=300, index=index.where("chunk_id > 0"))


def test_a_stale_index_raises(spark, tmp_path):
    paths, index = indexed(spark, tmp_path)
    text = (tmp_path / "0.fq").read_text()
    lines = text.split("\n")
    swapped = "\n".join([*lines[:56], *lines[60:64], *lines[56:60], *lines[64:]])
    renamed = text.replace("@r9\n", "@r7\n")
    for changed in (text * 10, text[: len(text) // 2], text + "@z\nA\n+\nI\n", ""):  # grown and shrunk
        (tmp_path / "0.fq").write_text(changed)
        with pytest.raises(ValueError):
            fastq.read_fastq(spark, single=paths, chunk_bytes=300, index=index)
    for changed in (swapped, renamed):  # edited, of the same size
        assert len(changed) == len(text) and changed != text
        (tmp_path / "0.fq").write_text(changed)
        with pytest.raises(Exception, match="has changed since it was indexed"):
            fastq.read_fastq(spark, single=paths, chunk_bytes=300, index=index).collect()
    (tmp_path / "0.fq").write_text(text)
    assert fastq.read_fastq(spark, single=paths, chunk_bytes=300, index=index).count() == 47


def test_filters_reach_the_plan(spark, tmp_path):
    paths, index = indexed(spark, tmp_path)
    reads = fastq.read_fastq(spark, single=paths, chunk_bytes=300, index=index, task_bytes=1)
    every = by_id(reads)
    chunks = sorted({r.chunk_id for r in every})
    assert len(chunks) > 4 and reads.rdd.getNumPartitions() == index.count()
    for test, keep in ((f"chunk_id = {chunks[2]}", lambda r: r.chunk_id == chunks[2]), (f"chunk_id IN ({chunks[0]}, {chunks[3]})", lambda r: r.chunk_id in (chunks[0], chunks[3])), ("chunk_id >= 3 AND chunk_id < 5", lambda r: 3 <= r.chunk_id < 5)):
        some = reads.where(test)
        want = list(filter(keep, every))
        assert some.rdd.getNumPartitions() == len({r.chunk_id for r in want}) and by_id(some) == want
    some = reads.where("file_no = 2")
    assert some.rdd.getNumPartitions() < reads.rdd.getNumPartitions() and by_id(some) == [r for r in every if r.file_no == 2]
    (tmp_path / "0.fq").write_text((tmp_path / "0.fq").read_text().replace("@r0", "@q0"))  # a chunk that isn't opened
    assert by_id(reads.where("file_no = 2")) == [r for r in every if r.file_no == 2]


def mates(n, seed, lengths=(0, 60)):
    rng = random.Random(seed)

    def one(i, side):
        size = rng.randrange(*lengths) if side == 1 else rng.randrange(3)
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        return f"@p{i * 7919 % 100003}{'/' if i % 2 else ' '}{side}", seq, "+", "".join(rng.choice("@+Ip") for _ in range(size))

    return [[one(i, side) for i in range(n)] for side in (1, 2)]


@pytest.mark.parametrize("chunk", [40, 333, 5000])
def test_mates_meet_in_one_range(spark, tmp_path, chunk):
    """Records of quite different lengths on both sides, in files of several ranges and in one file."""
    left, right = mates(120, chunk)
    a, b = write(tmp_path / "a.fq", left), write(tmp_path / "b.fq", right)
    both = write(tmp_path / "c.fq", [r for pair in zip(left, right) for r in pair])
    rows = by_id(fastq.read_fastq(spark, [(a, b)], interleaved=[both], chunk_bytes=chunk))
    want = ["\n".join(r) for pair in zip(left, right) for r in pair]
    assert [r.read_id for r in rows] == list(range(480)) and [r.record for r in rows] == want * 2
    assert [r.mate_id for r in rows] == [i ^ 1 for i in range(480)]
    assert {r.file_no for r in rows} == {0, 1, 2}


def test_no_shuffle_for_ids_and_mates(spark, tmp_path):
    left, right = mates(50, 1)
    reads = fastq.read_fastq(spark, [(write(tmp_path / "a.fq", left), write(tmp_path / "b.fq", right))], chunk_bytes=300)
    plan = reads._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_mates_far_from_their_share_of_the_file(tmp_path, monkeypatch):
    monkeypatch.setattr(fastq_text, "WINDOW", 64)
    left, right = mates(400, 3)
    right = [(h, "ACGT" * (100 if i > 350 else 0), "+", "IIII" * (100 if i > 350 else 0)) for i, (h, *_) in enumerate(right)]
    a, b = write(tmp_path / "a.fq", left), write(tmp_path / "b.fq", right)
    with fs.LocalFileSystem().open_input_file(a) as x, fs.LocalFileSystem().open_input_file(b) as y:
        found = [(p[1].decode(), q[1].decode()) for s in range(0, x.size(), 500) for p, q in fastq_text.pairs_of_files(x, y, s, min(s + 500, x.size()))]
    assert found == [(p[0], q[0]) for p, q in zip(left, right)]


def test_pairs_that_do_not_fit(spark, tmp_path):
    left, right = mates(60, 4)
    a = write(tmp_path / "a.fq", left)
    for i, other in enumerate((right[:-1], right[1:], right[:30] + right[31:], right + right[:1], [], right[:59] + right[:1])):
        b = write(tmp_path / f"b{i}.fq", other)
        for chunk in (200, 1 << 20):
            with pytest.raises(ValueError, match="different numbers|other names"):
                fastq.read_fastq(spark, [(a, b)], chunk_bytes=chunk)
            if not other:
                with pytest.raises(ValueError, match="different numbers"):
                    fastq.read_fastq(spark, [(b, a)], chunk_bytes=chunk)
    empty = [write(tmp_path / f"e{i}.fq", []) for i in range(2)]
    assert fastq.read_fastq(spark, [tuple(empty)], single=[a]).count() == 60
    odd = write(tmp_path / "odd.fq", [r for pair in zip(left, right) for r in pair][:-1])
    with pytest.raises(ValueError, match="odd number"):
        fastq.read_fastq(spark, interleaved=[odd], chunk_bytes=200)


def test_many_small_files_share_tasks(spark, tmp_path):
    rng = random.Random(12)
    paths = [write(tmp_path / f"{i:04}.fq", [record(i, rng) for _ in range(3)]) for i in range(300)]
    reads = fastq.read_fastq(spark, single=paths, chunk_bytes=1 << 20, task_bytes=10_000)
    assert reads.rdd.getNumPartitions() < 20
    assert [r.record.split("\n")[0] for r in by_id(reads)] == [f"@r{i}" for i in range(300) for _ in range(3)]
    chunks = [fastq.Chunk(i, i, "", 0, 10_000, 10_000) for i in range(10_000)]  # 10,000 files of 10 KB
    assert len(fastq.packed_tasks(chunks, 4 << 20)) == 24
    pair = fastq.Chunk(0, 0, "a", 0, 100, 200, mate="b", mate_size=600)
    assert pair.weight == 400


def test_windows_line_ends_and_missing_last_newline(spark, tmp_path):
    rows = [("@a", "ACGT", "+", "@@@@"), ("@b", "AC", "+", "+@")]
    path = write(tmp_path / "w.fq", rows, "\r\n")
    assert [tuple(r)[4:] for r in fastq.scan_fastq(spark, [path], 9).orderBy("offset").collect()] == rows
    bare = tmp_path / "b.fq"
    bare.write_text("@a\nACGT\n+\nIIII")
    assert fastq.scan_fastq(spark, [str(bare)]).first().qual == "IIII"


def test_index_and_sinks(spark, tmp_path):
    rng = random.Random(3)
    path = write(tmp_path / "x.fq", [record(i, rng) for i in range(30)])
    scanned = fastq.scan_fastq(spark, [path], 200)
    index = fastq.fastq_index(spark, single=[path], chunk_bytes=200).orderBy("chunk_id").collect()
    assert sum(r.n for r in index) == 30 == scanned.count() and index[0].first_offset == 0
    reads = fastq.read_fastq(spark, single=[path])
    manifest = reads.selectExpr("CAST(read_id % 3 AS INT) AS part_id", "read_id").union(reads.where("read_id = 4").selectExpr("0", "read_id"))
    out = str(tmp_path / "parts")
    fastq_sink.write_partitions(manifest, reads, out, file_reads=4)
    files = sorted(str(p) for p in (tmp_path / "parts").glob("part_id=*/part-*"))
    again = fastq.scan_fastq(spark, files).collect()
    assert sorted(r.header for r in again) == sorted([f"@r{i}" for i in range(30)] + ["@r4"])
    assert len(files) >= 3
    labels = reads.selectExpr("read_id", "read_id % 2 AS comp_id")
    fastq_sink.write_largest_component(labels, reads, 1, str(tmp_path / "largest"))
    assert fastq_sink.read_partitions(spark, str(tmp_path / "largest")).where("part_id = 1").count() == 15


def test_only_committed_attempts_are_read(spark, tmp_path, monkeypatch):
    """An attempt that fails, one that is repeated, and a job that is aborted."""
    out, names = tmp_path / "out", iter(["00000-1", "00000-2", "00001-3", "00001-4"])
    monkeypatch.setattr(fastq_sink.FastqWriter, "_attempt", lambda self: next(names))
    writer = fastq_sink.FastqWriter(str(out))
    batch = lambda rows: pa.RecordBatch.from_pylist([{"part_id": p, "record": f"@{r}\nACGT\n+\nIIII"} for p, r in rows])

    def failing():
        yield batch([(0, "a"), (1, "b")])
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(failing())
    assert not list(out.glob("*/*"))
    first = writer.write(iter([batch([(0, "a"), (1, "b")]), batch([(1, "c")])]))
    second, again = (writer.write(iter([batch([(1, "d"), (2, "e")])])) for _ in range(2))
    with pytest.raises(FileNotFoundError):
        fastq_sink.written_files(str(out))
    (out / "part_id=7").mkdir()
    (out / "part_id=7/part-lost.fq").write_text("@x\nA\n+\nI\n")
    writer.commit([first, again, None])  # what the repeated attempt and a stopped task left goes
    assert not (out / "part_id=7/part-lost.fq").exists()
    assert sorted((p, r) for _, p, r in fastq_sink.written_files(str(out))) == [(0, 1), (1, 1), (1, 2), (2, 1)]
    found = fastq_sink.read_partitions(spark, f"file://{out}").select("part_id", "header").collect()
    assert sorted(tuple(r) for r in found) == [(0, "@a"), (1, "@b"), (1, "@c"), (1, "@d"), (2, "@e")]
    assert len(list(out.glob("part_id=*/part-*"))) == 4 and second.files != again.files
    writer.abort([first, again])
    assert not list(out.glob("part_id=*/part-*"))


def test_a_failed_job_leaves_no_output(spark, tmp_path):
    rows = spark.range(100).selectExpr("CAST(id % 3 AS INT) AS part_id", "if(id = 97, raise_error('lost'), concat('@r', id, '\nA\n+\nI')) AS record")
    with pytest.raises(Exception, match="lost"):
        fastq_sink.write_records(rows, str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        fastq_sink.read_partitions(spark, str(tmp_path / "out"))
    good = rows.where("part_id = 2").selectExpr("part_id", "concat('@r', part_id, '\nA\n+\nI') AS record")
    fastq_sink.write_records(good, str(tmp_path / "out"))
    assert fastq_sink.read_partitions(spark, str(tmp_path / "out")).count() == 33
    with pytest.raises(Exception, match="holds an output already"):
        fastq_sink.write_records(good, str(tmp_path / "out"))


def test_broken_records(spark, tmp_path):
    path = tmp_path / "bad.fq"
    path.write_text("@a\nACGT\n+\nIIII\n@b\nACGT\n+\nIII\n@c\nA\n+\nI\n")
    with pytest.raises(Exception, match="broken FASTQ record"):
        fastq.scan_fastq(spark, [str(path)]).count()


class Counted:
    """A file in memory that counts the bytes read."""

    def __init__(self, text):
        self.text, self.read = text, 0

    def size(self):
        return len(self.text)

    def read_at(self, n, offset):
        self.read += n
        return self.text[offset : offset + n]


def test_short_ranges_read_little_more_than_themselves():
    text = "".join(f"@r{i // 2}\n{'A' * 100}\n+\n{'@' * 100}\n" for i in range(20000)).encode()
    chunk = 1 << 16
    for found in (
        lambda s, a: fastq_text.records_in(s, a, a + chunk),
        lambda s, a: (r for pair in fastq_text.pairs_in(s, a, a + chunk) for r in pair),
    ):
        source = Counted(text)
        assert sum(1 for a in range(0, len(text), chunk) for _ in found(source, a)) == 20000
        assert source.read < 2 * len(text)
    left, right = (Counted("".join(f"@r{i}/{side}\n{'A' * 100}\n+\n{'@' * 100}\n" for i in range(20000)).encode()) for side in (1, 2))
    assert sum(1 for a in range(0, left.size(), chunk) for _ in fastq_text.pairs_of_files(left, right, a, min(a + chunk, left.size()))) == 20000
    assert left.read + right.read < 3 * (left.size() + right.size())


def test_tasks_get_no_list_of_files():
    files = fastq.input_set(single=[f"file:///reads/{i:08}.fq" for i in range(10000)])
    reader = fastq.FastqReads({"files": json.dumps(files)}).reader(None)
    assert len(reader.files["single"]) == 10000 and len(pickle.dumps(reader)) < 2000


def test_tasks_grow_with_the_input():
    for gb in (1, 10, 50):
        chunks = fastq.plan_chunks(fastq.input_set(single=["a"]), [gb << 30], 1 << 16)
        tasks = fastq.packed_tasks(chunks, 1 << 20)
        assert [c.chunk_id for t in tasks for c in t.chunks] == list(range(len(chunks))) and len(tasks) <= 1.01 * fastq.TASKS
