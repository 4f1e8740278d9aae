import random

from kmerloom.__main__ import main
from kmerloom.sources.fastq import scan_fastq
from kmerloom.sources.fastq_sink import read_partitions


def test_commands(spark, tmp_path, capsys):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(500))
    path = tmp_path / "reads.fq"
    path.write_text("".join(f"@r{i // 2}/{i % 2 + 1}\n{genome[a : a + 60]}\n+\n{'I' * 60}\n" for i, a in enumerate(rng.randrange(440) for _ in range(80))))
    files = ["--interleaved", str(path), "--chunk-bytes", "3000"]
    main(["index", "-o", str(tmp_path / "index"), *files], spark)
    main(["view", str(tmp_path / "index")], spark)
    shown = [list(map(int, x.split())) for x in capsys.readouterr().out.splitlines()]
    assert sum(x[3] for x in shown) == 80 and shown[0][:3] == [0, 0, 0] and len(shown) > 2
    for mode in ([], ["--min3"]):
        out = tmp_path / f"histogram{len(mode)}"
        main(["histogram", "-o", str(out), "-k", "21", *mode, *files], spark)
        total = spark.read.parquet(f"{out}/histogram").groupBy().sum("n").first()[0]
        assert total == (80 * 40 if not mode else 80 * 3)
        assert spark.read.parquet(f"{out}/prefix_sums").where("bucket = 1048576").first().before == total
        assert spark.read.parquet(f"{out}/reads_per_chunk").groupBy().sum("n").first()[0] == 80
    main(["ranges", str(tmp_path / "histogram0"), "--parts", "4"], spark)
    assert capsys.readouterr().out.splitlines()[0] == "0 0"
    options = ["--index", str(tmp_path / "index"), "--largest", "--merge-support", "1", "--min-degree", "2", "--max-degree", "50"]
    main(["partition", "-o", str(tmp_path / "out"), "-k", "21", "--parts", "4", *options, *files], spark)
    halves = read_partitions(spark, str(tmp_path / "out/largest")).groupBy("part_id").count().collect()
    assert sum(r["count"] for r in halves) == 80 and 1 in {r.part_id for r in halves}
    assert "components" in capsys.readouterr().out
    parts = sorted(map(str, (tmp_path / "out/reads").glob("part_id=*/part-*")))
    assert {r.header for r in scan_fastq(spark, parts).collect()} == {f"@r{i}/{j}" for i in range(40) for j in (1, 2)}
