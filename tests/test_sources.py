import pytest

from manifoldry.sources import files as S
from manifoldry.streaming.resume import pending, score_stream


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a|1", "A" * 130), ("b", "CD")], "seq_id string, sequence string")
    S.write_fasta(df.coalesce(1), str(tmp_path / "f"), 60)
    back = {r.seq_id: r.sequence for r in S.read_fasta(spark, str(tmp_path / "f")).collect()}
    assert back == {"a|1": "A" * 130, "b": "CD"}


def test_delimited_and_intervals(spark, tmp_path):
    (tmp_path / "d.txt").write_text("# c\n\n1abc; A ;x\nshort\n")
    rows = S.read_delimited(spark, str(tmp_path / "d.txt"), {"pdb": 0, "chain": 1}, min_fields=3).collect()
    assert [tuple(r) for r in rows] == [("1abc", "A")]
    (tmp_path / "i.tsv").write_text("acc\tstart\tend\nP1\t3\t9\nP2\tx\t4\nP3\t1\n")
    assert [tuple(r) for r in S.read_intervals(spark, str(tmp_path / "i.tsv")).collect()] == [("P1", 3, 9)]


def test_regions_last_file_wins(spark, tmp_path):
    for n, end in (("a", 5), ("b", 9)):
        (tmp_path / f"{n}.json").write_text('{"dataset":"d","total_sequences":1,"sequences":[{"id":"x","sequence":"AA","length":2,"regions":[{"type":"t","start":1,"end":%d}]}]}' % end)
    rows = S.read_regions(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert [tuple(r) for r in rows.collect()] == [("x", "t", 1, 9)]
    S.write_regions(rows.selectExpr("*", "'AA' AS sequence"), str(tmp_path / "out"), "d")
    r = spark.read.json(str(tmp_path / "out")).head()
    assert (r.dataset, r.total_sequences, r.sequences[0].sequence, r.sequences[0].length) == ("d", 1, "AA", 2)
    assert [tuple(r) for r in S.read_regions(spark, str(tmp_path / "out"), lines=True).collect()] == [("x", "t", 1, 9)]


def test_atoms(spark, tmp_path):
    line = "ATOM      1  CA  ALA A   7      11.104   6.134  -6.504  1.00  0.00           C"
    (tmp_path / "x.pdb").write_text(line + "\nHETATM" + line[6:] + "\nTER\n")
    r = S.read_atoms(spark, str(tmp_path / "x.pdb")).collect()
    assert len(r) == 1 and (r[0].chain, r[0].resseq, r[0].resname, r[0].atom, r[0].x, r[0].z) == ("A", 7, "ALA", "CA", 11.104, -6.504)
    assert S.read_atoms(spark, str(tmp_path / "x.pdb"), hetero=True).count() == 2
    (tmp_path / "m.pdb").write_text(f"MODEL        1\n{line}\n{line}\nENDMDL\nMODEL        2\n{line}\n")
    atoms = S.read_atoms(spark, str(tmp_path / "m.pdb"))
    assert sorted(r.model for r in atoms.collect()) == [1, 1, 2] and sorted(r.model for r in S.ca_points(atoms).collect()) == [1, 2]


def test_table_listing_and_control(spark, tmp_path):
    S.write_result(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "t"), "csv")
    assert [tuple(r) for r in S.read_table(spark, str(tmp_path / "t"), "k string, v int").collect()] == [("a", 1)]
    (tmp_path / "AB.pdb").write_text("x")
    names = S.list_files(spark, str(tmp_path), ".pdb")
    df = spark.createDataFrame([("ab",), ("cd",)], "k string")
    assert [r.k for r in S.with_files(df, names, df.k, "name").collect()] == ["ab"]
    rows = S.generate_control(spark, 20, "AC", [3, 1]).collect()
    assert len(rows) == 20 and all(40 <= len(r.sequence) == r.length <= 300 and set(r.sequence) <= {"A", "C"} for r in rows)


@pytest.mark.parametrize("split", [90, 400, 1 << 20])
def test_atoms_of_files_larger_than_a_split(spark, tmp_path, split):
    """Models that go on over several splits; a file without MODEL lines; lines of other kinds between."""
    line = lambda i: f"ATOM  {i % 99999:5d}  CA  ALA A{i % 9999:4d}    {i / 10:8.3f}{0:8.3f}{1:8.3f}"
    want = {}
    for name, models in (("a", {3: 17, 5: 40, 12: 1}), ("b", {None: 30}), ("c", {1: 3, 2: 0, 7: 25})):
        text = ["HEADER x", "REMARK"]
        for model, n in models.items():
            text += [] if model is None else [f"MODEL     {model:4d}"]
            for i in range(n):
                want[name, len(text)] = (model or 1, i)
                text.append(line(i))
            text += ["TER", "ENDMDL"]
        (tmp_path / f"{name}.pdb").write_text("\n".join(text) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = S.read_atoms(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r.file[-5], r.place): (r.model, r.resseq) for r in rows} == want and len(rows) == len(want)


def test_resume(spark, tmp_path):
    src, sink, mark = (str(tmp_path / n) for n in ("src", "sink", "mark"))
    for lo in (0, 5):
        spark.range(lo, lo + 5).coalesce(1).write.mode("append").parquet(src)
        score_stream(spark, src, "id long", sink, mark, lambda b: b.selectExpr("id", "id * 2 AS score"))
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(10))
    assert pending(spark.range(12), spark.read.parquet(sink), "id").count() == 2


def test_a_batch_that_fails_half_way_is_not_written_twice(spark, tmp_path):
    src, sink, mark = (str(tmp_path / n) for n in ("src", "sink", "mark"))
    spark.range(8).coalesce(1).write.parquet(src)

    def half(batch):
        batch.write.mode("overwrite").parquet(f"{sink}/batch=0")  # what a run may have left when it was lost
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        score_stream(spark, src, "id long", sink, mark, half)
    score_stream(spark, src, "id long", sink, mark, lambda b: b)
    score_stream(spark, src, "id long", sink, mark, lambda b: b)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(8))
