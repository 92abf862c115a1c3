"""Structure and matrix files read in parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.sources import formats


def atom(serial, chain, x, record="ATOM"):
    return f"{record:<6}{serial:>5}  CA  ALA {chain}{serial % 9999:>4}    {x:8.3f}{-x:8.3f}{0.5:8.3f}{1:6.2f}{serial / 10:6.2f}          {'C':>2}"


def many_models(path, models, atoms, end="\n"):
    lines = ["HEADER    TEST"]
    for m in range(1, models + 1):
        lines += [f"MODEL     {m:>4}", *(atom(k, "AB"[k % 2], m + k / 8) for k in range(1, atoms + 1)), "ENDMDL"]
    path.write_text(end.join(lines) + end)


@pytest.mark.parametrize("block", [97, 1000, 1 << 25])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_models_are_read_once_whatever_the_blocks(spark, tmp_path, block, end):
    many_models(tmp_path / "a.pdb", 7, 5, end)
    (tmp_path / "b.pdb").write_text(end.join([atom(1, "A", 1.0), atom(2, "B", 2.0, "HETATM"), "TER"]))
    formats.register(spark)
    df = spark.read.format("structures").option("blockBytes", block).load(f"{tmp_path}/*.pdb")
    rows = sorted((r.path.rpartition("/")[2], r.model, r.serial, r.chain, r.x, r.y, r.b_factor, r.hetero, r.element) for r in df.collect())
    want = [("a.pdb", m, k, "AB"[k % 2], m + k / 8, -(m + k / 8), k / 10, False, "C") for m in range(1, 8) for k in range(1, 6)]
    assert rows == sorted([*want, ("b.pdb", 1, 1, "A", 1.0, -1.0, 0.1, False, "C"), ("b.pdb", 1, 2, "B", 2.0, -2.0, 0.2, True, "C")])
    assert block > 97 or df.rdd.getNumPartitions() > 10


def test_filters_are_pushed_and_right(spark, tmp_path):
    many_models(tmp_path / "a.pdb", 6, 4)
    formats.register(spark)
    df = spark.read.format("structures").option("blockBytes", 300).load(str(tmp_path / "a.pdb"))
    kept = df.where("chain = 'A' and model in (2, 5) and serial > 2")
    assert sorted((r.model, r.serial) for r in kept.collect()) == [(2, 4), (5, 4)]
    assert df.where("chain = 'Z'").count() == 0 and df.where("chain = 'A' and chain = 'B'").count() == 0 and df.where("model = 3").count() == 4
    reader = formats.StructureReader(str(tmp_path / "a.pdb"), 1 << 20)
    left = list(reader.pushFilters([formats.EqualTo(("chain",), "A"), formats.LessThan(("serial",), 3)]))
    assert len(left) == 1 and reader.wanted == {"chain": {"A"}}


def test_odd_lines_and_missing_files(spark, tmp_path):
    (tmp_path / "odd.pdb").write_text("ATOM      x  CA  ALA A   1      bad\n\nATOM\n")
    formats.register(spark)
    rows = spark.read.format("structures").load(str(tmp_path)).collect()
    assert [(r.serial, r.resseq, r.x, r.chain) for r in rows] == [(None, 1, None, "A"), (None, None, None, "")]
    assert spark.read.format("structures").load(f"{tmp_path}/*.none").collect() == []


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<i2"])
def test_matrices_by_rows(spark, tmp_path, kind):
    m = (np.arange(49).reshape(7, 7) * 3).astype(kind)
    np.save(tmp_path / "m.npy", m)
    np.save(tmp_path / "n.npy", m[:1, :1])
    formats.register(spark)
    df = spark.read.format("matrices").option("blockBytes", 60).load(f"{tmp_path}/*.npy")
    rows = {(r.path.rpartition("/")[2], r.i, r.j): r.value for r in df.collect()}
    assert rows == {("m.npy", i, j): float(m[i, j]) for i in range(7) for j in range(7)} | {("n.npy", 0, 0): 0.0}
    some = df.where("i >= 2 and i < 4 and j > 4").agg(F.sum("value"), F.count("*")).first()
    assert tuple(some) == (float(m[2:4, 5:].sum()), 4) and df.where("i = 6").count() == 7
    np.save(tmp_path / "bad.npy", np.zeros((2, 3)))
    with pytest.raises(Exception, match="square"):
        spark.read.format("matrices").load(f"{tmp_path}/bad.npy").collect()
