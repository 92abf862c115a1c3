"""Readers and writers on files."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.operators import metrics, ranking
from fathom.sources import readers, sinks


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5), (2, float("nan")), (3, float("inf")), (4, None)], "k int, v double")
    sinks.write_json(df, f"{tmp_path}/out")
    rows = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted((r["k"], r["v"]) for r in rows) == sorted([(1, 1.5), (2, None), (3, None), (4, None)])
    texts = spark.createDataFrame([(1, '{"a": 3}'), (2, "no"), (3, None)], "k int, t string")
    assert [r.object and r.object.a for r in readers.json_objects(texts, "t", "a int").orderBy("k").collect()] == [3, None, None]
    with pytest.raises(Exception):
        readers.json_objects(texts, "t", "a int", strict=True).select("object").collect()


def test_files_by_key_and_samples(spark, tmp_path):
    sinks.write_by_key(spark.range(6).withColumn("g", F.col("id") % 3), f"{tmp_path}/out", "g")
    assert sorted(p.name for p in (tmp_path / "out").glob("g=*")) == ["g=0", "g=1", "g=2"]
    assert sorted(r.id for r in readers.samples(spark, f"{tmp_path}/out").collect()) == list(range(6))
    with pytest.raises(Exception):
        readers.samples(spark, f"{tmp_path}/none").collect()


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n\nfour")
    assert [(r.line_no, r.value) for r in readers.lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, "one"), (2, "two"), (3, ""), (4, "four")]


def test_atoms_behind_wide_serials(spark):
    line = "ATOM  {:5d}  CA  ALA B{:4d}A   {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}"
    serials = [1, 99999, 100000, 1234567]
    lines = spark.createDataFrame([("f", n, line.format(k, 37, -9.001, 1.5, 123.25, 0.5, 7.0)) for n, k in enumerate(serials)], "file string, line_no int, value string")
    got = readers.atoms(lines, "file").orderBy("line_no").collect()
    assert [r.serial for r in got] == serials
    assert {(r.atom, r.altloc, r.resname, r.chain, r.resseq, r.icode, r.x, r.y, r.z, r.occupancy, r.b_factor) for r in got} == {("CA", "", "ALA", "B", 37, "A", -9.001, 1.5, 123.25, 0.5, 7.0)}


def test_displaced_atoms(spark):
    atoms = spark.createDataFrame([("A", 1, 0.0, 0.0, 0.0), ("A", 1, 1.0, 0.0, 0.0), ("A", 2, 5.0, 5.0, 5.0)], "chain string, resseq int, x double, y double, z double")
    shifts = spark.createDataFrame([("A", 1, 1.0, 2.0, 3.0)], "chain string, resseq int, dx double, dy double, dz double")
    got = sorted(tuple(r) for r in sinks.displaced(atoms, shifts, ["chain", "resseq"]).select("x", "y", "z").collect())
    assert got == [(1, 2, 3), (2, 2, 3), (5, 5, 5)]


def test_core_on_every_row_and_interval(spark):
    rows = spark.createDataFrame([(1, "barrel_core", 0.5), (1, "plug", 2.0), (2, "plug", 1.0)], "sample_id int, region string, error_rms double")
    assert sorted((r.sample_id, r.region, r.core_rms) for r in metrics.with_core(rows, ["sample_id"]).collect()) == [(1, "barrel_core", 0.5), (1, "plug", 0.5), (2, "plug", None)]
    poses = spark.createDataFrame([("s", float(k), 1) for k in range(10)], "structure string, rmsd double, position int")
    r = ranking.top1_interval(poses, ["structure"]).first()
    assert (r.n, r.rate) == (10, 0.2) and 0 <= r.low < 0.2 < r.high < 0.7
