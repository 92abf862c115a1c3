"""Record operators that no query covers."""

import pytest
from pyspark.sql import functions as F

from fathom.operators import records
from fathom.sources import readers


def test_infer_columns():
    assert records.infer_columns(["receptor_a", "receptor_b", "x", "receptor_"], ["receptor_"], ["receptor_b"]) == {"a": "receptor_a"}


def test_strict_lookup_fails(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match for 2"):
        records.strict_lookup(a, b, ["k"]).collect()


def test_matched_entities(spark):
    rows = spark.createDataFrame([("e", "P1", "A"), ("e", "P1", "Z")], "entry string, accession string, chain string")
    ent = spark.createDataFrame([("e", "second", 2, ["P1"], ["A"]), ("e", "first", 1, ["P1", "P2"], ["A", "B"])], "entry string, entity string, pos int, accessions array<string>, chains array<string>")
    assert [tuple(r) for r in records.matched_entities(rows, ent).collect()] == [("e", "P1", "A", "first")]


def test_bonds(spark):
    bonds = spark.createDataFrame([("s", 1, [2, 9]), ("s", 8, [1])], "id string, src int, dsts array<int>")
    keep = spark.createDataFrame([("s", 1), ("s", 2)], "id string, serial int")
    assert [(r.src, r.dst) for r in records.bonds_of(bonds, keep, ["id"]).collect()] == [(1, 2)]


def test_pose_deviation(spark):
    atoms = spark.createDataFrame([("t", 1, 1, "C", 1.0), ("t", 1, 2, "H", 9.0), ("t", 1, 3, "O", 2.0), ("t", 2, 1, "C", 0.0)], "target string, pose int, serial int, element string, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    ref = spark.createDataFrame([("t", 1, "C", 0.0), ("t", 2, "O", 1.0)], "target string, serial int, element string, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = {r.pose: r.rmsd for r in records.pose_deviation(atoms, ref, ["target", "pose"]).collect()}
    assert got == {1: 1.0, 2: None}
    swapped = atoms.withColumn("element", F.when(F.col("serial") == 3, "N").otherwise(F.col("element")))
    assert {r.rmsd for r in records.pose_deviation(swapped, ref, ["target", "pose"]).collect()} == {None}
    unknown = [df.withColumn("element", F.when(F.col("element") != "O", F.col("element"))) for df in (atoms, ref)]
    assert {r.pose: r.rmsd for r in records.pose_deviation(*unknown, ["target", "pose"]).collect()} == {1: 1.0, 2: None}


def test_ordered_ids_and_present(spark):
    a = spark.createDataFrame([("f", 3, "A", "A_2"), ("f", 1, "A", "A_9"), ("f", 5, "A", "A_9"), ("f", 2, "B", "B_1")], "f string, line_no int, chain string, residue_id string")
    assert [r.residue_id for r in records.ordered_ids(a, ["f"], "A").orderBy("idx").collect()] == ["A_9", "A_2"]
    assert records.present(spark.createDataFrame([(" ",), (None,), ("1",)], "c string"), "c").count() == 1


def test_docking_scores(spark):
    text = "MODEL 1\nREMARK VINA RESULT:   -8.2  0.0  0.0\nATOM\nREMARK VINA RESULT: -7.1 1 2"
    rows = readers.numbered(spark.createDataFrame([("f", text)], "f string, t string"), "f", "t")
    assert [r.score for r in readers.docking_scores(rows, "f").orderBy("position").collect()] == [-8.2, -7.1]


def test_matrix_shapes(spark):
    texts = ["[[1,2],[3,4]]", '{"predicted_aligned_error":[[1,2],[3,4]]}', '[{"pae":[[1,2],[3,4]]}]', '{"not_pae":[]}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, m string")
    got = readers.matrix_cells(df, "k", "m").collect()
    assert len(got) == 12 and {r.value for r in got if r.i == 1 and r.j == 0} == {3.0}


def test_listed_ids_and_first_existing(spark):
    rows = readers.numbered(spark.createDataFrame([("f", "a/b/s1.pt # note\n\n# only\ns2")], "f string, t string"), "f", "t")
    assert sorted(r.id for r in readers.listed_ids(rows).collect()) == ["s1", "s2"]
    c = spark.createDataFrame([(1, "/no", "/yes")], "k int, a string, b string")
    assert readers.first_existing(c, "k", ["a", "b"], spark.createDataFrame([("/yes",)], "path string")).first().path == "/yes"
