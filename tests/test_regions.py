"""Forms of region annotations, overrides, range joins and matrices."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import intervals, regions, spatial
from fathom.sources import readers


def test_forms_of_entries(spark):
    a = {
        "one": {"ranges": [[1, 2]]}, "list": [{"chain": "B", "ranges": [[4, 3], ["5x", "6"]]}, 7, "A_8", "9b"], "scalar": 3, "text": "-2", "id": "C_1", "none": None,
        "dash": {"ranges": "1-3"}, "dashes": {"ranges": ["1-2", "5-4", "x-3", "7"]}, "pair": {"ranges": [2, 4]}, "residues": {"residues": "4", "residue_ids": [" A_9 ", ""]}, "bad": {"ranges": [[1], ["x", 2]]},
    }
    rows = spark.createDataFrame([(1, json.dumps({"default_chain": "A", "regions": a})), (2, json.dumps({"regions": {"one": [1], "two": {"residue_ids": ["Z_1"]}}}))], "key int, annotation string")
    got = {}
    for r in regions.members(regions.parsed(rows), "key").collect():
        got.setdefault((r.key, r.region), set()).add(r.residue_id)
    assert got == {
        (1, "one"): {"A_1", "A_2"}, (1, "list"): {"B_4", "B_3", "B_5", "B_6", "A_7", "A_8", "A_9"}, (1, "scalar"): {"A_3"}, (1, "text"): {"A_-2"}, (1, "id"): {"C_1"},
        (1, "dash"): {"A_1", "A_2", "A_3"}, (1, "dashes"): {"A_1", "A_2", "A_5", "A_4"}, (1, "pair"): {"A_2", "A_3", "A_4"}, (1, "residues"): {"A_4", "A_9"}, (2, "two"): {"Z_1"},
    }


def test_overrides(spark):
    residues = spark.createDataFrame([(s, k, f"A_{k}") for s in (1, 2) for k in range(4)], "sample_id long, idx long, residue_id string")
    bridge = spark.createDataFrame([(1, 0, "plug"), (2, 0, "plug"), (2, 3, "core")], "sample_id long, idx long, region string")
    kind = "scope string, region string, mask array<boolean>, indices array<int>, residue_ids array<string>"
    o = spark.createDataFrame([("*", "plug", None, [1], None), ("2", "plug", [False, False, True, True], None, None), ("1", "box", None, None, ["A_2"])], kind)
    got = {(r.sample_id, r.region, r.idx) for r in regions.overridden(bridge, residues, o).collect()}
    assert got == {(1, "plug", 1), (2, "plug", 2), (2, "plug", 3), (2, "core", 3), (1, "box", 2)}
    for bad in ([("*", "x", [True], None, None)], [("1", "x", None, None, ["A_9"])]):
        with pytest.raises(Exception, match="of region x"):
            regions.overridden(bridge, residues, spark.createDataFrame(bad, kind)).collect()


def test_range_joins(spark):
    rng = np.random.default_rng(0)
    a = [(k, int(x), int(x + n)) for k, (x, n) in enumerate(zip(rng.integers(-50, 50, 60), rng.integers(-2, 30, 60)))]
    b = [(k, int(x), int(x + n)) for k, (x, n) in enumerate(zip(rng.integers(-50, 50, 40), rng.integers(0, 60, 40)))]
    got = sorted((r.i, r.j) for r in intervals.overlaps(spark.createDataFrame(a, "i int, lo int, hi int"), spark.createDataFrame(b, "j int, start int, end int"), 7).collect())
    assert got == sorted((i, j) for i, lo, hi in a for j, s, e in b if lo <= hi and lo <= e and hi >= s)
    rows, few = spark.range(5), spark.range(3).withColumnRenamed("id", "other")
    assert intervals.with_few(rows, few, F.col("id") < F.col("other")).count() == 3
    with pytest.raises(Exception, match="more than 2 rows"):
        intervals.with_few(rows, few, F.col("id") < F.col("other"), most=2).count()


def test_matrices(spark, tmp_path):
    texts = [(1, '{"predicted_aligned_error": [[1, 2], [3, 4]]}'), (2, "[[1, 2]]"), (3, '{"not_pae": []}'), (4, '[{"pae": [[7]]}]')]
    rows = spark.createDataFrame(texts, "key int, m string")
    assert sorted((r.key, r.i, r.j, r.value) for r in readers.matrix_cells(rows, "key", "m").collect()) == [(1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 0, 3), (1, 1, 1, 4), (4, 0, 0, 7)]
    for k in (2, 3):
        with pytest.raises(Exception, match=f"no square matrix for {k}"):
            readers.matrix_cells(rows.where(f"key = {k}"), "key", "m", strict=True).collect()
    np.save(tmp_path / "a.npy", np.arange(4.0).reshape(2, 2))
    cells = readers.array_cells(spark, str(tmp_path))
    assert sorted((r.i, r.j, r.value) for r in cells.collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)]
    m = cells.select(F.lit(1).alias("sample_id"), "i", "j", "value")
    wanted = spark.createDataFrame([(1, 1, 0), (1, 5, 1)], "sample_id int, place long, pos long")
    assert sorted((r.i, r.j, r.value) for r in spatial.submatrix(m, wanted).collect()) == [(0, 0, 3), (0, 1, 0), (1, 0, 0), (1, 1, 0)]
    with pytest.raises(Exception, match="no cell"):
        spatial.submatrix(m, wanted, strict=True).collect()


def test_missing_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert readers.table(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/none.csv"], ["x"], missing_ok=True).count() == 1
    none = readers.table(spark, f"{tmp_path}/none.csv", ["x", "y"], missing_ok=True)
    assert none.columns == ["x", "y"] and none.count() == 0
