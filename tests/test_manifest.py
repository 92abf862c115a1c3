"""The training manifest, made annotations, logs and bundles."""

import json

from pyspark.sql import functions as F

from fathom.operators import manifest, regions


def test_annotations_are_read_back(spark):
    rows = spark.createDataFrame(
        [(1, "A", 1, 200, [("Plug domain", 20, 60), ("signal", 1, 9), ("plug tail", 70, 65)]), (2, "B", 1, 100, [])],
        "key int, chain string, modelled_lo int, modelled_hi int, f array<struct<name:string,start:int,end:int>>",
    ).withColumns({"plug": manifest.feature_ranges("f", ["plug"]), "barrel": manifest.feature_ranges("f", ["barrel"]), "box": manifest.feature_ranges("f", ["box"])})
    made = manifest.annotation(rows, "key")
    got = {r.key: json.loads(r.annotation)["regions"] for r in made.collect()}
    # the core is sixteen windows of ten residues between the barrel's ends; the box is the first seven residues, before the plug
    assert got[1]["plug"][0]["ranges"] == [[20, 60]] and got[1]["tonb_box"][0]["ranges"] == [[1, 7]] and got[1]["extracellular_loop"] == []
    core = got[1]["barrel_core"][0]["ranges"]
    centres = [round(61 + 5 + i * 130 / 15) for i in range(16)]
    assert core == sorted([max(61, min(200, c - 5 + 9) - 9), min(200, c - 5 + 9)] for c in centres) and core[0] == [61, 70] and core[-1] == [191, 200]
    assert got[2]["barrel_core"][0]["ranges"][0] == [26, 35] and got[2]["plug"][0]["ranges"] == [] and got[2]["tonb_box"][0]["ranges"] == [[1, 7]]
    whole = json.loads(made.first().annotation)
    assert whole["loss_weights"]["default"] == 1.0 and whole["eval_regions"] == ["plug", "extracellular_loop", "tonb_box", "substrate_contact"]
    members = regions.members(regions.parsed(made), "key")
    assert members.where("key = 1 and region = 'plug'").count() == 41


def test_annotations_at_the_edges(spark):
    rows = spark.createDataFrame(
        [(1, "A", 5, 100, [[8, 40]], []), (2, "A", 5, 40, [[5, 60]], []), (3, "A", 1, 60, [], [[20, 26]]), (4, "A", 1, 60, [], [[1, 8], [30, 60]])],
        "key int, chain string, modelled_lo int, modelled_hi int, plug array<array<int>>, barrel array<array<int>>",
    )
    got = {r.key: json.loads(r.annotation)["regions"] for r in manifest.annotation(rows, "key", count=2).collect()}
    assert got[1]["tonb_box"][0]["ranges"] == [[5, 7]]  # cut before the plug
    assert got[2]["tonb_box"][0]["ranges"] == [[5, 5]] and got[2]["barrel_core"][0]["ranges"] == [[40, 40]]  # never below one residue; held to the model's end
    assert got[3]["barrel_core"][0]["ranges"] == [[20, 26]] and got[4]["barrel_core"][0]["ranges"] == [[1, 10], [51, 60]]


def test_training_manifest(spark):
    rows = [(1, "p1", "Apo", "a", ""), (2, "p1", "Apo", "a", ""), (3, "p2", "odd", "a", ""), (4, "p3", "apo", "none", ""), (5, "p4", "APO", "b", " Test "), (6, "p5", "apo", "a", None)]
    df = spark.createDataFrame(rows, "line int, pair_id string, state_label string, path string, split string")
    kept, gone = manifest.training_manifest(df, ["apo"], spark.createDataFrame([("a",), ("b",), ("a",)], "path string"), ["line"])
    assert {r.pair_id for r in kept.collect()} == {"p1", "p4", "p5"} and kept.where("pair_id = 'p4'").first().split.strip() == "test"
    assert {(r.line, r.reason) for r in gone.collect()} == {(2, "duplicate_pair"), (3, "state_not_wanted"), (4, "file_missing")}


def test_rank_splits_of_few_rows(spark):
    from fathom.operators.splits import rank_split

    for n, want in ((1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (4, (2, 1, 1)), (10, (7, 2, 1)), (20, (14, 3, 3))):
        rows = spark.range(n).select(F.concat(F.lit("p"), "id").alias("pair_id"))
        got = {r.split: r["count"] for r in rank_split(rows, "pair_id").groupBy("split").count().collect()}
        assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == want, n
    given = spark.createDataFrame([("a", "expansion"), ("b", "candidate"), ("c", None), ("d", "test"), ("e", " ")], "pair_id string, g string")
    got = {r.pair_id: r.split for r in rank_split(given, "pair_id", given="g").collect()}
    assert got["d"] == "test" and sorted(got[k] for k in "abce") == ["test", "train", "train", "val"]


def test_chosen_splits(spark):
    import pytest

    from fathom.operators.splits import chosen_splits

    rows = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "k int, split string")
    targets, donors = chosen_splits(rows, "test")
    assert [r.k for r in targets.collect()] == [3] and sorted(r.k for r in donors.collect()) == [1, 2]
    with pytest.raises(Exception, match="no target rows"):
        chosen_splits(rows, "none")[0].collect()
    with pytest.raises(Exception, match="no donor rows"):
        chosen_splits(rows.where("k = 3"))[1].collect()


def test_log_and_bundle(spark, tmp_path):
    manifest.append_log(spark.createDataFrame([(1, 0.5)], "epoch int, loss double"), f"{tmp_path}/log")
    manifest.append_log(spark.createDataFrame([(2, 0.4, 1.5)], "epoch int, loss double, seconds double"), f"{tmp_path}/log")
    assert sorted(tuple(r) for r in manifest.read_log(spark, f"{tmp_path}/log").select("epoch", F.coalesce("seconds", F.lit(0.0))).collect()) == [(1, 0.0), (2, 1.5)]
    got = manifest.bundle({"a": spark.range(3), "b": spark.range(0)}, f"{tmp_path}/report")
    assert {(r.name, r.n) for r in got.collect()} == {("a", 3), ("b", 0)}
