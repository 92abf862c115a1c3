"""Sample loaders, case exports, audits and summary rows at their edges."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.operators import cases, coordinate_tables, loaders, manifest

V = "array<array<double>>"
RECORD = f"sample_id string, y_delta {V}, af2_pos {V}, plddt array<double>, manifest_row map<string,string>, metadata map<string,string>, family string, family_id int"


def record(name="s", target=((1.0, 0.0, 0.0), (0.0, 1.0, 0.0)), pos=((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), plddt=None, row=None, meta=None, family=None, fid=None):
    return (name, target and [list(v) for v in target], pos and [list(v) for v in pos], plddt, row, meta, family, fid)


def test_labels_by_precedence(spark):
    rows = [record("a", row={"family": "Fep A"}, meta={"family": "x"}), record("b", row={"family": ""}, meta={"family": "Fec-A "}, family="y"), record("c", family="Fhu A"), record("d", fid=7), record("e")]
    got = {r.sample_id: (r.family, r.state) for r in loaders.load_samples(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {"a": ("fep_a", "unknown"), "b": ("fec_a", "unknown"), "c": ("fhu_a", "unknown"), "d": ("id_7", "unknown"), "e": ("unknown", "unknown")}


def test_confidences_of_any_length(spark):
    rows = [record("one", plddt=[3.0]), record("all", plddt=[1.0, 2.0]), record("odd", plddt=[1.0, 2.0, 3.0]), record("none")]
    got = {}
    for r in loaders.load_samples(spark.createDataFrame(rows, RECORD)).orderBy("idx").collect():
        got.setdefault(r.sample_id, []).append(r.plddt)
    assert got == {"one": [3.0, 3.0], "all": [1.0, 2.0], "odd": [0.0, 0.0], "none": [0.0, 0.0]}
    assert loaders.load_samples(spark.createDataFrame([], RECORD)).collect() == []


@pytest.mark.parametrize("bad, says", [(record("q", target=None), "no target vectors in q"), (record("q", pos=None), "no start coordinates in q"), (record("q", pos=((0.0, 0.0, 0.0),)), "differ in length in q"), (record("q", target=((1.0, 2.0), (1.0, 2.0))), "without three numbers in q")])
def test_samples_that_lack_something_are_named(spark, bad, says):
    with pytest.raises(Exception, match=says):
        loaders.load_samples(spark.createDataFrame([bad], RECORD)).collect()


def test_vocabularies(spark):
    df = spark.createDataFrame([record("a", family="fepA")], RECORD)
    assert loaders.load_samples(df, {"family": ["fepa"]}).count() == 2
    with pytest.raises(Exception, match="unknown family fepa in a"):
        loaders.load_samples(df, {"family": ["other"]}).collect()


def test_case_lines_and_places(spark):
    df = spark.createDataFrame([("s", 0, "A_12", ["eval", "tonb_box"], 1.0, 2.0, 3.0, 0.5), ("s", 1, "B_7x", ["eval"], 1.0, 2.0, 3.0, 0.5), ("s", 2, "99", [], -1.0, 0.0, 0.0, 0.0)], "sample_id string, idx long, residue_id string, regions array<string>, x double, y double, z double, px double").withColumns({"py": F.lit(0.0), "pz": F.lit(0.0)})
    got = {(r.structure, r.line_no): r.line for r in cases.case_lines(df, {"start": "", "moved": "p"}).collect()}
    assert got["start", 1] == "ATOM      1  CA  TON A  12       1.000   2.000   3.000  1.00100.00           C"
    assert got["moved", 2].startswith("ATOM      2  CA  EVL B   7       1.500") and got["start", 3].startswith("ATOM      3  CA  GLY A  99      -1.000") and got["moved", 4] == "END" and len(got) == 8
    rows = {(r.region, r.structure): r for r in cases.case_centroids(df, {"start": "", "moved": "p"}).collect()}
    assert rows["eval", "moved"].displacement == 0.5 and rows["eval", "start"].displacement == 0 and rows["eval", "start"].n_residues == 2 and set(rows) == {(a, b) for a in ("eval", "tonb_box") for b in ("start", "moved")}


def test_audit_of_nothing_missing_and_all_missing(spark):
    figures = spark.createDataFrame([("a", ["x", "y"], "out/a"), ("b", ["z"], "out/b"), ("c", [], "out/c")], "figure_id string, sources array<string>, output string")
    listing = spark.createDataFrame([("x",), ("y",), ("out/a.png",), ("out/c.png",)], "path string")
    got = {r.figure_id: tuple(r)[1:] for r in cases.audit(figures, listing, ["png"]).collect()}
    assert got["a"][0] == got["c"][0] == "pass" and got["b"] == ("needs_attention", "fit_for_stated_claim", "z", "out/b.png")


def test_summary_rows_of_half_reports(spark):
    bodies = [{"aggregate_by_region": {"plug": {"zero_error_rms": 2}, "x": {}}}, {"paired_delta_by_region": {"eval": {"n_targets": 4}}, "paired_effect_by_region": {"eval": 0.5, "plug": 1}}, {}]
    df = spark.createDataFrame([(f"m{i}", "l", "c", "s", json.dumps(b)) for i, b in enumerate(bodies)] + [("n", "l", "c", "s", None)], "method string, label string, category string, source string, body string")
    got = {(r.method, r.region): (r.raw_rmsd, r.n_targets, r.signed_rank_biserial_effect_method_lt_raw, r.region_order) for r in coordinate_tables.summary_rows(df, ("eval", "plug")).collect()}
    assert got == {("m0", "plug"): (2.0, None, None, 2), ("m1", "eval"): (None, 4.0, 0.5, 1)}


def test_prepared_rows_share_an_annotation(spark):
    columns = "position long, pair_id string, target_id string, family string, uniprot_id string, pdb_chain string, state_label string, region_annotation_json string, notes string, split string, af2_pdb string"
    row = lambda p, pair, target="T/1", note=None, split=None: (p, pair, target, "f", "U1", "C", "holo", None, note, split, None)
    df = spark.createDataFrame([row(1, "a"), row(2, "b", note="x"), row(3, "c"), row(4, "d", target=None, split="test")], columns)
    none = spark.createDataFrame([], "path string, has_core boolean")
    found = spark.createDataFrame([("b",), ("d",)], "pair_id string")
    kept, lost = manifest.prepared_manifest(df, none, none, found, "ann/auto", needed=["af2_pdb"])
    got = {r.pair_id: (r.annotation_source, r.region_annotation_json, r.notes, r.holo_chain) for r in kept.collect()}
    assert got == {"b": ("generated", "ann/auto/t_1.json", f"x; {manifest.NOTE}", "C"), "c": ("cached", "ann/auto/t_1.json", manifest.NOTE, "C"), "d": ("generated", "ann/auto/f_u1.json", manifest.NOTE, "C")}
    assert [(r.pair_id, r.reason) for r in lost.collect()] == [("a", "no_matching_entity")]
    assert {r.pair_id: r.split for r in kept.collect()}["d"] == "test"


@pytest.mark.parametrize("cell", [None, " "])
def test_rows_without_a_path_are_dealt_out(spark, cell):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        rows = spark.range(400).select(F.col("id").alias("position"), F.when(F.col("id") < 3, "x").otherwise(F.lit(cell)).alias("path_of"))
        table = spark.createDataFrame([("x", True), (" ", True)], "path string, there boolean")
        got = manifest.looked_up(rows, F.col("path_of"), table, "position").withColumn("part", F.spark_partition_id()).collect()
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert sorted(r.position for r in got) == list(range(400)) and {r.position for r in got if r.there} == {0, 1, 2}
    parts = [r.part for r in got]
    assert max(map(parts.count, set(parts))) < 200


def test_a_prepared_row_is_dealt_out_once_for_its_lookups(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {c: spark.conf.get(c) for c in conf}
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sum(e.totalShuffleWrite() for e in (lambda s: [s.apply(i) for i in range(s.size())])(sc.statusStore().executorList(False)))

    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        text = lambda c: F.concat(F.lit(c), F.col("id").cast("string"))
        wide = F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 256) for i in range(60)))
        rows = spark.range(300).select(F.col("id").alias("position"), F.when(F.col("id") % 50 != 7, text("p")).alias("pair_id"), text("T").alias("target_id"), F.lit("f").alias("family"), F.lit("u").alias("uniprot_id"), F.lit("C").alias("pdb_chain"), F.lit("holo").alias("state_label"), F.lit(None).cast("string").alias("region_annotation_json"), wide.alias("notes"), F.lit("test").alias("split"), text("m").alias("af2_pdb"))
        files, known = rows.where("position > 9").select(F.col("af2_pdb").alias("path")), spark.createDataFrame([("ann/T20.json", False), ("ann/auto/t21.json", True)], "path string, has_core boolean")
        before = shuffled()
        kept, lost = manifest.prepared_manifest(rows, files, known, rows.where("position > 19").select("pair_id"), "ann/auto", needed=["af2_pdb"])
        got = {r.position: r.annotation_source for r in kept.collect()}
        written = shuffled() - before
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert got == {p: {20: "existing", 21: "cached"}.get(p, "generated") for p in range(20, 300) if p % 50 != 7}
    assert {r.position: r.reason for r in lost.collect()} == {p: "missing_local_files:af2_pdb" if p < 10 else "no_matching_entity" for p in range(300) if p < 20 or p % 50 == 7}
    assert written < 4 * 300 * 60 * 64
