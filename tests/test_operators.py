"""Single operators on small inputs with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import clean
from fathom.operators import baselines, curves, geometry, metrics, ranking, regions, reports, spatial, splits, stats
from fathom.sources import readers, sinks
from fathom.streaming import incremental


def test_bins():
    assert [b[2] for b in clean.bin_labels([0, 0.5, 1])] == ["0to0p5", "0p5to1", "gt1"]
    for bad in ([0, 0], [1]):
        with pytest.raises(ValueError):
            clean.bin_labels(bad)


def test_place_ids(spark):
    df = spark.createDataFrame([("A_B_-12C",), ("plain",)], "id string")
    a, b, c = clean.place_id("id")
    assert [tuple(r) for r in df.select(a, b, c).collect()] == [("A_B", -12, "C"), ("plain", 0, "")]


def test_numbers_and_blanks(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("",), ("x",), ("nan",), (None,)], "c string")
    got = [r[0] for r in df.select(clean.finite(clean.number("c"))).collect()]
    assert got == [1.5, None, None, None, None]
    assert [r[0] for r in df.select(clean.label("c")).collect()] == ["1.5", "unknown", "x", "nan", "unknown"]


def test_region_metrics_of_zero_prediction(spark):
    rows = spark.createDataFrame([("s", 0, 1.0, 0.0, 0.0, "plug"), ("s", 1, 0.0, 2.0, 0.0, "core")], "sample_id string, idx int, tx double, ty double, tz double, region string")
    rows = rows.withColumns({c: F.lit(0.0) for c in ("px", "py", "pz")})
    got = {r.region: r for r in metrics.region_metrics(rows, ["region"]).collect()}
    assert got["plug"].n == 1 and got["plug"].error_rms == got["plug"].zero_rms == 1.0
    assert got["core"].better_than_zero_rate == 0.0 and got["core"].worse_than_zero_rate == 1.0


def test_missing_prediction(spark):
    res = spark.createDataFrame([("s", 0, 1.0, 0.0, 0.0)], "sample_id string, idx int, tx double, ty double, tz double")
    none = spark.createDataFrame([], "sample_id string, idx int, px double, py double, pz double")
    assert metrics.joined_predictions(res, none).first().px == 0.0
    with pytest.raises(Exception, match="prediction missing"):
        metrics.joined_predictions(res, none, strict=True).collect()


def test_zero_target_has_no_fraction(spark):
    rows = spark.createDataFrame([(0.0,) * 6], "tx double, ty double, tz double, px double, py double, pz double").withColumn("region", F.lit("r"))
    got = metrics.region_metrics(rows, ["region"]).first()
    assert got.improvement_fraction is None and got.direction_cosine is None


def test_annotation_masks(spark):
    text = '{"default_chain":"A","regions":{"barrel_core":[{"ranges":[[1,2]]}],"plug":[{"residues":[3,4]}],"tonb_box":[{"residue_ids":["A_5"]}]},"eval_regions":["plug","tonb_box"],"loss_weights":{"default":0.3,"barrel_core":0.1,"plug":2.0,"tonb_box":3.0}}'
    a = regions.parsed(spark.createDataFrame([(1, text)], "key int, annotation string"))
    res = spark.createDataFrame([(1, f"A_{i}") for i in range(1, 7)], "key int, residue_id string")
    order = ["barrel_core", "plug", "tonb_box"]
    got = regions.region_features(res, regions.members(a, "key"), a, "key", order, order).orderBy("residue_id").collect()
    assert [r.is_eval for r in got] == [False, False, True, True, True, False]
    assert [r.weight for r in got] == [0.1, 0.1, 2.0, 2.0, 3.0, 0.3]


def test_no_region_means_all_are_evaluated(spark):
    a = regions.parsed(spark.createDataFrame([(1, '{"default_chain":"A","regions":{"plug":[{"residues":[99]}]},"eval_regions":["plug"],"loss_weights":{"default":1.0}}')], "key int, annotation string"))
    res = spark.createDataFrame([(1, "A_1"), (1, "A_2")], "key int, residue_id string")
    got = regions.region_features(res, regions.members(a, "key"), a, "key", ["plug"], ["plug"]).collect()
    assert all(r.is_eval for r in got)


def test_ranked_by_rank_then_score(spark):
    rows = [("A", 2, 3.0, 0.0), ("A", 1, 1.5, 0.0), ("B", 1, 2.5, 0.0)]
    df = spark.createDataFrame(rows, "target string, rank int, rmsd double, score double")
    top = ranking.ranked(df, ["target"], ["rmsd"]).where("position = 1").orderBy("target").collect()
    assert [r.rmsd for r in top] == [1.5, 2.5]


def test_curve_areas(spark):
    rows = [(0, 0.0), (0, 0.1), (1, 0.9), (1, 0.8), (0, 0.2)]
    got = curves.areas(spark.createDataFrame(rows, "y int, score double").withColumn("g", F.lit(1)), ["g"]).first()
    assert got.auroc == 1.0 and got.average_precision == 1.0
    one = curves.areas(spark.createDataFrame([(1, 0.5)], "y int, score double").withColumn("g", F.lit(1)), ["g"]).first()
    assert one.auroc is None


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)], "x double, y double").withColumn("g", F.lit(1))
    assert stats.spearman(df, "x", "y", ["g"]).first().spearman == pytest.approx(1.0)
    flat = df.withColumn("y", F.lit(1.0)).agg(stats.pearson_of("x", "y").alias("p")).first()
    assert flat.p is None


def test_kabsch():
    p = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    r, t = geometry.kabsch(p, p + [3, -2, 0.5])
    assert np.allclose(p @ r.T + t, p + [3, -2, 0.5], atol=1e-5)
    with pytest.raises(ValueError):
        geometry.kabsch(p[:2], p[:2])


def test_core_fit_shows_what_moved(spark):
    i = np.arange(20)
    p = np.stack([i, (i * i) % 7, i % 5], axis=1).astype(float)
    q = p + [3, -2, 0.5]
    q[10] += [0, 2.5, 0]
    rows = [(1, int(k), *map(float, p[k]), *map(float, q[k]), bool(k < 6)) for k in i]
    df = spark.createDataFrame(rows, "sample_id long, idx long, x double, y double, z double, u double, v double, w double, core boolean")
    got = {r.idx: (r.dx, r.dy, r.dz) for r in geometry.aligned(df, "core").collect()}
    assert np.allclose([got[k] for k in range(6)], 0, atol=1e-5) and np.allclose(got[10], [0, 2.5, 0], atol=1e-5)


def test_rotated_template(spark):
    p = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    q = p @ np.array([[0, 1, 0], [-1, 0, 0], [0, 0, 1.0]])
    rows = [(1, k, *map(float, p[k]), *map(float, q[k]), 1.0, 0.0, 0.0, True) for k in range(4)]
    df = spark.createDataFrame(rows, "sample_id long, idx long, x double, y double, z double, u double, v double, w double, dx double, dy double, dz double, core boolean")
    got = geometry.transferred(df).first()
    assert np.allclose([got.px, got.py, got.pz], [0, 1, 0], atol=1e-5)


def test_alignment():
    assert geometry.align("ACDE", "ACDE") == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert geometry.align("ACDEFGHIKL", "ACDEGHIKL")[-1] == (9, 8)
    assert geometry.align("XXXACDE", "ACDE", local=True) == [(3, 0), (4, 1), (5, 2), (6, 3)]


def test_mobility_is_finite(spark):
    df = spark.createDataFrame([(1, k, float(k), float(k % 2), 0.0) for k in range(6)], "sample_id long, idx long, x double, y double, z double")
    got = geometry.mobility(df, 2.5).collect()
    assert len(got) == 6 and all(math.isfinite(r.gnm) and math.isfinite(r.anm) for r in got)


def test_neighbours(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 2, 3.0)], "sample_id long, idx long, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = [(r.src, r.dst) for r in spatial.nearest(df, 1).orderBy("src").collect()]
    assert got == [(0, 1), (1, 0), (2, 1)]
    assert sorted((r.src, r.dst) for r in spatial.contacts(df, 1.0).collect()) == [(0, 1), (1, 0)]
    assert spatial.nearest(df.limit(0), 3).count() == 0


def test_fallback(spark):
    rows = spark.createDataFrame([("s1", "plug", 1, 1, 1.0), ("s2", "plug", 2, 1, 3.0)], "sample_id string, region string, family int, state int, tx double").withColumns({"ty": F.lit(0.0), "tz": F.lit(0.0)})
    targets = spark.createDataFrame([("plug", 1, 1), ("plug", 1, 9), ("plug", 9, 1), ("plug", 9, 9), ("none", 1, 1)], "region string, family int, state int")
    got = {(r.region, r.family, r.state): (r.level, r.px) for r in baselines.with_fallback(targets, baselines.group_means(rows)).collect()}
    assert got == {("plug", 1, 1): ("family_state", 1.0), ("plug", 1, 9): ("family", 1.0), ("plug", 9, 1): ("state", 2.0), ("plug", 9, 9): ("global", 2.0), ("none", 1, 1): ("zero", 0.0)}


def test_ridge(spark):
    df = spark.createDataFrame([(float(x), float(x % 3), 2.0 * x + 1) for x in range(20)], "a double, b double, y double")
    w = baselines.ridge(df, ["a", "b"], ["y"], alpha=1e-9)
    assert w.loc["a", "y"] == pytest.approx(2.0) and w.loc["intercept", "y"] == pytest.approx(1.0)


def test_leaks(spark):
    df = spark.createDataFrame([("g", "train"), ("g", "test"), ("h", "val")], "g string, split string")
    assert [(r.g, r.splits) for r in splits.leaks(df, "g").collect()] == [("g", ["test", "train"])]


def test_seed_deviation_of_one(spark):
    df = spark.createDataFrame([("a", 1.0)], "m string, value double")
    assert reports.seed_aggregate(df, ["m"]).first().sd == 0.0
    assert reports.seed_aggregate(df, ["m"], None).first().sd is None


def test_tables_and_markdown(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,\n")
    (tmp_path / "b.tsv").write_text("x\tz\n2\t3\n")
    df = readers.table(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.tsv"], ["x"], "source_csv")
    assert sorted(r.x for r in df.collect()) == ["1", "2"] and set(df.columns) == {"x", "y", "z", "source_csv"}
    with pytest.raises(ValueError):
        readers.table(spark, f"{tmp_path}/a.csv", ["lacking"])
    assert sinks.markdown(df.select("x").orderBy("x")).splitlines()[2] == "| 1 |"
    sinks.write_csv(df, f"{tmp_path}/out", ["x", "none"])
    assert spark.read.csv(f"{tmp_path}/out", header=True).columns == ["x", "none"]


def test_hash_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.txt").write_text("abc")
    got = {r.path: (r.exists, r.bytes) for r in sinks.hashes(spark, f"{tmp_path}/in", spark.createDataFrame([("f.txt",), ("g.txt",)], "path string")).collect()}
    assert got == {"f.txt": (True, 3), "g.txt": (False, None)}


def test_structure_chain(spark):
    line = "ATOM  {0:5d}  CA  ALA A{0:4d}    {1:8.3f}{2:8.3f}{3:8.3f}  1.00  0.00"
    text = "\n".join(line.format(k, k * 1.0, 0.5, -1.25) for k in range(1, 17)) + "\nHETATM   17  CA  ALA A  17       0.000   0.000   0.000"
    rows = readers.numbered(spark.createDataFrame([("f", text)], "file string, t string"), "file", "t")
    got = readers.chains(readers.atoms(rows, "file"), "file").orderBy("idx").collect()
    assert len(got) == 16 and got[0].residue_id == "A_1" and got[15].x == 16.0 and got[0].z == -1.25


def test_hits_by_score(spark):
    rows = spark.createDataFrame([("f", 1, "# c"), ("f", 2, "q\tb\t0.5"), ("f", 3, "q\ta\t0.9"), ("f", 4, "q")], "file string, line_no int, value string")
    assert [r.target for r in readers.hits(rows, "file", 3, [2]).orderBy("rank").collect()] == ["a", "b"]


def test_incremental_merge(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string").coalesce(1).write.parquet(f"{tmp_path}/in/one")
    args = (spark, f"{tmp_path}/in/*", "id long, v string", ["id"], f"{tmp_path}/out", f"{tmp_path}/state")
    assert incremental.merge_new(*args).count() == 1
    spark.createDataFrame([(1, "c"), (2, "d")], "id long, v string").coalesce(1).write.parquet(f"{tmp_path}/in/two")
    assert sorted(r.id for r in incremental.merge_new(*args).collect()) == [1, 2]


def test_principal_components(spark):
    from fathom.operators import features

    x = np.random.default_rng(1).normal(size=(200, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>")
    mean, v = features.principal_components(df, "v", 4, 2)
    _, w = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.abs(v @ w[:, ::-1][:, :2]), np.eye(2), atol=1e-6)


def test_range_slices_and_keys(spark):
    from fathom.operators import features

    names = spark.createDataFrame([(f"s{i}",) for i in range(10)], "name string")
    cut = lambda df: {r.name: r.part for r in features.range_slices(df, "name", {"train": (0.0, 0.6), "val": (0.6, 1.0)}, 7).collect()}
    a = cut(names)
    assert a == cut(names.repartition(3)) and list(a.values()).count("train") == 6 and len(a) == 10
    key = names.select(features.cache_keys({"b": F.lit("1"), "a": F.lit("2")}).alias("k")).first().k
    assert key == features.cache_key({"a": 2, "b": 1})
    assert len(features.cache_key({"b": 1, "a": 2})) == 12 and features.cache_key({"b": 1, "a": 2}) == features.cache_key({"a": 2, "b": 1})
