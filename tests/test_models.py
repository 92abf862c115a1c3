"""Graph features, errors and states on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from fathom.operators import errors, features, graphs, metrics, reports


def rows_of(spark, rows):
    return spark.createDataFrame([(1, k, *map(float, r)) for k, r in enumerate(rows)], "sample_id long, idx long, tx double, ty double, tz double, px double, py double, pz double")


def test_selection_metric(spark):
    rows = rows_of(spark, [(1.5, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (0.5, 0, 0, 0, 0, 0)])
    r = errors.selection_metric(rows, ["sample_id"]).first()
    near, whole = 1.5**2 / 3, (1.5**2 + 3**2) / 6
    assert math.isclose(r.selection, 0.7 * near + 0.3 * whole)
    assert errors.selection_metric(rows.where("idx = 2"), ["sample_id"]).first().selection is None
    assert math.isclose(errors.selection_metric(rows, ["sample_id"], weights=(0.0, 0.0)).first().selection, 0)


def test_sums_merge_over_batches(spark):
    rows = rows_of(spark, [(1, 0, 0, 0, 0, 0), (0, 2, 0, 0, 1, 0), (0, 0, 0, 1, 1, 1)])
    whole = errors.merged(errors.sums(rows, ["sample_id"]), ["sample_id"]).first()
    parts = errors.sums(rows.where("idx = 0"), ["sample_id"]).unionByName(errors.sums(rows.where("idx > 0"), ["sample_id"]))
    assert errors.merged(parts, ["sample_id"]).first() == whole
    assert math.isclose(whole.mse, 5 / 9) and math.isclose(whole.mae, 5 / 9) and math.isclose(whole.gain, 1 - 5 / 5)
    assert {(r.idx, r.range) for r in errors.in_ranges(rows, [("a", 0, 2), ("b", 1, 5)]).collect()} == {(0, "a"), (0, "b"), (1, "b"), (2, "a")}


def test_confidence_bins(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 59.9, 60.0, 90.0, 100.0, 100.1)], "c double")
    assert [r.b for r in df.select(errors.confidence_bin(F.col("c")).alias("b")).collect()] == [None, "0to60", "0to60", "60to70", "90to100", "90to100", None]


def test_edges_with_errors(spark):
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 2, 2.0), (1, 2, 0, 3.0)], "sample_id long, src long, dst long, dist double")
    cells = spark.createDataFrame([(1, i, j, float(3 * i + j)) for i in range(3) for j in range(3)], "sample_id long, i long, j long, value double")
    got = {(r.src, r.dst): r for r in graphs.edges_with_error(edges, cells).withColumn("s", graphs.edge_scalars()).collect()}
    assert {k: r.pae for k, r in got.items()} == {(0, 1): 1.0, (1, 2): 5.0, (2, 0): 6.0}
    assert all(len(r.s) == 26 for r in got.values()) and got[2, 0].s[18:] == [0, 0, 1, 0, 0, 0, 0, 0] and math.isclose(got[2, 0].s[16], 0.2) and math.isclose(got[2, 0].s[17], math.exp(-6 / 8))
    assert {r.pae for r in graphs.edges_with_error(edges, None).collect()} == {0.0}
    assert graphs.edges_with_error(edges, cells.where("i > 0"), strict=False).where("src = 0").first().pae == 0.0
    with pytest.raises(Exception, match="no error for an edge"):
        graphs.edges_with_error(edges, cells.where("i > 0")).collect()
    at = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.0, 3.0, 0.0), (1, 2, 0.0, 3.0, 0.0)], "sample_id long, idx long, x double, y double, z double")
    assert {(r.src, r.dst): (r.ux, r.uy, r.uz) for r in graphs.edge_vectors(edges, at).collect()} == {(0, 1): (0, 1, 0), (1, 2): (0, 0, 0), (2, 0): (0, -1, 0)}


def test_conditions_of_graphs(spark):
    nodes = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)], "sample_id long, idx long")
    graph = spark.createDataFrame([(1, [2, 5]), (2, []), (3, [99])], "sample_id long, family array<int>")
    assert [r.family for r in graphs.condition_ids(nodes, graph, ["family"], {"family": 4}).orderBy("sample_id", "idx").collect()] == [2, 2, 0, 3, 0]


def test_sequence_features_and_lengths(spark):
    df = spark.createDataFrame([("a", 0, 3), ("?", 1, 3), ("Y", 2, 3), ("", 0, 1)], "c string, i long, n long")
    got = [r.f for r in df.select(features.sequence_features("c", "i", "n", "ACDEFGHIKLMNPQRSTVWYX", 30).alias("f")).collect()]
    assert [x[:21].index(1) for x in got] == [0, 20, 19, 20] and [x[21:28].index(1) for x in got] == [0, 1, 2, 0]
    assert all(math.isclose(x[28], math.sin(2 * math.pi * i / 2), abs_tol=1e-12) for x, i in zip(got, range(3)))
    n = spark.createDataFrame([(3, 3, 3), (3, 2, None)], "n int, a int, b int")
    assert [r.m for r in n.select(features.length_mismatch(n, "n", ["a", "b"]).alias("m")).collect()] == [None, "a,b"]


def test_states(spark):
    rows = [(s, g, *p) for s in (1, 2) for g, *p in (("barrel_core", 0, 0, 0, 0, 0, 0, 0, 0, 0), ("tonb_box", 1, 0, 0, 3, 0, 0, 0, 0, 0), ("plug", 0, 2, 0, 0, 0, 0, 0, 0, 0))] + [(3, "plug", *[0] * 9)]
    df = spark.createDataFrame([(s, g, *map(float, p)) for s, g, *p in rows], "sample_id long, region string, x double, y double, z double, tx double, ty double, tz double, px double, py double, pz double")
    got = metrics.state_metrics(df, 0.5).orderBy("sample_id").collect()
    assert [r.sample_id for r in got] == [1, 2]
    r = got[0]
    assert (r.n_residues, r.target_displacement, r.predicted_displacement, r.target_exposure, r.predicted_exposure) == (1, 3, 0, 3, 0)
    assert (r.target_state, r.predicted_state, r.state_correct, r.displacement_cosine, r.direction_compatible) == ("exposed_like", "unchanged", False, None, False)
    assert math.isclose(r.target_plug_change, math.sqrt(20) - math.sqrt(5)) and math.isclose(r.target_axis_cosine, 1)
    s = metrics.state_summary(metrics.state_metrics(df, 0.5), []).first()
    assert (s.n_targets, s.confusion, s.state_accuracy, s.displacement_cosine_mean) == (2, {"exposed_like->unchanged": 2}, 0, None)
    odd = spark.createDataFrame([(0.5,), (-0.5,), (0.4,), (float("nan"),), (float("inf"),), (None,)], "d double")
    assert [r.s for r in odd.select(metrics.exposure_state(F.col("d"), 0.5).alias("s")).collect()] == ["exposed_like", "buried_like", "unchanged", "missing", "missing", "missing"]


def test_caps_and_latest(spark):
    rows = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(12)], "k int, tier string")
    assert sorted(r.k for r in reports.first_in_tiers(rows, "tier", {"a": 2, "b": 1}, ["k"]).collect()) == [0, 1, 3]
    assert sorted(r.k for r in reports.first_in_tiers(rows, "tier", {"a": 2, "b": 1}, ["k"], 2).collect()) == [0, 1]
    runs = spark.createDataFrame([("m", "r1", 9, "z", "p1"), ("m", "r2", 1, "a", "p2"), ("m", "r2", 1, "b", "p3")], "model string, folder string, modified int, name string, path string")
    assert reports.latest_run(runs, ["model"]).first().path == "p3"


def test_one_hots_and_scales(spark):
    from fathom.operators import baselines

    fit = spark.createDataFrame([("a",), ("b",), (None,)], "f string")
    rows, names = baselines.one_hot(spark.createDataFrame([("a",), ("c",), (None,)], "f string"), fit, "f")
    assert names == ["f=a", "f=b"] and [tuple(r)[1:] for r in rows.collect()] == [(1, 0), (0, 0), (0, 0)]
    with pytest.raises(ValueError):
        baselines.one_hot(fit, fit, "f", most=1)
    val = spark.createDataFrame([("plug", 2.0, 0.0, 0.0, 1.0, 0.0, 0.0)] * 3 + [("box", 1.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "region string, tx double, ty double, tz double, px double, py double, pz double")
    assert baselines.calibrated_scales(val, ["plug", "box", "loop"], {"loop": 0.5}) == {"plug": 2.0, "box": 1.0, "loop": 0.5}


def test_checked_graphs_and_scores(spark):
    from fathom.operators import records

    g = spark.createDataFrame([(1, 3, 3), (2, 3, 2)], "sample_id int, n int, n_pos int")
    assert features.checked_graphs(g.where("sample_id = 1"), ["n"], "n", ["n_pos"]).count() == 1
    with pytest.raises(Exception, match="lengths differ: n_pos"):
        features.checked_graphs(g, ["n"], "n", ["n_pos"]).collect()
    with pytest.raises(KeyError, match="plddt"):
        features.checked_graphs(g, ["plddt"], "n", ["n_pos"])
    wanted = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "sample_id long, idx long")
    scores = spark.createDataFrame([(1, [0.5, 0.25])], "sample_id long, scores array<double>")
    assert {(r.sample_id, r.idx): r.score for r in records.placed_scores(wanted, scores).collect()} == {(1, 0): 0.5, (1, 1): 0.25, (2, 0): None}
    with pytest.raises(Exception, match="number of scores of 2"):
        records.placed_scores(wanted, spark.createDataFrame([(2, [0.5, 0.25])], "sample_id long, scores array<double>")).collect()


def test_areas_of_methods(spark):
    from fathom.operators import curves

    df = spark.createDataFrame([("p", 1, 0.9, 0.1), ("p", 0, 0.8, 0.2), ("p", 1, 0.7, None), ("q", 0, 0.1, 0.5), ("q", 1, 0.6, 0.5)], "region string, y int, a double, b double")
    got = {(r.method, r.region): r for r in curves.method_areas(df, {"a": "a", "b": "b"}, ["region"]).collect()}
    assert set(got) == {(m, g) for m in "ab" for g in ("p", "q", "all")}
    assert math.isclose(got["a", "p"].auroc, 0.5) and math.isclose(got["a", "q"].auroc, 1) and math.isclose(got["a", "all"].auroc, 4 / 6)
    assert (got["b", "p"].positives, got["b", "p"].auroc, got["b", "q"].auroc, got["a", "all"].positive_rate) == (1, 0, 0.5, 0.6)
    assert math.isclose(got["a", "p"].average_precision, (1 + 2 / 3) / 2)
