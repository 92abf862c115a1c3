"""Nearest points over a tree of cells, against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import celltree, spatial


def frame(spark, sample, xyz, first=0):
    return spark.createDataFrame([(sample, first + i, *map(float, p)) for i, p in enumerate(xyz)], "sample_id long, idx long, x double, y double, z double")


def by_force(queries, points, k):
    """{q: [(dist, idx)]} of arrays."""
    out = {}
    for q, at in enumerate(queries):
        d = np.sqrt(((points - at) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(len(points)), d))[:k]
        out[q] = [(float(d[i]), int(i)) for i in order]
    return out


def clouds(rng):
    tight = rng.normal(size=(150, 3)) * 1e-4 + [5, 5, 5]
    far = rng.normal(size=(20, 3)) * 50
    return {
        "even": rng.random((300, 3)), "clusters": np.concatenate([tight, far, rng.random((100, 3))]), "line": np.c_[np.arange(200.0), np.zeros(200), np.zeros(200)],
        "copies": np.repeat(rng.random((4, 3)), 60, axis=0), "grid": np.stack(np.meshgrid(*[np.arange(6.0)] * 3), -1).reshape(-1, 3), "one": np.ones((1, 3)), "same": np.ones((90, 3)),
    }


@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("name", ["even", "clusters", "line", "copies", "grid", "one", "same"])
def test_nearest_by_force(spark, name, k):
    rng = np.random.default_rng(7)
    xyz = clouds(rng)[name]
    other = np.concatenate([xyz[:20], rng.normal(size=(15, 3)) * 30])
    points = frame(spark, 1, xyz).unionByName(frame(spark, 2, xyz[:3] + 9))
    queries = frame(spark, 1, other).withColumnRenamed("idx", "q")
    got = {}
    for r in celltree.nearest_of(queries, points, k).collect():
        assert r.sample_id == 1
        got.setdefault(r.q, []).append((r.dist, r.dst))
    want = by_force(other, xyz, k)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(math.isclose(a[0], b[0], rel_tol=1e-12, abs_tol=1e-12) for q in want for a, b in zip(sorted(got[q]), want[q]))


def test_nearest_leaves_out_the_point_itself(spark):
    xyz = np.repeat(np.random.default_rng(2).random((30, 3)), 3, axis=0)
    rows = spatial.nearest(frame(spark, 1, xyz), 4).orderBy("src", "rank").collect()
    want = by_force(xyz, xyz, len(xyz))
    assert [(r.src, r.dst) for r in rows] == [(q, i) for q in range(len(xyz)) for i in [i for _, i in want[q] if i != q][:4]]


def test_missing_coordinates_and_empty_tables(spark):
    points = frame(spark, 1, [(0, 0, 0), (1, 0, 0), (float("nan"), 0, 0)]).withColumn("x", F.when(F.col("idx") < 3, F.col("x")))
    assert sorted((r.src, r.dst) for r in spatial.nearest(points, 2).collect()) == [(0, 1), (1, 0)]
    assert spatial.nearest(points.limit(0), 2).collect() == [] and spatial.depth(points, points.limit(0)).collect() == []


def test_one_large_sample_makes_no_square_of_pairs(spark):
    """100,000 points of one sample, a tenth in one tight cluster: exact where checked, and pairs in proportion to points."""
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.random((90_000, 3)), rng.normal(size=(10_000, 3)) * 1e-5 + 0.5])
    points = spark.createDataFrame(__import__("pandas").DataFrame(xyz, columns=list("xyz")).assign(sample_id=1, idx=np.arange(len(xyz))))
    surface = points.where("idx % 10 = 0")
    got = spatial.nearest(points, 3).where("src % 5000 = 7").collect()
    for q in {r.src for r in got}:
        d = ((xyz - xyz[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert sorted(r.dst for r in got if r.src == q) == sorted(np.argsort(d, kind="stable")[:3].tolist())
    assert len(got) == 60
    deep = {r.idx: r.depth for r in spatial.depth(points, surface).where("idx % 5000 = 7").collect()}
    s = xyz[::10]
    assert all(math.isclose(v, float(np.sqrt(((s - xyz[q]) ** 2).sum(axis=1)).min()), rel_tol=1e-9, abs_tol=1e-12) for q, v in deep.items()) and len(deep) == 20


def test_the_plan_joins_by_cells(spark):
    df = spatial.nearest(frame(spark, 1, np.random.default_rng(1).random((50, 3))), 2)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("cell" in line for line in joins)
