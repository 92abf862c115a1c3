"""Ranks, quantiles and resampling against numpy, and the queries that SQL can't express against plain arrays."""

import math
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import registry
from fathom.operators import ranges, stats

from oracle import SF


def column(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchnumpy()


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(0)
    own = {None: rng.normal(0, 1, 700), "a": np.round(rng.normal(0, 1, 500), 1), "b": np.zeros(40), "c": np.array([2.5])}
    rows = [(g, float(v), k) for g, x in own.items() for k, v in enumerate(x)] + [("a", None, -1)]
    return own, spark.createDataFrame(rows, "g string, v double, k int")


def test_quantiles(groups):
    own, df = groups
    got = {r.g: r for r in ranges.quantiles(df, ["g"], "v", {"p10": 0.1, "mid": 0.5, "p99": 0.99}).collect()}
    for g, x in own.items():
        assert np.allclose([got[g].p10, got[g].mid, got[g].p99], np.quantile(x, [0.1, 0.5, 0.99]))
    whole = ranges.quantiles(df, [], "v", {"mid": 0.5}).collect()
    assert len(whole) == 1 and math.isclose(whole[0].mid, np.median(np.concatenate(list(own.values()))))


def test_average_ranks(groups):
    import pandas as pd

    own, df = groups
    got = stats.average_rank(df.where("v is not null"), "v", ["g"], "rank").collect()
    assert len(got) == sum(map(len, own.values()))
    for g, x in own.items():
        assert np.array_equal([r.rank for r in sorted((r for r in got if r.g == g), key=lambda r: r.k)], pd.Series(x).rank())


def test_running_sums(groups):
    own, df = groups
    counts = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    for r in ranges.running_sums(counts, ["g"], "v", ["n"]).collect():
        assert (r.before_n, r.all_n) == ((own[r.g] < r.v).sum(), len(own[r.g]))


@pytest.mark.parametrize("most", [3, 40, 10**6])
def test_ranges_are_cut_until_small(groups, most):
    own, df = groups
    counts = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    for r in ranges.running_sums(counts, ["g"], "v", ["n", "k"], most).collect():
        x = own[r.g]
        assert (r.before_n, r.all_n) == ((x < r.v).sum(), len(x)) and (r.before_k, r.all_k) == (np.flatnonzero(x < r.v).sum(), np.arange(len(x)).sum())
    got = {r.g: r for r in ranges.quantiles_of(df.withColumn("w", -F.col("v")), ["g"], {"v": {"a": 0.1, "m": 0.5}, "w": {"b": 0.9}}, most).collect()}
    for g, x in own.items():
        assert np.allclose([got[g].a, got[g].m, got[g].b], [*np.quantile(x, [0.1, 0.5]), np.quantile(-x, 0.9)])


def test_no_range_holds_more_than_the_bound(spark):
    rng = np.random.default_rng(1)
    rows = [(1, float(v)) for v in rng.pareto(0.3, 4000)] + [(2, float(v)) for v in range(5)]
    cut = df = spark.createDataFrame(rows, "g int, v double").distinct().withColumn("_lo", F.lit(None).cast("double"))
    while cut is not None:
        df, cut = cut, ranges._cut(cut, ["g", "_lo"], "v", 30)
    sizes = df.groupBy("g", "_lo").agg(F.count("*").alias("n"), F.min("v").alias("low")).collect()
    assert max(r.n for r in sizes) <= 30 and sum(r.n for r in sizes) == df.count() and all(r._lo is None or r._lo < r.low for r in sizes)


def wilcoxon_by_force(d):
    """p-values over all signs of the ranks."""
    d = d[np.abs(d) > 1e-12]
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = ranks[d > 0].sum()
    every = np.array([sum(r for r, s in zip(ranks, signs) if s) for signs in product((0, 1), repeat=len(d))])
    below, above = (every <= w).mean(), (every >= w).mean()
    return below, min(1, 2 * min(below, above))


def test_wilcoxon(spark):
    assert stats.wilcoxon_p(0, 0.0, 0.0)[0] == "no_nonzero_deltas"
    d = np.array([-1.0, -2.0, -3.0, 0.5, -0.25, 4.0, 0.0])
    df = spark.createDataFrame([("x", k, float(v)) for k, v in enumerate(d)] + [("y", k, 0.0) for k in range(3)], "g string, k int, delta double")
    got = {r.g: r for r in stats.paired_tests(df, "g", "k", 300).collect()}
    assert np.allclose([got["x"].p_less, got["x"].p_two], wilcoxon_by_force(d)) and got["x"].status == "ok" and got["x"].n == 7
    assert got["y"].status == "no_nonzero_deltas" and got["y"].p_less is None and got["y"].mean_low == got["y"].median_high == 0


def test_intervals_are_those_of_resampling(spark):
    rng = np.random.default_rng(5)
    x, y = rng.exponential(1, 400), np.round(rng.normal(3, 2, 201), 1)
    df = spark.createDataFrame([(g, k, float(v)) for g, d in (("x", x), ("y", y)) for k, v in enumerate(d)], "g string, k int, delta double")
    got = {r.g: r for r in stats.paired_tests(df, "g", "k").collect()}
    again = {r.g: r for r in stats.paired_tests(df.repartition(3), "g", "k").collect()}
    for g, d in (("x", x), ("y", y)):
        draws = d[rng.integers(0, len(d), (4000, len(d)))]
        for name, stat in (("mean", draws.mean(axis=1)), ("median", np.median(draws, axis=1))):
            lo, hi = np.percentile(stat, [2.5, 97.5])
            assert abs(got[g][f"{name}_low"] - lo) < 0.15 * (hi - lo) and abs(got[g][f"{name}_high"] - hi) < 0.15 * (hi - lo)
        assert np.allclose([got[g][c] for c in ("mean_low", "median_high", "p_two")], [again[g][c] for c in ("mean_low", "median_high", "p_two")])


def test_rate_interval(spark):
    df = spark.createDataFrame([("x", k < 5) for k in range(10)] + [("y", True)] * 4 + [("x", None)], "g string, hit boolean")
    got = {r.g: r for r in stats.indicator_interval(df, ["g"], "hit").collect()}
    rng = np.random.default_rng(1)
    lo, hi = np.percentile((rng.random((20000, 10)) < 0.5).mean(axis=1), [2.5, 97.5])
    assert (got["x"].n, got["x"].rate, got["y"].low, got["y"].high) == (10, 0.5, 1, 1) and (got["x"].low, got["x"].high) == pytest.approx((lo, hi), abs=0.11)


def points():
    t = column("embeddings", "vec_id, embedding")
    x = np.stack(list(t["embedding"])).astype(float)
    return {int(i): v[:63].reshape(21, 3) for i, v in zip(t["vec_id"], x)}


def test_principal_frames(spark):
    got = {r.sample_id: r for r in registry.queries()["principal_frames"](spark, SF).collect()}
    at = points()
    assert set(got) == set(at)
    for k, x in at.items():
        _, v = np.linalg.eigh(np.cov(x.T, bias=True))
        axis = v[:, -1] * np.sign(v[:, -1][np.abs(v[:, -1]).argmax()])
        assert np.allclose([got[k].ax, got[k].ay, got[k].az], axis, atol=1e-5) and np.allclose([got[k].cx, got[k].cy, got[k].cz], x.mean(axis=0), atol=1e-5)


def test_network_mobility(spark):
    rows = registry.queries()["network_mobility"](spark, SF).where("sample_id < 6").collect()
    at = points()
    for k in range(6):
        x = at[k]
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        near = (d <= 0.5) & (d > 1e-6)
        g = np.diag(near.sum(axis=1)).astype(float) - near
        w, v = np.linalg.eigh(g)
        use = [i for i in range(len(w)) if w[i] > 1e-8][:20]
        want = sum(v[:, i] ** 2 / w[i] for i in use)
        h = np.zeros((63, 63))
        for i, j in zip(*np.nonzero(near)):
            e = (x[i] - x[j])[:, None] * (x[i] - x[j])[None] / d[i, j] ** 2
            h[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] -= e
            h[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] += e
        w, v = np.linalg.eigh(h)
        use = [i for i in range(len(w)) if w[i] > 1e-8][:20]
        both = sum(v[:, i] ** 2 / w[i] for i in use).reshape(21, 3).sum(axis=1)
        got = sorted((r.idx, r.gnm, r.anm) for r in rows if r.sample_id == k)
        assert np.allclose([r[1] for r in got], want, atol=1e-3) and np.allclose([r[2] for r in got], both, rtol=2e-3, atol=1e-3)


def test_aligned_displacements(spark):
    from fathom.operators.geometry import kabsch

    at = points()
    got = {(r.sample_id, r.idx): (r.dx, r.dy, r.dz) for r in registry.queries()["aligned_displacements"](spark, SF).collect()}
    for k in [i for i in at if i - 10 in at][:40]:
        p, q = at[k - 10], at[k]
        r, t = kabsch(p[:8], q[:8])
        assert np.allclose([got[k, i] for i in range(21)], q - (p @ r.T + t), atol=1e-5)


def test_principal_components(spark):
    t = column("embeddings", "vec_id, embedding")
    x = np.stack(list(t["embedding"])).astype(float)
    x -= x.mean(axis=0)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    got = {r.vec_id: (r.pc0, r.pc1, r.pc2) for r in registry.queries()["principal_components"](spark, SF).collect()}
    have, want = np.array([got[i] for i in t["vec_id"]]), x @ v[:3].T
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-3)


def test_ridge_fit(spark):
    t = column("lineitem", "l_quantity, l_discount, l_tax, l_extendedprice, l_returnflag")
    x = np.stack([np.asarray(t[c], dtype=float) for c in ("l_quantity", "l_discount", "l_tax")], axis=1)
    y = np.asarray(t["l_extendedprice"], dtype=float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    e = z @ w + y.mean() - y
    for r in registry.queries()["ridge_fit"](spark, SF).collect():
        own = e[t["l_returnflag"] == r.l_returnflag]
        assert r.n == len(own) and math.isclose(r.rmse, math.sqrt((own**2).mean()), abs_tol=0.02)


def test_benchmark_alignments(spark):
    from fathom.operators.geometry import Tables

    t = column("benchmark", "item_id, text")
    text = dict(zip(t["item_id"].tolist(), t["text"]))
    got = {}
    for r in registry.queries()["benchmark_alignments"](spark, SF).collect():
        got.setdefault(r.key, []).append((r.a_idx, r.b_idx))
    assert set(got) == {k for k in text if k + 1 in text}
    for k, pairs in list(got.items())[:8]:
        a, b, pairs = text[k], text[k + 1], sorted(pairs)
        gap = lambda n: -8 - 0.5 * (n - 1) if n else 0
        total, last = 0.0, (-1, -1)
        for i, j in pairs:
            total += (2 if a[i] == b[j] else -3) + gap(i - last[0] - 1) + gap(j - last[1] - 1)
            last = i, j
        total += gap(len(a) - last[0] - 1) + gap(len(b) - last[1] - 1)
        assert total == Tables(a, b, 2, -3, -8, -0.5, False).score()
