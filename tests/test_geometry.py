"""Fits, alignments and displacement targets on small cases and by force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import geometry, spatial

SEQUENCE = "ACDEFGHIKLMNPQRSTVWY"


def chain(sample, pos, name, sequence, xyz):
    return (sample, pos, name, sequence, [f"{name}_{k + 1}" for k in range(len(sequence))], np.asarray(xyz, dtype=float).tolist())


def chains(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, pos int, chain string, sequence string, ids array<string>, xyz array<array<double>>")


COORDS = np.array([[i, (i * i) % 7, i % 5] for i in range(20)], dtype=float)


def test_core_fit_and_displaced_residue(spark):
    moved = COORDS + [3, -2, 0.5]
    moved[10] += [0, 2.5, 0]
    core = spark.createDataFrame([(1, [f"A_{k}" for k in range(1, 7)])], "sample_id long, ids array<string>")
    out = geometry.displacement_target(chains(spark, [chain(1, 0, "A", SEQUENCE, COORDS)]), chains(spark, [chain(1, 0, "A", SEQUENCE, moved)]), core).orderBy("idx").collect()
    d = np.array([[r.dx, r.dy, r.dz] for r in out])
    assert len(out) == 20 and np.allclose(d[:6], 0, atol=1e-5) and np.allclose(d[10], [0, 2.5, 0], atol=1e-5)


def test_best_chain_and_reasons(spark):
    a = [chain(k, 0, "A", SEQUENCE, COORDS) for k in range(1, 7)]
    worse = "".join("Y" if k in (3, 9, 15) else c for k, c in enumerate(SEQUENCE))
    b = [
        chain(1, 0, "X", "Y" * 20, COORDS + 100), chain(1, 1, "B", SEQUENCE, COORDS + 1), chain(1, 2, "C", SEQUENCE, COORDS),
        chain(2, 0, "B", SEQUENCE[:7], COORDS[:7]), chain(3, 0, "B", SEQUENCE[:14], COORDS[:14]), chain(4, 0, "B", worse, COORDS), chain(5, 0, "B", SEQUENCE, COORDS),
    ]
    core = spark.createDataFrame([(5, ["A_1", "A_2", "Z"])], "sample_id long, ids array<string>")
    out = geometry.displacement_target(chains(spark, a), chains(spark, b), core).select("sample_id", "status", "chain_b", "n", "identity").distinct().collect()
    got = {r.sample_id: (r.status, r.chain_b, r.n, r.identity) for r in out}
    assert got[1] == ("ok", "B", 20, 1.0)
    assert {k: got[k][0] for k in range(2, 7)} == {2: "no_alignable_chains", 3: "alignment_too_short", 4: "low_identity", 5: "core_too_small", 6: "no_alignable_chains"}


def test_trimmed_fit_leaves_the_moved_part_out(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(0, 10, (40, 3))
    turn, _ = np.linalg.qr(rng.normal(0, 1, (3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    q = p @ turn.T + [1, 2, 3]
    q[30:] += [0, 0, 4]
    r, t = geometry.trimmed_kabsch(p, q)
    d = np.linalg.norm(q - (p @ r.T + t), axis=1)
    assert d[:30].max() < 1e-6 and abs(d[30:] - 4).max() < 1e-6
    with pytest.raises(ValueError):
        geometry.trimmed_kabsch(p, q, share=0)


def test_fits_of_many_samples(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for s in range(30):
        n = int(rng.integers(1, 12))
        p, q, core = rng.normal(0, 1, (n, 3)), rng.normal(0, 1, (n, 3)), rng.random(n) < 0.5
        use = core if core.sum() >= 3 else np.ones(n, dtype=bool)
        d = np.zeros((n, 3))
        if use.sum() >= 3:
            r, t = geometry.kabsch(p[use], q[use])
            d = q - (p @ r.T + t)
        for k in range(n):
            rows.append((s, k, *p[k].tolist(), *q[k].tolist(), bool(core[k])))
            want[s, k] = d[k]
    df = spark.createDataFrame(rows, "sample_id long, idx long, x double, y double, z double, u double, v double, w double, core boolean")
    got = geometry.aligned(df, "core").collect()
    assert len(got) == len(rows) and all(np.allclose([r.dx, r.dy, r.dz], want[r.sample_id, r.idx], atol=1e-9) for r in got)


def test_transfer_turns_with_the_target(spark):
    x = [[0, 0, 0], [1, 0, 0], [0, 2, 0], [0, 0, 3]]
    rows = [(1, k, *map(float, p), float(-p[1]), float(p[0]), float(p[2]), 1.0, 0.0, 0.0, True) for k, p in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id long, idx long, x double, y double, z double, u double, v double, w double, dx double, dy double, dz double, core boolean")
    one = geometry.transferred(df)
    assert all(np.allclose([r.px, r.py, r.pz], [0, 1, 0], atol=1e-9) for r in one.collect())
    mean = geometry.averaged_transfers(one.unionByName(one.withColumns({c: F.lit(0.0) for c in ("px", "py", "pz")}))).collect()
    assert len(mean) == 4 and all(np.allclose([r.px, r.py, r.pz], [0, 1, 0], atol=1e-9) for r in mean)


def score_of(a, b, pairs, match, mismatch, gap_open, gap_more, local):
    """Score of an alignment by its pairs."""
    gap = lambda n: gap_open + gap_more * (n - 1) if n else 0
    total, last = sum(match if a[i] == b[j] else mismatch for i, j in pairs), (-1, -1)
    for i, j in [*pairs, (len(a), len(b))]:
        if not local or (last != (-1, -1) and (i, j) != (len(a), len(b))):
            total += gap(i - last[0] - 1) + gap(j - last[1] - 1)
        last = (i, j)
    return total


@pytest.mark.parametrize("local", [False, True])
def test_alignment_is_the_best(local):
    """Against a recursion over all alignments."""
    from functools import cache

    scores = {"match": 2, "mismatch": -3, "gap_open": -4, "gap_more": -0.5}
    rng = np.random.default_rng(7)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("abc"), int(n))) for n in rng.integers(1, 9, 2))

        @cache
        def best(i, j, layer):
            """The best score of what is left from i, j on, after a step in layer."""
            if i == len(a) and j == len(b):
                return 0.0
            steps = [0.0] if local else []
            if i < len(a) and j < len(b):
                steps.append((2 if a[i] == b[j] else -3) + best(i + 1, j + 1, 0))
            if i < len(a):
                steps.append((-0.5 if layer == 1 else -4) + best(i + 1, j, 1))
            if j < len(b):
                steps.append((-0.5 if layer == 2 else -4) + best(i, j + 1, 2))
            return max(steps)

        want = max(best(i, j, 0) for i in range(len(a) + 1) for j in range(len(b) + 1)) if local else best(0, 0, 0)
        pairs = geometry.align(a, b, local=local, **scores)
        assert score_of(a, b, pairs, **scores, local=local) == want == geometry.Tables(a, b, 2, -3, -4, -0.5, local).score()


def test_selected_chain(spark):
    rows = chains(spark, [chain(1, 0, "A", "AC", COORDS[:2]), chain(1, 1, "B", "ACD", COORDS[:3]), chain(1, 2, "C", "ACD", COORDS[:3])])
    assert geometry.select_chain(rows).first().chain == "B"
    assert geometry.select_chain(rows.withColumn("wish", F.lit("A")), "wish").first().chain == "A"
    with pytest.raises(Exception, match="no chain Z"):
        geometry.select_chain(rows.withColumn("wish", F.lit("Z")), "wish").collect()


def test_half_sphere_at_the_ends(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 1.0, 1.0, 0.0), (2, 0, 5.0, 0.0, 0.0), (3, 0, 0.0, 0.0, 0.0), (3, 1, 0.0, 0.0, 0.0)], "sample_id long, idx long, x double, y double, z double")
    got = {(r.sample_id, r.idx): (r.up, r.down) for r in spatial.half_sphere(df, 3.0).collect()}
    assert got == {(1, 0): (2, 0), (1, 1): (1, 1), (1, 2): (0, 2), (2, 0): (0, 0), (3, 0): (1, 0), (3, 1): (1, 0)}


def test_axes_and_back(spark):
    rng = np.random.default_rng(3)
    rows = [(s, k, *map(float, p)) for s in range(4) for k, p in enumerate(rng.normal(0, 1, (9, 3)) * [5, 2, 1] + 7)]
    df = spark.createDataFrame(rows, "sample_id long, idx long, x double, y double, z double")
    frame = geometry.axes(df)
    inside = geometry.in_axes(df, frame, ("x", "y", "z"))
    m = inside.groupBy("sample_id").agg(F.avg("x").alias("a"), F.var_pop("x").alias("v0"), F.var_pop("y").alias("v1"), F.var_pop("z").alias("v2"), F.covar_pop("x", "y").alias("c")).collect()
    assert len(m) == 4 and all(abs(r.a) < 1e-9 and r.v0 >= r.v1 >= r.v2 and abs(r.c) < 1e-9 for r in m)
    back = {(r.sample_id, r.idx): (r.x, r.y, r.z) for r in geometry.from_axes(inside, frame, ("x", "y", "z")).collect()}
    assert all(np.allclose(back[s, k], p) for s, k, *p in rows)
    turned = geometry.from_axes(geometry.in_axes(df, frame, ("x", "y", "z"), True), frame, ("x", "y", "z"), True)
    assert all(np.allclose((r.x, r.y, r.z), dict(((s, k), p) for s, k, *p in rows)[r.sample_id, r.idx]) for r in turned.collect())


def test_scores_by_alignment(spark):
    rows = spark.createDataFrame([(1, "ACDEFGH", "CDEGH", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 9.0]), (2, None, "AC", None), (3, "AAAA", "", [1.0])], "key int, whole string, part string, scores array<double>")
    got = {(r.key, r.idx): r.score for r in geometry.aligned_scores(rows).collect()}
    assert got[1, 0] == 2.0 and got[1, 1] == 3.0 and got[1, 4] == 9.0 and got[2, 0] == 0.0 and not any(k == 3 for k, _ in got)


def test_equal_chains_are_aligned_once():
    known = geometry.local_alignments(2)
    score, at = known("ACDEFGHIKL", "ACDEYGHIKL")
    assert known("ACDEFGHIKL", "ACDEYGHIKL")[1] is at and known.cache_info().misses == 1
    assert score == 9 * 2 - 4 and at.tolist() == [[k, k] for k in range(10)]


def test_small_samples_meet_as_cells_do(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, *map(float, rng.normal(size=3))) for s in range(4) for i in range((1, 5, 30, 90)[s])] + [(4, 0, 0.0, 0.0, 0.0), (4, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "sample_id int, idx int, x double, y double, z double")
    got = lambda d: sorted(map(tuple, d.collect()))
    assert got(spatial.contacts(df, 0.9)) == got(spatial.contacts(df, 0.9, few=0)) == got(spatial.contacts(df, 0.9, few=90))
    both = spatial.half_sphere(df, 0.9)
    assert got(both) == got(spatial.half_sphere(df, 0.9, few=0)) and both.count() == len(rows) and (4, 0, 1, 0) in got(both)
