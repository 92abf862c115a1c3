"""Nested reports, tiers, ligands, renumbering, incremental builds and whole reports, against plain versions."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import coordinate_tables, ligands, publication, renumber, stats, tiers
from fathom.plans import assembly_queries
from fathom.streaming import builds


# -- nested reports

def test_coordinate_tables_of_odd_reports(spark):
    whole = {
        "aggregate_by_region": {"plug": {"n_residues": 7, "prediction_error_rms": 0.5}, "tonb_box": {"sample_count": 2}, "elsewhere": {"n_residues": 1}},
        "samples": [
            {"sample_id": "a", "regions": {"plug": {"zero_error_rms": 2.0, "prediction_error_rms": 1.5, "mse_improvement_vs_zero_fraction": 0.4}, "elsewhere": {"zero_error_rms": 1, "prediction_error_rms": 1}}},
            {"sample_id": "b", "regions": {"plug": {"zero_error_rms": "1.0", "prediction_error_rms": 3}, "loop": {"zero_error_rms": 1, "prediction_error_rms": 1}}},
            {"sample_id": "c", "regions": {"plug": {"zero_error_rms": None, "prediction_error_rms": 1}}}, {"regions": None}, {"sample_id": "d"},
        ],
    }
    bare = '{"aggregate_by_region": {"plug": {"n_residues": 3, "zero_error_rms": NaN}}, "samples": [{"sample_id": "x", "regions": {"plug": {"zero_error_rms": NaN, "prediction_error_rms": 1.0}}}]}'
    rows = [("m", "M", "neural", "m.json", json.dumps(whole)), ("n", "N", "ablation", "n.json", bare), ("o", "O", "x", "o.json", "{"), ("p", "P", "x", "p.json", None), ("q", "Q", "x", "q.json", "{}")]
    reports = spark.createDataFrame(rows, "method string, label string, category string, source string, body string")
    aggregate, samples = coordinate_tables.coordinate_tables(reports, ("plug", "tonb_box", "loop"), iterations=300)
    got = {(r.method, r.region): r for r in aggregate.collect()}
    assert set(got) == {("m", "plug"), ("m", "tonb_box"), ("n", "plug")}
    assert got["m", "plug"].n_residues == 7 and got["m", "plug"].prediction_error_rms == 0.5 and got["m", "tonb_box"].sample_count == 2 and got["n", "plug"].zero_error_rms is None
    assert sorted((r.method, r.sample_id, r.region, r.sample_improvement) for r in samples.collect()) == [("m", "a", "plug", 0.5), ("m", "b", "plug", -2.0)]
    plug = got["m", "plug"]
    assert plug.sample_improvement_mean_ci95_low <= -0.75 <= plug.sample_improvement_mean_ci95_high and plug.sample_improvement_rate_ci95_low == 0 and plug.sample_improvement_rate_ci95_high == 1
    assert got["n", "plug"].sample_improvement_mean_ci95_low is None and got["m", "tonb_box"].sample_improvement_rate_ci95_high is None
    assert coordinate_tables.coordinate_tables(reports.limit(0), ("plug",))[0].collect() == []


def test_bootstrap_intervals_against_arrays(spark):
    rng = np.random.default_rng(3)
    data = {g: np.round(rng.normal(loc=g, size=n), 1) for g, n in ((0, 40), (1, 300))}
    rows = [(g, f"k{g}" if g else None, float(x), float(x > 0)) for g, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "g int, k string, v double, up double").repartition(5)
    got = {r.g: r for r in stats.bootstrap_intervals(df, ["g", "k"], {"mean": ("v", 42), "rate": ("up", 59)}, 2000).collect()}
    again = {r.g: r for r in stats.bootstrap_intervals(df.repartition(2), ["g", "k"], {"mean": ("v", 42), "rate": ("up", 59)}, 2000).collect()}
    for g, xs in data.items():
        for values, low, high in ((xs, "mean_low", "mean_high"), (xs > 0, "rate_low", "rate_high")):
            means = np.mean(rng.choice(values, (4000, len(values))), axis=1)
            spread = np.std(values) / math.sqrt(len(values)) * 0.25 + 1e-9
            assert abs(got[g][low] - np.percentile(means, 2.5)) < spread and abs(got[g][high] - np.percentile(means, 97.5)) < spread
            assert math.isclose(got[g][low], again[g][low], rel_tol=1e-9) and math.isclose(got[g][high], again[g][high], rel_tol=1e-9)
    assert got[0].k is None and stats.bootstrap_intervals(df, [], {"mean": ("v", 1)}, 50).count() == 1


def test_gathered_groups_have_the_same_intervals(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 11 > 0, F.sin("id")).alias("v"), (F.col("id") % 2).cast("double").alias("up"))
    ends = lambda few: {r.g: tuple(r)[1:] for r in stats.bootstrap_intervals(df, ["g"], {"mean": ("v", 42), "rate": ("up", 59)}, 200, few_rows=few).collect()}
    summed, gathered, some = ends(0), ends(300), ends(39)
    assert len(summed) == 7 and all(summed[g] == pytest.approx(more[g], abs=1e-9) for g in summed for more in (gathered, some))


# -- tiers

def greedy(tier_rows):
    """Rows examined one by one, as a loop would."""
    taken, rejected = [], []
    for name, rows, test, cap in tier_rows:
        mine, full = [], not cap
        for r in sorted(rows):
            position, key, kind = r
            reason = "beyond_cap" if full else next((x for x, t in test if t(r, taken)), None)
            if reason is None and key in {x[2] for x in taken} | {x[2] for x in mine}:
                reason = "duplicate"
            if reason:
                rejected.append((name, position, f"{name}_{reason}"))
            else:
                mine.append((name, position, key))
            full = full or len(mine) >= cap
        taken += mine
    return sorted(taken), sorted(rejected)


@pytest.mark.parametrize("caps", [(5, 7), (0, 3), (100, 100)])
def test_tiers_by_force(spark, caps):
    rng = random.Random(caps[0])
    first = [(p, rng.randrange(30), rng.choice("abc")) for p in range(80)]
    second = [(p, rng.randrange(60), rng.choice("abc")) for p in range(90)]
    frame = lambda rows: spark.createDataFrame(rows, "position long, key long, kind string").repartition(3)
    bad = tiers.Test("kind", F.col("kind") == "c")
    taken, rejected = tiers.select_tiers([tiers.Tier("one", frame(first), [bad], caps[0], ["key"], values={"w": 1.0}), tiers.Tier("two", frame(second), [tiers.Barred("taken", ["key"]), bad], caps[1], ["key"])], ["key", "kind"])
    wrong = ("kind", lambda r, _: r[2] == "c")
    want = greedy([("one", first, [wrong], caps[0]), ("two", second, [("taken", lambda r, t: r[1] in {x[2] for x in t}), wrong], caps[1])])
    assert sorted((r.tier, r.position, r.key) for r in taken.collect()) == want[0]
    got = sorted((r.tier, r.position, r.reason) for r in rejected.collect())
    assert got == want[1] and len(got) + len(want[0]) == len(first) + len(second)
    report = {(r.kind, r["name"]): r.n for r in tiers.tier_report(taken, rejected, ["kind"]).collect()}
    assert sum(n for (k, _), n in report.items() if k == "tier") == len(want[0]) and sum(n for (k, _), n in report.items() if k == "reason") == len(want[1])


# -- ligands

def every_match(elements, xyz, bonds, ref_elements, ref_xyz, ref_bonds):
    """All permutations tried."""
    n, links, ref_links = len(elements), {frozenset(b) for b in bonds}, {frozenset(b) for b in ref_bonds}
    best = None
    for p in itertools.permutations(range(n)):
        if [elements[i] for i in p] == ref_elements and {frozenset((p[a], p[b])) for a, b in ref_bonds} == links and len(links) == len(ref_links):
            d = math.sqrt(sum(((xyz[p[i]] - ref_xyz[i]) ** 2).sum() for i in range(n)) / n)
            best = d if best is None else min(best, d)
    return best


RING = [(i, (i + 1) % 6) for i in range(6)]


def hexagon(turn=0.0):
    a = np.arange(6) * math.pi / 3 + turn
    return np.stack([np.cos(a), np.sin(a), np.zeros(6)], axis=1)


def test_symmetry_gives_zero():
    assert ligands.least_deviation(["C"] * 6, hexagon(math.pi / 3), RING, ["C"] * 6, hexagon(), RING) == ("ok", pytest.approx(0, abs=1e-12))
    acid = np.array([[0, 0, 0], [1.5, 0, 0], [2.1, 1.0, 0], [2.1, -1.0, 0]])
    bonds = [(0, 1), (1, 2), (1, 3)]
    assert ligands.least_deviation(["C", "C", "O", "O"], acid[[0, 1, 3, 2]], bonds, ["C", "C", "O", "O"], acid, bonds) == ("ok", 0.0)
    # atoms in another order altogether
    order = [3, 1, 0, 2]
    place = {old: new for new, old in enumerate(order)}
    moved = [(place[a], place[b]) for a, b in bonds]
    assert ligands.least_deviation([["C", "C", "O", "O"][i] for i in order], acid[order], moved, ["C", "C", "O", "O"], acid, bonds) == ("ok", 0.0)


def test_statuses():
    two = np.array([[0, 0, 0], [1, 0, 0.0]])
    assert ligands.least_deviation(["C", "N"], two, [(0, 1)], ["C", "O"], two, [(0, 1)]) == ("elements_differ", None)
    assert ligands.least_deviation(["C"], two[:1], [], ["C", "O"], two, [(0, 1)]) == ("atom_counts_differ", None)
    assert ligands.least_deviation(["C", "O"], two + 1, [], ["C", "O"], two, [(0, 1)]) == ("in_order", pytest.approx(math.sqrt(3)))
    assert ligands.least_deviation([], two[:0], [], [], two[:0], []) == ("no_heavy_atoms", None)


@pytest.mark.parametrize("seed", range(25))
def test_matches_by_force(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 6)
    elements = [rng.choice("CCO") for _ in range(n)]
    bonds = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 7))}) if n > 1 else []
    order = rng.sample(range(n), n)
    place = {old: new for new, old in enumerate(order)}
    nrng = np.random.default_rng(seed)
    ref, xyz = nrng.random((n, 3)), nrng.random((n, 3))
    status, got = ligands.least_deviation([elements[i] for i in order], xyz, [(place[a], place[b]) for a, b in bonds], elements, ref, bonds)
    assert status == "ok" and got == pytest.approx(every_match([elements[i] for i in order], xyz, [(place[a], place[b]) for a, b in bonds], elements, ref, bonds))


def test_deviation_of_tables(spark):
    atoms = [("t", "p", i, e, *map(float, x)) for i, (e, x) in enumerate(zip(["C"] * 6 + ["H"], [*hexagon(math.pi / 3), np.zeros(3)]))] + [("t", "q", i, "N", *map(float, x)) for i, x in enumerate(hexagon())]
    ref = [("t", 10 + i, "c " if i else "C", *map(float, x)) for i, x in enumerate(hexagon())]
    a = spark.createDataFrame(atoms, "target string, pose string, serial int, element string, x double, y double, z double")
    b = spark.createDataFrame([("t", p, x, y) for p in "pq" for x, y in RING], "target string, pose string, src int, dst int")
    r = spark.createDataFrame(ref, "target string, serial int, element string, x double, y double, z double")
    rb = spark.createDataFrame([("t", 10 + x, 10 + y) for x, y in RING], "target string, src int, dst int")
    got = {x.pose: (x.status, x.rmsd) for x in ligands.symmetric_deviation(a, b, r, rb, "target", "pose").collect()}
    assert got["p"] == ("ok", pytest.approx(0, abs=1e-12)) and got["q"] == ("elements_differ", None)
    with pytest.raises(Exception, match="elements_differ"):
        ligands.symmetric_deviation(a, b, r, rb, "target", "pose", strict=True).collect()


# -- renumbering

@pytest.mark.parametrize("n", [0, 1, 400])
def test_renumbered_by_force(spark, n):
    rng = random.Random(n)
    rows = [(f, i, rng.choice(["A", "A", "A", "B", None]), i // 3) for f in ("x", "y") for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, line_no long, chain string, residue long").repartition(4)
    got = sorted(((r.file, r.serial, r.record, r.chain, r.residue, r.line_no) for r in renumber.renumbered(df, ["file"], "line_no", "chain", "residue").collect()), key=str)
    want = []
    for f in ("x", "y"):
        serial, last = 0, None
        for _, i, c, r in sorted((x for x in rows if x[0] == f), key=lambda x: x[1]):
            c = c or ""
            if last and last[0] != c:
                serial += 1
                want.append((f, serial, "TER", *last, None))
            serial += 1
            want.append((f, serial, "ATOM", c, r, i))
            last = (c, r)
        if last:
            want.append((f, serial + 1, "TER", *last, None))
    assert got == sorted(want, key=str)


def test_chosen_atoms_and_ter_lines(spark):
    rows = [("f", "CA", 1, "B", 0.9, 1.0), ("f", "CA", 2, "A", 0.1, 2.0), ("f", "CB", 3, "C", 0.2, 3.0), ("f", "CB", 4, "D", 0.7, 4.0), ("f", "N", 5, "A", 1.0, 5.0), ("f", "N", 6, " ", None, 6.0)]
    df = spark.createDataFrame(rows, "file string, name string, line_no long, altloc string, occupancy double, x double")
    assert sorted((r.name, r.line_no, r.x) for r in renumber.chosen_atoms(df, ["file"], ["name"]).collect()) == [("CA", 1, 2.0), ("CB", 3, 4.0), ("N", 5, 6.0)]
    line = spark.createDataFrame([(12, "ALA", "A", "  34 ")], "serial int, name string, chain string, place string").select(renumber.ter_line("serial", F.col("name"), "chain", F.col("place")).alias("t")).first().t
    assert line == "TER      12      ALA A  34 "


# -- builds and reports

def test_builds_redo_only_what_changed(spark, tmp_path):
    seen = []

    def build(rows):
        seen.append(sorted(r.k for r in rows.collect()))
        return rows.select("k", (F.col("v") * 2).alias("feature"))

    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, bad boolean")
    folder, tests = str(tmp_path / "b"), [("bad_input", F.col("bad"))]
    first = builds.build_features(frame([("a", 1, False), ("b", 2, False), ("c", None, False), ("d", 4, True)]), "k", build, folder, tests)
    assert (first.run, first.built, first.unchanged, first.removed, first.rejected) == (0, 3, 0, 0, 1)
    second = builds.build_features(frame([("a", 1, False), ("b", 5, False), ("d", 4, True), ("e", 6, False)]), "k", build, folder, tests)
    assert seen == [["a", "b", "c"], ["b", "e"]]
    assert (second.run, second.built, second.unchanged, second.removed, second.rejected) == (1, 2, 2, 1, 0)
    assert sorted((r.k, r.feature, r.run) for r in builds.features(spark, folder, "k").collect()) == [("a", 2, 0), ("b", 10, 1), ("e", 12, 1)]
    third = builds.build_features(frame([("c", 1, False), ("a", 1, False)]), "k", build, folder, tests)
    assert seen[-1] == ["c"] and third.removed == 3 and sorted(r.k for r in builds.features(spark, folder, "k").collect()) == ["a", "c"]
    with pytest.raises(Exception, match="bad_input: z"):
        builds.build_features(frame([("z", 1, True)]), "k", build, folder, tests, fatal=["bad_input"])
    assert sorted(r.k for r in builds.features(spark, folder, "k").collect()) == ["a", "c"]


def test_a_build_that_dies_changes_nothing(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "k int, v int")
    folder = str(tmp_path / "b")
    good = lambda rows: rows.select("k", "v")
    builds.build_features(frame([(1, 1), (2, 2)]), "k", good, folder)
    with pytest.raises(Exception, match="half way"):
        builds.build_features(frame([(1, 9), (2, 2)]), "k", lambda rows: rows.select("k", F.raise_error(F.lit("half way")).cast("int").alias("v")), folder)
    assert sorted((r.k, r.v) for r in builds.features(spark, folder, "k").collect()) == [(1, 1), (2, 2)]
    assert builds.build_features(frame([(1, 9), (2, 2)]), "k", good, folder).built == 1
    assert sorted((r.k, r.v) for r in builds.features(spark, folder, "k").collect()) == [(1, 9), (2, 2)]


def test_builds_from_a_stream(spark, tmp_path):
    schema = "k int, v int"
    source = str(tmp_path / "in")
    folder, checkpoint = str(tmp_path / "b"), str(tmp_path / "c")
    for rows in ([(1, 1), (2, 2)], [(2, 3), (3, 3), (1, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        builds.build_from_stream(spark.readStream.schema(schema).parquet(source), "k", lambda df: df.select("k", "v"), folder, checkpoint)
    assert sorted((r.k, r.v, r.run) for r in builds.features(spark, folder, "k").collect()) == [(1, 1, 0), (2, 3, 1), (3, 3, 1)]


def test_reports_are_whole_or_not_there(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") / 2)
    folder = str(tmp_path / "r")
    assert builds.report_tables(spark, folder) is None
    broken = df.withColumn("x", F.raise_error(F.lit("killed")).cast("double"))
    with pytest.raises(Exception, match="killed"):
        builds.write_report({"a": (df, "csv"), "b": (broken, "json")}, folder)
    assert builds.report_tables(spark, folder) is None
    listed = builds.write_report({"a": (df, "csv"), "b": (df.where("id > 1"), "json"), "c": (df.limit(0), "parquet")}, folder)
    assert sorted((r.name, r.format, r.n_rows, r.n_columns) for r in listed.collect()) == [("a", "csv", 5, 2), ("b", "json", 3, 2), ("c", "parquet", 0, 2)]
    with pytest.raises(Exception, match="killed"):
        builds.write_report({"a": (df.limit(1), "csv"), "b": (broken, "json")}, folder)
    assert builds.report_table(spark, folder, "a").count() == 5 and builds.report_table(spark, folder, "b", "id long, x double").agg(F.sum("id")).first()[0] == 9
    with pytest.raises(LookupError):
        builds.report_table(spark, folder, "z")


def test_report_inputs_meet_once_and_only_sums_are_stored(spark, monkeypatch):
    inputs = assembly_queries._report_inputs(spark, "/root/testdata/sf0.001")
    for name in ("residues", "deltas"):
        assert "Join" not in inputs[name]._jdf.queryExecution().optimizedPlan().toString()
    kept = []
    monkeypatch.setattr(publication, "stored", lambda df: kept.append(df.columns) or df)
    publication.publication_tables(inputs, ("plug",), fields=("family",), neural=("neural",), iterations=20)
    assert inputs["checks"].columns not in kept and inputs["selectors"].columns not in kept
    assert ["scope", "pair_count", "failed_pair_checks", "status"] in kept
