"""Templates, docking inputs and reports, entity rows and parameter lists on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import docking, entities, ranking, stats, templates


def test_templates(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9, 0.8, False, 5), (1, 3, 0.9, 0.9, False, 4), (1, 4, 0.95, 0.9, True, 4), (1, 5, 0.2, 0.9, False, 9), (1, 1, 1.0, 1.0, False, 9), (2, 1, 0.5, 0.5, False, 1)], "target long, donor long, identity double, coverage double, same_protein boolean, fit_residues int")
    ranked = templates.candidates(pairs, 0.3, 0.4)
    assert {(r.target, r.donor): r.rank for r in ranked.collect()} == {(1, 3): 1, (1, 2): 2, (2, 1): 1}
    assert templates.candidates(pairs, 0.3, 0.4, same=True).where("rank = 1 and target = 1").first().donor == 4
    moved = spark.createDataFrame([(1, 3, 0, 1.0, 0.0, 0.0), (1, 2, 0, 3.0, 0.0, 0.0), (1, 3, 1, 0.0, 0.0, 0.0), (1, 2, 1, 0.0, 2.0, 0.0)], "target long, donor long, idx long, px double, py double, pz double")
    residues = spark.createDataFrame([(t, k) for t in (1, 9) for k in (0, 1)], "target long, idx long")
    got = {(r.target, r.idx): (r.nx, r.mx, r.my) for r in templates.predictions(residues, moved, ranked).collect()}
    assert got == {(1, 0): (1, 2, 0), (1, 1): (0, 0, 2), (9, 0): (0, 0, 0), (9, 1): (0, 0, 0)}
    rows = {r.target: r for r in templates.selection(residues.distinct().select("target").distinct(), ranked).collect()}
    assert (rows[1].candidate_count, rows[1].nearest_donor, rows[1].average_donors, rows[9].candidate_count, rows[9].nearest_donor) == (2, 3, "3;2", 0, None)


def test_docking_inputs(spark):
    wanted = spark.createDataFrame([(k,) for k in "abcde"], "pair_id string")
    manifest = spark.createDataFrame([(k, " ", "B") for k in "abcd"], "pair_id string, chain string, pdb_chain string")
    ligands = spark.createDataFrame([("a", "L", True), ("b", None, None), ("c", "L", True), ("d", "L", False)], "pair_id string, ligand string, converted boolean")
    files = spark.createDataFrame([("a", True, True), ("c", True, False), ("d", True, True)], "pair_id string, has_pair boolean, has_prediction boolean")
    got = {r.pair_id: (r.status, r.reason, r.chain) for r in docking.inputs(wanted, manifest, ligands, files).collect()}
    assert got["a"] == ("included", None, "B")
    assert {k: got[k][1] for k in "bcde"} == {"b": "no selected ligand instance", "c": "missing pair or prediction file", "d": "ligand conversion failed", "e": "pair_id not in manifest"}


def _classes(spark):
    """Targets and donors of few classes, measures of their pairs with many ties, and the same pairs one by one."""
    rng = np.random.default_rng(5)
    ids = [(k, int(rng.integers(6)), None if k % 17 == 0 else "pqqqq"[rng.integers(5)] if k % 3 else "q") for k in range(120)]
    s = spark.createDataFrame(ids, "id int, class int, protein string")
    measures = spark.createDataFrame([(a, b, float(rng.integers(4)) / 4, float(rng.integers(3)) / 2, int(rng.integers(2))) for a in range(6) for b in range(6) if (a + b) % 5], "target_class int, donor_class int, identity double, coverage double, fit_residues int")
    t, d = (s.select(F.col("id").alias(n), F.col("class").alias(f"{n}_class"), "protein") for n in ("target", "donor"))
    pairs = t.join(d.withColumnRenamed("protein", "p"), F.lit(True)).join(measures, ["target_class", "donor_class"]).withColumn("same_protein", F.col("protein") == F.col("p"))
    return t, d, measures, templates.candidates(pairs, 0.25, 0.5)


def test_classes_rank_as_pairs_do(spark):
    t, d, measures, force = _classes(spark)
    ranked, counts = templates.ranked_by_class(t, d, measures, 0.25, 0.5, 3)
    rows = lambda df: sorted(tuple(r) for r in df.select("target", "donor", "rank", "identity", "coverage", "fit_residues").collect())
    assert rows(ranked) == rows(force.where("rank <= 3")) and ranked.count() > 200
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, force.groupBy("target").agg(F.count("*")).collect()))


def test_selection_by_class(spark):
    t, d, measures, force = _classes(spark)
    ranked, counts = templates.ranked_by_class(t, d, measures, 0.25, 0.5, 3)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert rows(templates.selection(t, ranked, 3, counts)) == rows(templates.selection(t, force, 3))


def test_docking_summary(spark):
    rows = [("A", "af2", -8.0, 3.0, 1), ("A", "af2", -7.0, 1.0, 2), ("B", "af2", -6.0, 2.5, 1), ("A", "new", -9.0, 1.0, 1), ("B", "new", -7.0, 1.5, 1)]
    df = spark.createDataFrame(rows, "target string, structure string, score double, rmsd double, k int").withColumn("valid", F.lit(True))
    got = {(r.structure, r.section, r.metric): r.value for r in docking.summary(ranking.ranked(df, ["target", "structure"], ["k"]), "target", "structure", ("af2", "new"), (1, 2)).collect()}
    assert got["af2", "top1", "n_success"] == 0 and got["new", "top1", "n_success"] == 2
    assert got["af2", "topn", "top_n_2"] == 0.5 and got["delta", "delta", "n_better"] == 2 and got["delta", "delta", "mean_delta"] == -1


def test_given_ranks_and_scores(spark):
    rows = [("A", 2, 3.0), ("A", 1, 1.5), ("B", 1, 2.5)]
    df = spark.createDataFrame([(t, k, -float(k), d) for t, k, d in rows], "target string, rank int, score double, rmsd double")
    assert sorted(r.rmsd for r in ranking.ranked(df, ["target"], ["rmsd"]).where("position = 1").collect()) == [1.5, 2.5]
    some = df.withColumn("rank", F.when(F.col("target") == "A", F.col("rank")))
    assert sorted(r.rmsd for r in ranking.ranked(some, ["target"], ["rmsd"]).where("position = 1").collect()) == [2.5, 3.0]


def test_entities_and_lists(spark):
    e = spark.createDataFrame([("1abc", "1", [" ", "P1"], [(0.4,), (0.9,)], ["B", "A"], 10), ("2abc", "1", [], [], [], 5)], "entry string, entity string, accessions array<string>, alignments array<struct<coverage:double>>, chains array<string>, length int")
    entry = spark.createDataFrame([("1abc", [0.0, 2.5, 1.9], [" zn", "HEM", "Zn "], None)], "entry string, resolutions array<double>, ligands array<string>, method string")
    rows = entities.entity_rows(e, entry, {"split": "expansion"}).collect()
    assert len(rows) == 1 and tuple(rows[0]) == ("1abc_1", "1ABC", "P1", "B", 0.9, 1.9, "HEM;ZN", 10, "", "expansion")
    assert entities.checked_list("3, 1", numbers=True, least=1) == [3, 1] and entities.checked_list("a,b", ["a", "b"]) == ["a", "b"]
    for bad in ({"text": ""}, {"text": "1,1"}, {"text": "a,c", "known": ["a"]}, {"text": "0", "numbers": True, "least": 1}):
        with pytest.raises(ValueError):
            entities.checked_list(**bad)


def _few_poses(spark):
    rng = np.random.default_rng(8)
    rows = [(t, "AR"[k % 2], None if k == 3 else float(rng.integers(4)), None if k == 5 else float(rng.integers(5)), k % 3 > 0, k) for t in range(6) for k in range((0, 1, 3, 8, 9, 20)[t])]
    return ranking.ranked(spark.createDataFrame(rows, "target int, structure string, score double, rmsd double, valid boolean, k int"), ["target", "structure"], ["k"])


def test_correlations_are_those_of_ranks(spark):
    p = _few_poses(spark)
    wanted = {r.target: r.spearman for r in stats.spearman(p, "score", "rmsd", ["target"]).collect()}
    out = docking.target_correlations(p, ["target"], (1, 5))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("Aggregate [") == 1  # no join of separate summaries
    got = {r.target: r.spearman for r in out.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(got[t] == pytest.approx(wanted.get(t)) for t in got)


def test_poses_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    p = _few_poses(spark)
    n = p.count()
    docking.summary(p.mapInArrow(count, p.schema), "target", "structure", ("A", "R"), (1, 2)).collect()
    assert seen.value == n
