"""Docking inputs with the reasons of what is skipped, and the summary of poses and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.streaming.incremental import stored

from . import ranking, stats
from .reports import reasons


def inputs(wanted: DataFrame, manifest: DataFrame, ligands: DataFrame, files: DataFrame) -> DataFrame:
    """Every wanted pair_id with status and reason, and what the manifest, the ligand choice and the files say of it.

    manifest: pair_id, chain, pdb_chain and more; ligands: pair_id, ligand (the chosen one, null for none), converted;
    files: pair_id, has_pair, has_prediction. The first test that fails is the reason.
    """
    rows = wanted.select("pair_id").join(manifest.withColumn("_row", F.lit(True)), "pair_id", "left").join(ligands, "pair_id", "left").join(files, "pair_id", "left")
    tests = [
        ("pair_id not in manifest", F.col("_row").isNull()), ("no selected ligand instance", F.col("ligand").isNull()),
        ("missing pair or prediction file", ~F.coalesce(F.col("has_pair") & F.col("has_prediction"), F.lit(False))), ("ligand conversion failed", ~F.coalesce("converted", F.lit(False))),
    ]
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = reasons(rows, tests).withColumn("chain", F.coalesce(blank("chain"), blank("pdb_chain"), F.lit("A"))).drop("_row", "pdb_chain")
    return out.withColumn("status", F.when(F.col("reason").isNull(), "included").otherwise("skipped"))


def _long(rows: DataFrame, by: Sequence[str], section: str) -> DataFrame:
    """structure, section, metric, value: each number of a summary as a row."""
    names = [c for c in rows.columns if c not in by]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names)))
    return rows.select(*by, F.lit(section).alias("section"), cells.alias("c")).select(*by, "section", "c.metric", "c.value")


def summary(ranked_poses: DataFrame, target: str, structure: str, labels: tuple[str, str], levels: Sequence[int] = (1, 2, 3, 5, 10), thresholds: Sequence[float] = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0), threshold: float = 2.0) -> DataFrame:
    """All parts of the report as rows of structure, section, metric, value; the comparison of the two labels has structure "delta".

    Sections: top1, topn (n as metric), first_hit, curve (threshold as metric), delta, correlation (of the two best scores).
    Poses are gone through once: all parts come from a stored row for each target and structure.
    """
    by = [structure]
    named = lambda df, c: df.withColumn("metric", F.concat(F.lit(f"{c}_"), F.col(c).cast("string")))
    best = stored(ranking.best_poses(ranked_poses, [target, structure], threshold))
    topn = named(ranking.topn_of_best(best, by, levels), "top_n")
    curve = named(ranking.success_curve(best, by, thresholds), "threshold")
    table = ranking.score_table(best, target, structure, list(labels))
    both = F.col(labels[0]).isNotNull() & F.col(labels[1]).isNotNull()
    parts = [
        _long(ranking.top1_summary(best, by, threshold), by, "top1"), topn.select(*by, F.lit("topn").alias("section"), "metric", F.col("success").alias("value")),
        topn.select(*by, F.lit("topn_valid").alias("section"), "metric", F.col("success_valid").alias("value")), _long(ranking.first_hits_of_best(best, by, levels), by, "first_hit"),
        curve.select(*by, F.lit("curve").alias("section"), "metric", F.col("success_rate").alias("value")),
        _long(ranking.delta_report(table.where(both).withColumn(structure, F.lit("delta")), by), by, "delta"),
        _long(table.where(both).agg(stats.pearson_of(labels[0], labels[1]).alias("pearson")).withColumn(structure, F.lit("delta")), by, "correlation"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed(structure, "structure")


def target_correlations(ranked_poses: DataFrame, target: list[str], levels: Sequence[int], threshold: float = 2.0) -> DataFrame:
    """Metrics of each target with both correlations of score and deviation; a target's poses are few, so that its ranks are windows, and all comes from one aggregate."""
    both = F.col("score").isNotNull() & F.col("rmsd").isNotNull()

    def ranks(c: str) -> Column:
        w = Window.partitionBy(*target, both)
        return F.when(both, F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*target, both, c)) - 1) / 2.0)

    rows = ranked_poses.select(*target, "position", "score", "rmsd").withColumns({"_rx": ranks("score"), "_ry": ranks("rmsd")})
    return ranking.per_target(rows, target, levels, threshold, {"spearman": stats.pearson_of("_rx", "_ry")})
