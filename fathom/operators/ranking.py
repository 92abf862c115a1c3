"""Ranked poses: order, top-N success, first hits, per-target and overall summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.clean import ratio

from .ranges import with_quantiles
from .stats import indicator_interval, pearson_of, wilson


def ranked(poses: DataFrame, target: Sequence[str], ties: Sequence[str], higher_better: bool = False) -> DataFrame:
    """poses with position from 1: by rank where every row of all has one, else by score; nulls last, ties in order.

    Whether all have one is a one-row aggregate in the plan, no job of its own.
    """
    own = F.col("score").desc_nulls_last() if higher_better else F.col("score").asc_nulls_last()
    if "rank" in poses.columns:
        lacking = poses.agg(F.coalesce(F.bool_or(F.col("rank").isNull()), F.lit(False)).alias("_lacking"))
        poses = poses.crossJoin(F.broadcast(lacking)).withColumn("_rank", F.when(~F.col("_lacking"), F.col("rank"))).drop("_lacking")
        order = [F.col("_rank").asc_nulls_last(), own]
    else:
        order = [own]
    # with ranks, equal ranks fall to the ties at once, not to the score
    if len(order) == 2:
        order[1] = F.when(F.col("_rank").isNull(), -F.col("score") if higher_better else F.col("score")).asc_nulls_last()
    return poses.withColumn("position", F.row_number().over(Window.partitionBy(*target).orderBy(*order, *ties)).cast("bigint")).drop("_rank")


def top1_summary(ranked_poses: DataFrame, by: list[str], threshold: float = 2.0) -> DataFrame:
    """Rates over targets with a number for rmsd; success is strictly below the threshold."""
    top = ranked_poses.where("position = 1 and rmsd is not null")
    hit = F.count_if(F.col("rmsd") < threshold)
    n = F.count("*")
    lo, hi = wilson(hit, n)
    out = top.groupBy(*by).agg(
        n.alias("n"), hit.alias("n_success"), ratio(hit, n).alias("success_rate"), lo.alias("wilson_low"), hi.alias("wilson_high"),
        F.avg("rmsd").alias("mean_rmsd"), F.stddev_samp("rmsd").alias("sd_rmsd"), F.min("rmsd").alias("min_rmsd"), F.max("rmsd").alias("max_rmsd"),
    )
    return with_quantiles(out, top, by, "rmsd", {"median_rmsd": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95})


def top1_interval(ranked_poses: DataFrame, by: list[str], threshold: float = 2.0, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """Bootstrap interval of the rate of targets whose first pose is a success."""
    return indicator_interval(ranked_poses.where("position = 1 and rmsd is not null").withColumn("hit", F.col("rmsd") < threshold), by, "hit", iterations, seed)


def best_poses(ranked_poses: DataFrame, target: list[str], threshold: float = 2.0) -> DataFrame:
    """A row for each target: its first pose's score and rmsd (position is 1), and the positions of its first hit and first valid hit."""
    hit, top = F.col("rmsd") < threshold, F.col("position") == 1
    return ranked_poses.groupBy(*target).agg(
        F.lit(1).alias("position"), F.max(F.when(top, F.col("score"))).alias("score"), F.max(F.when(top, F.col("rmsd"))).alias("rmsd"),
        F.min(F.when(hit, F.col("position"))).alias("first_hit"), F.min(F.when(hit & F.col("valid"), F.col("position"))).alias("first_valid"),
    )


def topn_success(ranked_poses: DataFrame, target: list[str], by: list[str], levels: Sequence[int], threshold: float = 2.0) -> DataFrame:
    """Share of all targets with a hit (and a valid hit) among their first n poses."""
    return topn_of_best(best_poses(ranked_poses, target, threshold), by, levels)


def topn_of_best(best: DataFrame, by: list[str], levels: Sequence[int]) -> DataFrame:
    rows = best.withColumn("top_n", F.explode(F.array(*map(F.lit, levels))))
    share = lambda c: F.avg(F.coalesce(F.col(c) <= F.col("top_n"), F.lit(False)).cast("double"))
    return rows.groupBy(*by, "top_n").agg(F.count("*").alias("n_targets"), share("first_hit").alias("success"), share("first_valid").alias("success_valid"))


def first_hits(ranked_poses: DataFrame, target: list[str], by: list[str], levels: Sequence[int], threshold: float = 2.0) -> DataFrame:
    return first_hits_of_best(ranked_poses.groupBy(*target).agg(F.min(F.when(F.col("rmsd") < threshold, F.col("position"))).alias("first_hit")), by, levels)


def first_hits_of_best(each: DataFrame, by: list[str], levels: Sequence[int]) -> DataFrame:
    out = each.groupBy(*by).agg(
        F.count("*").alias("n_targets"), F.count("first_hit").alias("n_hit"), F.avg(F.col("first_hit").isNull().cast("double")).alias("miss_rate"),
        F.avg("first_hit").alias("mean_first_hit"),
        *(F.avg(F.coalesce((F.col("first_hit") <= k), F.lit(False)).cast("double")).alias(f"cdf_{k}") for k in levels),
    )
    return with_quantiles(out, each, by, "first_hit", {"median_first_hit": 0.5})


def per_target(ranked_poses: DataFrame, target: list[str], levels: Sequence[int], threshold: float = 2.0, more: Mapping[str, Column] | None = None) -> DataFrame:
    """Metrics of each target, and more aggregates by name."""
    hit = F.col("rmsd") < threshold
    return ranked_poses.groupBy(*target).agg(
        F.count("*").alias("n_poses"), F.max(F.when(F.col("position") == 1, F.col("rmsd"))).alias("top1_rmsd"), F.min("rmsd").alias("best_rmsd"), F.median("rmsd").alias("median_rmsd"),
        *(F.count_if(hit & (F.col("position") <= k)).alias(f"hits_{k}") for k in levels), pearson_of("score", "rmsd").alias("pearson"),
        *(c.alias(n) for n, c in (more or {}).items()),
    )


def success_curve(ranked_poses: DataFrame, by: list[str], thresholds: Sequence[float]) -> DataFrame:
    top = ranked_poses.where("position = 1 and rmsd is not null").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return top.groupBy(*by, "threshold").agg(F.avg((F.col("rmsd") < F.col("threshold")).cast("double")).alias("success_rate"))


def redocking_gate(ranked_poses: DataFrame, target: list[str], top_n: int, threshold: float = 2.0) -> DataFrame:
    ok = (F.col("rmsd") < threshold) & (F.col("position") <= top_n)
    return ranked_poses.groupBy(*target).agg(F.min(F.when(ok, F.col("position"))).alias("passing_rank")).withColumn("passed", F.col("passing_rank").isNotNull())


def score_table(ranked_poses: DataFrame, target: str, structure: str, labels: Sequence[str]) -> DataFrame:
    """Best score of each structure side by side, and the second's minus the first's."""
    wide = ranked_poses.where("position = 1").groupBy(target).pivot(structure, list(labels)).agg(F.first("score"))
    return wide.withColumn("delta", F.col(labels[1]) - F.col(labels[0]))


def delta_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Differences of scores: improved below 0; the paired t is mean / (sd / sqrt(n))."""
    d = F.col("delta")
    rows = rows.where(d.isNotNull())
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(d < 0).alias("n_better"), F.count_if(d > 0).alias("n_worse"), F.count_if(d == 0).alias("n_tied"),
        F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("sd_delta"),
        ratio(F.avg(d), F.nullif(ratio(F.stddev_samp(d), F.sqrt(F.count("*"))), F.lit(0.0))).alias("t_stat"),
    )
    return with_quantiles(out, rows, by, "delta", {"median_delta": 0.5, "p10": 0.1, "p90": 0.9})
