"""Queries over ranked poses and scored labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import curves, ranking, stats
from fathom.registry import query

from .virtual import SQL_POSES, SQL_SCORED, TIES, poses, r, scored, tidy


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(poses(spark, sf_dir), ["target", "structure"], TIES)


@query("ranked_poses", f"WITH {SQL_POSES} SELECT target, structure, position, score, rmsd FROM rk WHERE position <= 2")
def ranked_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).where("position <= 2").select("target", "structure", "position", "score", "rmsd")


_Q = ", ".join(r(f"quantile_cont(rmsd, {q})", n) for q, n in ((0.25, "p25"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95")))
_W = "((p + 1.96*1.96 / (2*n)) {s} 1.96 * sqrt(p * (1 - p) / n + 1.96*1.96 / (4.0*n*n))) / (1 + 1.96*1.96 / n)"


@query("top1_summary", f"""WITH {SQL_POSES}, a AS (SELECT structure, count(*) AS n, count(*) FILTER (rmsd < 2) AS n_success, avg((rmsd < 2)::INT) AS p, avg(rmsd) AS m, median(rmsd) AS md, stddev_samp(rmsd) AS sd, min(rmsd) AS mn, max(rmsd) AS mx, {_Q} FROM rk WHERE position = 1 GROUP BY structure)
 SELECT structure, n, n_success, {r('p', 'success_rate')}, {r(f"greatest(0, {_W.format(s='-')})", 'wilson_low')}, {r(f"least(1, {_W.format(s='+')})", 'wilson_high')}, {r('m', 'mean_rmsd')}, {r('md', 'median_rmsd')}, {r('sd', 'sd_rmsd')}, {r('mn', 'min_rmsd')}, {r('mx', 'max_rmsd')}, p25, p75, p90, p95 FROM a""")
def top1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ranking.top1_summary(_ranked(spark, sf_dir), ["structure"]))


@query("topn_success", f"""WITH {SQL_POSES}, e AS (SELECT target, structure, top_n, bool_or(rmsd < 2 AND position <= top_n) AS h, bool_or(rmsd < 2 AND position <= top_n AND valid) AS hv FROM rk, (VALUES (1), (2), (3)) t(top_n) GROUP BY ALL)
 SELECT structure, top_n::BIGINT AS top_n, count(*) AS n_targets, {r('avg(h::INT)', 'success')}, {r('avg(hv::INT)', 'success_valid')} FROM e GROUP BY ALL""")
def topn_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ranking.topn_success(_ranked(spark, sf_dir), ["target", "structure"], ["structure"], [1, 2, 3]))


@query("first_hits", f"""WITH {SQL_POSES}, e AS (SELECT target, structure, min(CASE WHEN rmsd < 2 THEN position END) AS h FROM rk GROUP BY ALL)
 SELECT structure, count(*) AS n_targets, count(h) AS n_hit, {r('avg((h IS NULL)::INT)', 'miss_rate')}, {r('avg(h)', 'mean_first_hit')}, {r('median(h)', 'median_first_hit')}, {r('avg(coalesce(h <= 1, false)::INT)', 'cdf_1')}, {r('avg(coalesce(h <= 3, false)::INT)', 'cdf_3')} FROM e GROUP BY structure""")
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ranking.first_hits(_ranked(spark, sf_dir), ["target", "structure"], ["structure"], [1, 3]))


_PEARSON = "CASE WHEN count(*) >= 2 THEN covar_pop(score, rmsd) / nullif(sqrt(var_pop(score) * var_pop(rmsd)), 0) END"


@query("per_target_poses", f"""WITH {SQL_POSES} SELECT target, count(*) AS n_poses, {r('min(rmsd)', 'best_rmsd')}, {r('median(rmsd)', 'median_rmsd')}, count(*) FILTER (rmsd < 2) AS hits, {r(_PEARSON, 'pearson', 4)} FROM poses GROUP BY target""")
def per_target_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = poses(spark, sf_dir)
    out = p.groupBy("target").agg(F.count("*").alias("n_poses"), F.min("rmsd").alias("best_rmsd"), F.median("rmsd").alias("median_rmsd"), F.count_if(F.col("rmsd") < 2).alias("hits"), stats.pearson_of("score", "rmsd").alias("pearson"))
    return tidy(out.withColumn("pearson", F.round("pearson", 4)))


@query("target_rank_metrics", f"""WITH {SQL_POSES} SELECT target, structure, count(*) AS n_poses, {r('max(CASE WHEN position = 1 THEN rmsd END)', 'top1_rmsd')}, {r('min(rmsd)', 'best_rmsd')}, {r('median(rmsd)', 'median_rmsd')}, count(*) FILTER (rmsd < 2 AND position <= 1) AS hits_1, count(*) FILTER (rmsd < 2 AND position <= 3) AS hits_3 FROM rk GROUP BY ALL""")
def target_rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ranking.per_target(_ranked(spark, sf_dir), ["target", "structure"], [1, 3]).drop("pearson"))


@query("success_curve", f"""WITH {SQL_POSES} SELECT structure, threshold::DOUBLE AS threshold, {r('avg((rmsd < threshold)::INT)', 'success_rate')} FROM rk, (VALUES (0.5), (1.0), (1.5), (2.0), (2.5), (3.0)) t(threshold) WHERE position = 1 GROUP BY ALL""")
def success_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ranking.success_curve(_ranked(spark, sf_dir), ["structure"], [0.5, 1.0, 1.5, 2.0, 2.5, 3.0]))


@query("redocking_gate", f"""WITH {SQL_POSES}, e AS (SELECT target, structure, min(CASE WHEN rmsd < 2 AND position <= 3 THEN position END) AS k FROM rk GROUP BY ALL) SELECT structure, coalesce(k, 0)::BIGINT AS passing_rank, count(*) AS n FROM e GROUP BY ALL""")
def redocking_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = ranking.redocking_gate(_ranked(spark, sf_dir), ["target", "structure"], 3)
    return gate.groupBy("structure", F.coalesce("passing_rank", F.lit(0)).cast("bigint").alias("passing_rank")).agg(F.count("*").alias("n"))


@query("score_table", f"""WITH {SQL_POSES} SELECT target, max(CASE WHEN structure = 'A' THEN score END) AS "A", max(CASE WHEN structure = 'R' THEN score END) AS "R", {r("max(CASE WHEN structure = 'R' THEN score END) - max(CASE WHEN structure = 'A' THEN score END)", 'delta')} FROM rk WHERE position = 1 GROUP BY target""")
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.score_table(_ranked(spark, sf_dir), "target", "structure", ["A", "R"])
    return tidy(out.select("target", "A", "R", "delta"))


@query("delta_report", f"""WITH {SQL_POSES}, w AS (SELECT target, max(CASE WHEN structure = 'R' THEN score END) - max(CASE WHEN structure = 'A' THEN score END) AS d FROM rk WHERE position = 1 GROUP BY target)
 SELECT 'R-A' AS contrast, count(*) AS n, count(*) FILTER (d < 0) AS n_better, count(*) FILTER (d > 0) AS n_worse, count(*) FILTER (d = 0) AS n_tied, {r('avg(d)', 'mean_delta')}, {r('median(d)', 'median_delta')}, {r('stddev_samp(d)', 'sd_delta')},
 {r('avg(d) / (stddev_samp(d) / sqrt(count(*)))', 't_stat')}, {r('quantile_cont(d, 0.1)', 'p10')}, {r('quantile_cont(d, 0.9)', 'p90')} FROM w WHERE d IS NOT NULL""")
def delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ranking.score_table(_ranked(spark, sf_dir), "target", "structure", ["A", "R"]).withColumn("contrast", F.lit("R-A"))
    return tidy(ranking.delta_report(wide, ["contrast"]))


@query("spearman_by_structure", f"""WITH {SQL_POSES}, k AS (SELECT structure, rank() OVER (PARTITION BY structure ORDER BY score) + (count(*) OVER (PARTITION BY structure, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY structure ORDER BY rmsd) + (count(*) OVER (PARTITION BY structure, rmsd) - 1) / 2.0 AS b FROM poses)
 SELECT structure, count(*) AS n, {r('covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0)', 'spearman')} FROM k GROUP BY structure""")
def spearman_by_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.spearman(poses(spark, sf_dir), "score", "rmsd", ["structure"]))


_STEPS = SQL_SCORED + """, g AS (SELECT lang, score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM scored GROUP BY ALL),
 c AS (SELECT lang, score, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY lang) AS p, sum(neg) OVER (PARTITION BY lang) AS n FROM g WINDOW d AS (PARTITION BY lang ORDER BY score DESC)),
 e AS (SELECT *, fp / nullif(n, 0) AS fpr, tp / nullif(p, 0) AS tpr, tp / (tp + fp) AS precision FROM c),
 l AS (SELECT *, lag(fpr, 1, 0.0) OVER w AS fpr0, lag(tpr, 1, 0.0) OVER w AS tpr0, lag(precision, 1, 1.0) OVER w AS precision0 FROM e WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"""


@query("roc_points", f"WITH {_STEPS} SELECT lang, score, {r('fpr', 'fpr')}, {r('tpr', 'tpr')} FROM e")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(curves.roc(scored(spark, sf_dir), ["lang"]))


@query("curve_areas", f"""WITH {_STEPS} SELECT lang, max(p)::BIGINT AS positives, max(n)::BIGINT AS negatives, {r('CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum((fpr - fpr0) * (tpr + tpr0) / 2) END', 'auroc')},
 {r('CASE WHEN max(p) > 0 THEN sum((tpr - tpr0) * (precision + precision0) / 2) END', 'auprc')}, {r('CASE WHEN max(p) > 0 THEN sum((tpr - tpr0) * precision) END', 'average_precision')} FROM l GROUP BY lang""")
def curve_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(curves.areas(scored(spark, sf_dir), ["lang"]))


@query("interpolated_roc", f"""WITH {_STEPS}, pts AS (SELECT lang, fpr AS x, max(tpr) AS y FROM e WHERE fpr IS NOT NULL AND tpr IS NOT NULL GROUP BY ALL), grid AS (SELECT lang, i / 20.0::DOUBLE AS x FROM (SELECT DISTINCT lang FROM pts), range(21) t(i)),
 b AS (SELECT g.lang, g.x, (SELECT max_by(y, p.x) FROM pts p WHERE p.lang = g.lang AND p.x <= g.x) AS ly, (SELECT max(p.x) FROM pts p WHERE p.lang = g.lang AND p.x <= g.x) AS lx,
  (SELECT min_by(y, p.x) FROM pts p WHERE p.lang = g.lang AND p.x >= g.x) AS hy, (SELECT min(p.x) FROM pts p WHERE p.lang = g.lang AND p.x >= g.x) AS hx FROM grid g)
 SELECT lang, x, {r('coalesce(ly + (hy - ly) * (x - lx) / nullif(hx - lx, 0), ly, hy)', 'y')} FROM b""")
def interpolated_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = curves.roc(scored(spark, sf_dir), ["lang"]).where("fpr is not null and tpr is not null")
    return curves.interpolated(points, ["lang"], "fpr", "tpr", 20).select("lang", "x", (F.round("y", 6) + F.lit(0.0)).alias("y"))
