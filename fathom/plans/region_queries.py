"""Queries over residues, regions and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.operators import baselines, metrics, regions, splits, stats
from fathom.registry import query

from .virtual import SQL_BRIDGE, SQL_REGION, SQL_RES, SQL_ROWS, bridge, predicted, primary, r, residues, tidy

_T, _P, _E = "tx*tx+ty*ty+tz*tz", "px*px+py*py+pz*pz", "(px-tx)*(px-tx)+(py-ty)*(py-ty)+(pz-tz)*(pz-tz)"
_COS = f"(px*tx+py*ty+pz*tz) / (greatest(sqrt({_P}), 1e-8) * greatest(sqrt({_T}), 1e-8))"
_METRICS = ", ".join([
    "count(*) AS n", r(f"sqrt(avg({_T}))", "target_rms"), r(f"avg(sqrt({_T}))", "target_mean"), r(f"sqrt(avg({_P}))", "predicted_rms"), r(f"avg(sqrt({_P}))", "predicted_mean"),
    r(f"sqrt(avg({_E}))", "error_rms"), r(f"avg(sqrt({_E}))", "error_mean"), r(f"sqrt(avg({_T}))", "zero_rms"), r(f"sqrt(avg({_T})) - sqrt(avg({_E}))", "improvement"),
    r(f"(sqrt(avg({_T})) - sqrt(avg({_E}))) / nullif(sqrt(avg({_T})), 0)", "improvement_fraction"), r(f"1 - avg({_E}) / nullif(avg({_T}), 0)", "mse_improvement_fraction"),
    r(f"avg((sqrt({_E}) < sqrt({_T}))::INT)", "better_than_zero_rate"), r(f"1 - avg((sqrt({_E}) < sqrt({_T}))::INT)", "worse_than_zero_rate"),
    r(f"avg(abs(sqrt({_P}) - sqrt({_T})))", "magnitude_mae"), r(f"avg(CASE WHEN sqrt({_T}) >= 0.2 THEN {_COS} END)", "direction_cosine"),
])


@query("region_metrics", f"WITH {SQL_BRIDGE} SELECT region, {_METRICS} FROM br GROUP BY region")
def region_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.region_metrics(bridge(predicted(spark, sf_dir)), ["region"], 0.2))


@query("region_metrics_scopes", f"WITH {SQL_BRIDGE} SELECT region, sample_id, CASE WHEN grouping(sample_id) = 1 THEN 'pooled' ELSE 'sample' END AS scope, {_METRICS} FROM br GROUP BY GROUPING SETS ((region, sample_id), (region))")
def region_metrics_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.pooled_and_by_sample(bridge(predicted(spark, sf_dir)), 0.2))


_SAMPLES = SQL_BRIDGE + f""", s AS (SELECT sample_id, region, sqrt(avg({_T})) AS zero_rms, sqrt(avg({_E})) AS error_rms, sqrt(avg({_T})) - sqrt(avg({_E})) AS improvement,
  1 - avg({_E}) / nullif(avg({_T}), 0) AS gain FROM br GROUP BY ALL)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.region_metrics(bridge(predicted(spark, sf_dir)), ["sample_id", "region"], 0.2)


@query("sample_region_summary", f"""WITH {_SAMPLES} SELECT region, count(*) AS sample_count, {r('avg((improvement > 0)::INT)', 'improvement_rate')}, {r('avg((improvement < 0)::INT)', 'worse_rate')},
 {r('avg(improvement)', 'improvement_mean')}, {r('median(improvement)', 'improvement_median')}, {r('avg(error_rms)', 'error_mean')}, {r('median(error_rms)', 'error_median')}, {r('avg(zero_rms)', 'zero_mean')}, {r('avg(gain)', 'mse_gain_mean')} FROM s GROUP BY region""")
def sample_region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.summary_by_region(_samples(spark, sf_dir)))


@query("paired_delta_summary", f"""WITH {_SAMPLES}, d AS (SELECT region, error_rms - zero_rms AS delta FROM s) SELECT region, count(*) AS n, count(*) FILTER (delta < 0) AS n_improved, count(*) FILTER (delta > 0) AS n_worsened,
 count(*) FILTER (delta = 0) AS n_tied, {r('avg((delta < 0)::INT)', 'fraction_improved')}, {r('avg(delta)', 'mean_delta')}, {r('median(delta)', 'median_delta')} FROM d GROUP BY region""")
def paired_delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.delta_summary(metrics.paired_deltas(_samples(spark, sf_dir)), ["region"]))


@query("signed_rank_effect", f"""WITH {_SAMPLES}, d AS (SELECT region, round(error_rms - zero_rms, 4) AS delta FROM s), k AS (SELECT *, rank() OVER (PARTITION BY region ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY region, abs(delta)) - 1) / 2.0 AS rk FROM d WHERE abs(delta) > 1e-12),
 w AS (SELECT region, count(*) AS n_nonzero, sum(CASE WHEN delta > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN delta < 0 THEN rk ELSE 0 END) AS wm FROM k GROUP BY region)
 SELECT region, n_nonzero, {r('wp', 'w_plus')}, {r('wm', 'w_minus')}, {r('(wm - wp) / (wm + wp)', 'effect')} FROM w""")
def signed_rank_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.paired_deltas(_samples(spark, sf_dir)).withColumn("delta", F.round("delta", 4))
    return tidy(stats.signed_ranks(d, ["region"]).drop("ties"))


@query("paired_tests")
def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilcoxon p-values and bootstrap intervals by region."""
    return tidy(stats.paired_tests(metrics.paired_deltas(_samples(spark, sf_dir)), "region", "sample_id"))


@query("exclusive_regions", f"""WITH {SQL_BRIDGE}, k AS (SELECT sample_id, idx, region, row_number() OVER (PARTITION BY sample_id, idx ORDER BY list_position(['eval', 'plug', 'barrel_core'], region)) AS k FROM br WHERE region IN ('eval', 'plug', 'barrel_core'))
 SELECT region, count(*) AS n, sum(idx)::BIGINT AS places FROM k WHERE k = 1 GROUP BY region""")
def exclusive_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.by_priority(bridge(predicted(spark, sf_dir)).select("sample_id", "idx", "region"), ["eval", "plug", "barrel_core"])
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("idx").alias("places"))


@query("derived_plug_regions", f"""WITH {SQL_RES}, f AS (SELECT sample_id, idx, row_number() OVER (PARTITION BY sample_id ORDER BY idx) AS up FROM residue WHERE {SQL_REGION} = 'plug'),
 g AS (SELECT *, sum((up > 3)::INT) OVER (PARTITION BY sample_id ORDER BY idx DESC) AS down, sum((up > 3)::INT) OVER (PARTITION BY sample_id) AS m FROM f)
 SELECT sample_id, idx, CASE WHEN up <= 3 THEN 'plug_n_terminal' WHEN down <= ceil(m * 0.5) THEN 'plug_apical' ELSE 'plug_core' END AS region FROM g""")
def derived_plug_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge(residues(spark, sf_dir)).select("sample_id", "idx", "region")
    return regions.derived_plug_regions(rows)


@query("region_centroids", f"WITH {SQL_BRIDGE} SELECT sample_id, region, {r('avg(tx)', 'tx')}, {r('avg(ty)', 'ty')}, {r('avg(tz)', 'tz')} FROM br GROUP BY ALL")
def region_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.centroids(bridge(predicted(spark, sf_dir)), ["sample_id", "region"]))


@query("exposure_states", f"""WITH {SQL_ROWS}, c AS (SELECT sample_id, avg(tx) FILTER ({SQL_REGION} = 'tonb_box') - avg(tx) FILTER ({SQL_REGION} = 'barrel_core') AS t, avg(px) FILTER ({SQL_REGION} = 'tonb_box') - avg(px) FILTER ({SQL_REGION} = 'barrel_core') AS p FROM both_rows GROUP BY sample_id),
 s AS (SELECT CASE WHEN t IS NULL THEN 'missing' WHEN t >= 0.05 THEN 'exposed_like' WHEN t <= -0.05 THEN 'buried_like' ELSE 'unchanged' END AS target_state, CASE WHEN p IS NULL THEN 'missing' WHEN p >= 0.05 THEN 'exposed_like' WHEN p <= -0.05 THEN 'buried_like' ELSE 'unchanged' END AS predicted_state FROM c)
 SELECT target_state, predicted_state, count(*) AS n FROM s GROUP BY ALL""")
def exposure_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of the three exposure states."""
    rows = predicted(spark, sf_dir).withColumn("region", primary(F.col("idx")))
    mean = lambda c, g: F.avg(F.when(F.col("region") == g, F.col(c)))
    d = rows.groupBy("sample_id").agg((mean("tx", "tonb_box") - mean("tx", "barrel_core")).alias("t"), (mean("px", "tonb_box") - mean("px", "barrel_core")).alias("p"))
    return d.groupBy(metrics.exposure_state(F.col("t"), 0.05).alias("target_state"), metrics.exposure_state(F.col("p"), 0.05).alias("predicted_state")).agg(F.count("*").alias("n"))


_DOT, _PP = "px*tx+py*ty+pz*tz", "px*px+py*py+pz*pz"


@query("fitted_scale", f"""WITH {SQL_BRIDGE} SELECT region, count(*) AS n, {r(f'greatest(0, least(2, sum({_DOT}) / nullif(sum({_PP}), 0)))', 'scale')} FROM br GROUP BY region""")
def fitted_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.fitted_scale(bridge(predicted(spark, sf_dir)), ["region"]))


@query("group_means", f"""WITH {SQL_BRIDGE} SELECT region, family, state, CASE grouping(family) * 2 + grouping(state) WHEN 0 THEN 'family_state' WHEN 1 THEN 'family' WHEN 2 THEN 'state' ELSE 'global' END AS level, count(*) AS n,
 {r('avg(tx)', 'mx')}, {r('avg(ty)', 'my')}, {r('avg(tz)', 'mz')} FROM br GROUP BY GROUPING SETS ((region, family, state), (region, family), (region, state), (region))""")
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = baselines.group_means(bridge(predicted(spark, sf_dir)))
    return tidy(out.withColumn("family", F.col("family").cast("int"))).withColumn("family", F.col("family").cast("int"))


@query("fallback_levels", f"""WITH {SQL_RES}, b AS (SELECT *, {SQL_REGION} AS region FROM residue), fit AS (SELECT * FROM b WHERE sample_id % 4 <> 0 AND NOT (family % 3 = 0 AND state = 1) AND NOT family % 5 = 4),
 t AS (SELECT * FROM b WHERE sample_id % 4 = 0), fs AS (SELECT DISTINCT region, family, state FROM fit), f AS (SELECT DISTINCT region, family FROM fit), s AS (SELECT DISTINCT region, state FROM fit)
 SELECT t.region, CASE WHEN fs.region IS NOT NULL THEN 'family_state' WHEN f.region IS NOT NULL THEN 'family' WHEN s.region IS NOT NULL THEN 'state' ELSE 'global' END AS level, count(*) AS n
 FROM t LEFT JOIN fs USING (region, family, state) LEFT JOIN f ON t.region = f.region AND t.family = f.family LEFT JOIN s ON t.region = s.region AND t.state = s.state GROUP BY ALL""")
def fallback_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far down the hierarchy each held-out residue's prediction comes from."""
    rows = residues(spark, sf_dir).withColumn("region", primary(F.col("idx")))
    fit = rows.where("sample_id % 4 <> 0 and not (family % 3 = 0 and state = 1) and not family % 5 = 4")
    out = baselines.with_fallback(rows.where("sample_id % 4 = 0"), baselines.group_means(fit))
    return out.groupBy("region", "level").agg(F.count("*").alias("n"))


@query("region_blend", f"""WITH {SQL_ROWS}, o AS (SELECT *, {SQL_REGION} AS region FROM both_rows) SELECT region, count(*) AS n, {r("sum(CASE region WHEN 'plug' THEN px * 0.5 WHEN 'barrel_core' THEN tx ELSE 0 END)", 'sum_px')} FROM o GROUP BY region""")
def region_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir)
    own = rows.select("sample_id", "idx", F.col("tx").alias("px"), F.col("ty").alias("py"), F.col("tz").alias("pz"))
    sources = {"plug": (rows.select("sample_id", "idx", "px", "py", "pz"), 0.5), "barrel_core": (own, 1.0)}
    out = baselines.blend(sources, bridge(rows).where("region <> 'eval'").select("sample_id", "idx", "region"), ["plug", "barrel_core", "tonb_box", "extracellular_loop"])
    return tidy(out.groupBy("region").agg(F.count("*").alias("n"), F.sum("px").alias("sum_px")))


@query("clipped_predictions", f"""WITH {SQL_ROWS}, c AS (SELECT sample_id, idx, least(1, 0.2 / greatest(sqrt({_P}), 1e-8)) AS s, px FROM both_rows) SELECT sample_id, idx, {r('px * s', 'px')} FROM c""")
def clipped_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(baselines.clipped(predicted(spark, sf_dir), 0.2).select("sample_id", "idx", "px"))


@query("normalised_scores", f"""WITH {SQL_RES}, m AS (SELECT sample_id, idx, tx, min(tx) OVER (PARTITION BY sample_id) AS lo, max(tx) OVER (PARTITION BY sample_id) AS hi FROM residue) SELECT sample_id, idx, {r('coalesce((tx - lo) / nullif(hi - lo, 0), 0)', 'normalised')} FROM m""")
def normalised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(baselines.normalised(residues(spark, sf_dir), "tx", ["sample_id"]).select("sample_id", "idx", "normalised"))


@query("hash_split", """WITH k AS (SELECT vec_id, (('0x' || substr(sha256((vec_id // 10)::VARCHAR), 1, 8))::BIGINT) % 100 AS p FROM embeddings) SELECT vec_id, CASE WHEN p < 70 THEN 'train' WHEN p < 85 THEN 'val' ELSE 'test' END AS split FROM k""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / 10).cast("bigint").alias("g"))
    return rows.select("vec_id", splits.hash_split("g").alias("split"))


@query("rank_split", """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey) AS k, count(*) OVER () AS n FROM orders),
 c AS (SELECT *, greatest(1, round_even(n * 0.7, 0)) AS a, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.15, 0)) ELSE 0 END AS b FROM k),
 f AS (SELECT *, n >= 3 AND a + b >= n AS tight FROM c), e AS (SELECT o_orderkey, k, CASE WHEN tight THEN n - 2 ELSE a END AS a, CASE WHEN tight THEN 1 ELSE b END AS b FROM f)
 SELECT o_orderkey, CASE WHEN k <= a THEN 'train' WHEN k <= a + b THEN 'val' ELSE 'test' END AS split FROM e""")
def rank_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.rank_split(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey").select("o_orderkey", "split")


@query("split_leakage", """WITH s AS (SELECT c_nationkey, CASE WHEN p < 70 THEN 'train' WHEN p < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT c_nationkey, (('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT) % 100 AS p FROM customer))
 SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits, count(*) AS n FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("split", splits.hash_split("c_custkey"))
    return splits.leaks(rows, "c_nationkey").withColumn("splits", F.array_join("splits", ","))


@query("node_loss_weights", f"""WITH {SQL_ROWS}, w AS (SELECT sample_id, idx, CASE WHEN idx < 8 THEN 0.1 WHEN idx < 15 THEN 2.0 WHEN idx < 18 THEN 3.0 ELSE 0.3 END AS w FROM both_rows) SELECT sample_id, idx, {r('w / greatest(avg(w) OVER (PARTITION BY sample_id), 1e-8)', 'weight')} FROM w""")
def node_loss_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("idx")
    w = predicted(spark, sf_dir).withColumn("w", F.when(i < 8, 0.1).when(i < 15, 2.0).when(i < 18, 3.0).otherwise(0.3))
    return tidy(w.select("sample_id", "idx", (F.col("w") / F.greatest(F.avg("w").over(Window.partitionBy("sample_id")), F.lit(1e-8))).alias("weight")))


@query("displacement_group_errors", f"""WITH {SQL_ROWS}, g AS (SELECT *, CASE WHEN sqrt({_T}) < 0.1 THEN '0to0p1' WHEN sqrt({_T}) < 0.2 THEN '0p1to0p2' ELSE 'gt0p2' END AS bin FROM both_rows)
 SELECT bin, count(*) AS n, {r(f'sum({_E}) / (3 * count(*))', 'mse')}, {r(f'sqrt(sum({_E}) / (3 * count(*)))', 'rmsd')}, {r('sum(abs(px-tx)+abs(py-ty)+abs(pz-tz)) / (3 * count(*))', 'mae')}, {r(f'1 - sum({_E}) / nullif(sum({_T}), 0)', 'relative_gain')} FROM g GROUP BY bin""")
def displacement_group_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled errors over components by the size of the target."""
    from fathom.functions.clean import binned
    from fathom.functions.vector import dot, minus, norm, vector

    t, p = vector("tx", "ty", "tz"), vector("px", "py", "pz")
    e = minus(p, t)
    rows = predicted(spark, sf_dir).withColumn("bin", binned(norm(t), [0, 0.1, 0.2]))
    mse = F.sum(dot(e, e)) / (3 * F.count("*"))
    return tidy(rows.groupBy("bin").agg(F.count("*").alias("n"), mse.alias("mse"), F.sqrt(mse).alias("rmsd"), (F.sum(F.abs(e[0]) + F.abs(e[1]) + F.abs(e[2])) / (3 * F.count("*"))).alias("mae"), (1 - F.try_divide(F.sum(dot(e, e)), F.sum(dot(t, t)))).alias("relative_gain")))
