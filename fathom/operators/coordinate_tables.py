"""Tables of coordinate metrics from nested JSON reports whose keys aren't known beforehand.

A report holds metrics by region, and for each sample again metrics by region. Its text is parsed once into a
variant; regions and samples are exploded by whatever keys they have, so a new region or method needs no schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import rejoined
from .stats import bootstrap_intervals

#: The numbers of a region that a report may hold, and those that are counts.
COUNTS = ("n_residues", "sample_count")
METRICS = (
    "zero_error_rms", "prediction_error_rms", "target_displacement_rms", "predicted_displacement_mean", "mse_improvement_vs_zero_fraction",
    "better_than_zero_rate", "direction_cosine_mean", "sample_improvement_rate", "sample_improvement_mean", "sample_improvement_median",
)
_ID = ["method", "label", "category", "source"]
_BARE = r"(?<=[:,\[\s])(-?Infinity|NaN)(?=[\s,\]}]|$)"


def parsed(body: str) -> Column:
    """The text as a variant, null if it isn't JSON; bare NaN and Infinity, which other writers leave, are null."""
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_replace(body, _BARE, "null")))


def exploded(rows: DataFrame, variant: str, path: str, keep: Sequence[str]) -> DataFrame:
    """keep, key and value of every entry of the object or list at a path of a variant; none where it isn't there."""
    view = rows.select(*keep, F.try_variant_get(variant, path, "variant").alias("_at")).where("_at is not null")
    return view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("_at").outer())).select(*keep, "key", "value")


def _number(path: str) -> Column:
    x = F.try_variant_get("value", f"$.{path}", "double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def region_metrics(reports: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Each report's metrics by region, for the regions that are known."""
    rows = exploded(reports.select(*_ID, parsed("body").alias("v")), "v", "$.aggregate_by_region", _ID).where(F.col("key").isin(*regions))
    return rows.select(*_ID, F.col("key").alias("region"), *(F.try_variant_get("value", f"$.{c}", "bigint").alias(c) for c in COUNTS), *(_number(c).alias(c) for c in METRICS))


def sample_metrics(reports: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Errors of each sample and region that has both, with the improvement over no displacement."""
    samples = exploded(reports.select(*_ID, parsed("body").alias("v")), "v", "$.samples", _ID)
    samples = samples.select(*_ID, F.coalesce(F.try_variant_get("value", "$.sample_id", "string"), F.lit("")).alias("sample_id"), "value")
    rows = exploded(samples, "value", "$.regions", [*_ID, "sample_id"]).where(F.col("key").isin(*regions))
    rows = rows.select(*_ID, "sample_id", F.col("key").alias("region"), *(_number(c).alias(c) for c in ("zero_error_rms", "prediction_error_rms", "mse_improvement_vs_zero_fraction")))
    rows = rows.where("zero_error_rms is not null and prediction_error_rms is not null")
    return rows.withColumn("sample_improvement", F.col("zero_error_rms") - F.col("prediction_error_rms"))


def coordinate_tables(reports: DataFrame, regions: Sequence[str], iterations: int = 5000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Aggregate and sample rows by method and region, the former with intervals of the mean and the rate of improvement.

    reports: method, label, category, source, body (JSON text; null or broken ones give no rows). Only regions
    with aggregate metrics have rows. Both intervals come from one pass over the samples, their draws from seed
    and seed + 17; a region without samples has none.
    """
    aggregate = region_metrics(reports, regions)
    by = [*_ID, "region"]
    samples = sample_metrics(reports, regions)
    samples = rejoined(samples, aggregate.select(*by).distinct().withColumn("_has", F.lit(True)), by).drop("_has")
    rows = samples.select(*by, "sample_improvement", (F.col("sample_improvement") > 0).cast("double").alias("improved"))
    ends = bootstrap_intervals(rows, by, {"mean": ("sample_improvement", seed), "rate": ("improved", seed + 17)}, iterations)
    ends = ends.select(*by, *(F.col(f"{n}_{e}").alias(f"sample_improvement_{n}_ci95_{e}") for n in ("mean", "rate") for e in ("low", "high")))
    return rejoined(aggregate, ends, by, "left"), samples


#: What a summary row takes from a region's metrics and from its paired differences.
_FROM_METRICS = {"prediction_error_rms": "prediction_error_rms", "raw_rmsd": "zero_error_rms", "mse_improvement_vs_zero_fraction": "mse_improvement_vs_zero_fraction", "predicted_displacement_mean": "predicted_displacement_mean"}
_FROM_PAIRS = ("n_targets", "n_improved", "n_worsened", "improved_fraction", "median_delta_rmsd_method_minus_raw", "median_delta_ci95_low", "median_delta_ci95_high", "wilcoxon_p_less_method_lt_raw", "signed_rank_biserial_effect_method_lt_raw")


def summary_rows(reports: DataFrame, regions: Sequence[str]) -> DataFrame:
    """A row for each method and region that has metrics or paired differences; what one of both lacks is null.

    A report without an effect among its paired differences may have it in a map of its own,
    paired_effect_by_region. Rows carry `region_order`, the region's place in `regions`.
    """
    body = reports.select(*_ID, parsed("body").alias("v"))
    by = [*_ID, "region"]
    part = lambda path: exploded(body, "v", path, _ID).where(F.col("key").isin(*regions)).withColumnRenamed("key", "region")
    own = part("$.aggregate_by_region").select(*by, *(_number(c).alias(n) for n, c in _FROM_METRICS.items()), F.lit(True).alias("_own"))
    pair = part("$.paired_delta_by_region").select(*by, *(_number(c).alias(c) for c in _FROM_PAIRS), F.lit(True).alias("_pair"))
    other = part("$.paired_effect_by_region").select(*by, F.try_variant_get("value", "$", "double").alias("_effect"))
    keys = own.select(*by).unionByName(pair.select(*by)).distinct()
    out = rejoined(rejoined(rejoined(keys, own, by, "left"), pair, by, "left"), other, by, "left")
    effect = _FROM_PAIRS[-1]
    out = out.withColumn(effect, F.coalesce(effect, "_effect")).drop("_own", "_pair", "_effect")
    return out.withColumn("region_order", F.array_position(F.array(*map(F.lit, regions)), F.col("region")))
