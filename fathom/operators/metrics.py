"""Region metrics of predicted displacements, their summaries and paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.clean import ratio
from fathom.functions.vector import cosine, dot, minus, norm, vector

from .ranges import quantiles_of, rejoined, with_quantiles


def joined_predictions(residues: DataFrame, predictions: DataFrame, strict: bool = False) -> DataFrame:
    """residues with px, py, pz; a missing prediction is the zero vector, or an error if strict."""
    out = residues.join(predictions, ["sample_id", "idx"], "left")
    if strict:
        for c in ("px", "py", "pz"):
            out = out.withColumn(c, F.coalesce(c, F.raise_error(F.lit("prediction missing")).cast("double")))
        return out
    return out.fillna(0.0, ["px", "py", "pz"])


def region_metric_columns(moving: float = 1.0) -> list[Column]:
    """Aggregates over residues with target tx, ty, tz and prediction px, py, pz."""
    t, p = vector("tx", "ty", "tz"), vector("px", "py", "pz")
    e = minus(p, t)
    tn, pn, en = norm(t), norm(p), norm(e)
    rms = lambda v: F.sqrt(F.avg(dot(v, v)))
    better = F.avg((en < tn).cast("double"))
    return [
        F.count("*").alias("n"),
        rms(t).alias("target_rms"), F.avg(tn).alias("target_mean"),
        rms(p).alias("predicted_rms"), F.avg(pn).alias("predicted_mean"),
        rms(e).alias("error_rms"), F.avg(en).alias("error_mean"), rms(t).alias("zero_rms"),
        (rms(t) - rms(e)).alias("improvement"),
        ratio(rms(t) - rms(e), F.nullif(rms(t), F.lit(0.0))).alias("improvement_fraction"),
        (1 - ratio(F.avg(dot(e, e)), F.nullif(F.avg(dot(t, t)), F.lit(0.0)))).alias("mse_improvement_fraction"),
        better.alias("better_than_zero_rate"), (1 - better).alias("worse_than_zero_rate"),
        F.avg(F.abs(pn - tn)).alias("magnitude_mae"),
        F.avg(F.when(tn >= moving, cosine(p, t))).alias("direction_cosine"),
    ]


def region_metrics(rows: DataFrame, by: list[str], moving: float = 1.0) -> DataFrame:
    """One row for each group of the keys in by."""
    return rows.groupBy(*by).agg(*region_metric_columns(moving))


def pooled_and_by_sample(rows: DataFrame, moving: float = 1.0) -> DataFrame:
    """Metrics of each sample and region, and pooled over all residues of a region: one pass of grouping sets."""
    keys = [F.col("region"), F.col("sample_id")]
    out = rows.groupingSets([[F.col("region"), F.col("sample_id")], [F.col("region")]], *keys).agg(F.grouping("sample_id").cast("int").alias("pooled"), *region_metric_columns(moving))
    return out.withColumn("scope", F.when(F.col("pooled") == 1, "pooled").otherwise("sample")).drop("pooled")


def with_core(rows: DataFrame, by: list[str], core: str = "barrel_core", column: str = "error_rms", name: str = "core_rms") -> DataFrame:
    """rows (one for each region of a group) with the core region's value on every row of the group; null without a core."""
    return rows.withColumn(name, F.max(F.when(F.col("region") == core, F.col(column))).over(Window.partitionBy(*by)))


def summary_by_region(samples: DataFrame) -> DataFrame:
    """Over the samples of each region; sample_count counts all, the rest what is finite."""
    out = samples.groupBy("region").agg(
        F.count("*").alias("sample_count"),
        F.avg((F.col("improvement") > 0).cast("double")).alias("improvement_rate"),
        F.avg((F.col("improvement") < 0).cast("double")).alias("worse_rate"),
        F.avg("improvement").alias("improvement_mean"), F.avg("error_rms").alias("error_mean"),
        F.avg("zero_rms").alias("zero_mean"), F.avg("mse_improvement_fraction").alias("mse_gain_mean"),
    )
    return rejoined(out, quantiles_of(samples, ["region"], {"improvement": {"improvement_median": 0.5}, "error_rms": {"error_median": 0.5}}), ["region"], "left")


def paired_deltas(samples: DataFrame, method: str = "error_rms", raw: str = "zero_rms") -> DataFrame:
    return samples.withColumn("delta", F.col(method) - F.col(raw))


def delta_summary(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Improved means a negative difference; only an exact 0 ties."""
    d = F.col("delta")
    deltas = deltas.where(d.isNotNull())
    out = deltas.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(d < 0).alias("n_improved"), F.count_if(d > 0).alias("n_worsened"), F.count_if(d == 0).alias("n_tied"),
        F.avg((d < 0).cast("double")).alias("fraction_improved"), F.avg(d).alias("mean_delta"),
    )
    return with_quantiles(out, deltas, by, "delta", {"median_delta": 0.5})


def centroids(rows: DataFrame, by: list[str], prefix: str = "") -> DataFrame:
    return rows.groupBy(*by).agg(*(F.avg(c).alias(f"{prefix}{c}") for c in ("tx", "ty", "tz")))


def exposure_state(delta: Column, threshold: float) -> Column:
    """Three states around +- threshold, both ends inclusive; missing where the difference isn't finite."""
    finite = delta.isNotNull() & ~F.isnan(delta) & (F.abs(delta) < float("inf"))
    return F.when(~finite, "missing").when(delta >= threshold, "exposed_like").when(delta <= -threshold, "buried_like").otherwise("unchanged")


def state_metrics(rows: DataFrame, threshold: float) -> DataFrame:
    """A row for each sample that has a box and a barrel: how far the box's centre moves, and towards what state.

    rows: sample_id, region (a residue once for each of its regions), position x, y, z, displacement tx, ty, tz and
    its prediction px, py, pz. The plug's reference is plug_core where there is one, else plug. Angles and distances
    that aren't defined are null. The extension_* fields are the metrics of region plug_extension_nt, null without it.
    """
    def centre(region: str, *more: str) -> tuple[Column, Column, Column]:
        return tuple(F.avg(F.when(F.col("region") == region, sum((F.col(m + c) for m in more), F.col(c)))) for c in "xyz")

    parts = {"b0": centre("tonb_box"), "bt": centre("tonb_box", "t"), "bp": centre("tonb_box", "p"), "ref": centre("barrel_core"), "pc": centre("plug_core"), "pl": centre("plug")}
    aggs = [F.count_if(F.col("region") == "tonb_box").alias("n_box"), F.count_if(F.col("region") == "barrel_core").alias("n_barrel")]
    outside = F.when(F.col("region") == "plug_extension_nt", F.lit(1))
    t, p = vector("tx", "ty", "tz"), vector("px", "py", "pz")
    of = lambda v: F.avg(F.when(outside.isNotNull(), v))
    error = minus(p, t)
    aggs += [F.nullif(F.count(outside), F.lit(0)).alias("extension_n"), of(dot(t, t)).alias("ext_t"), of(dot(error, error)).alias("ext_e"), of(cosine(p, t)).alias("extension_direction_cosine")]
    sums = rows.groupBy("sample_id").agg(*aggs, *(v.alias(f"{k}{c}") for k, vs in parts.items() for c, v in zip("xyz", vs, strict=True))).where("n_box > 0 and n_barrel > 0")
    sums = sums.withColumns({f"plug{c}": F.coalesce(f"pc{c}", f"pl{c}") for c in "xyz"})
    at = lambda k: vector(*(f"{k}{c}" for c in "xyz"))
    far = lambda a, b: norm(minus(at(a), at(b)))
    angle = lambda u, v: F.when((norm(u) > 1e-8) & (norm(v) > 1e-8), dot(u, v) / (norm(u) * norm(v)))
    moved, guess = minus(at("bt"), at("b0")), minus(at("bp"), at("b0"))
    change = {k: far(k, "ref") - far("b0", "ref") for k in ("bt", "bp")}
    out = sums.select(
        "sample_id", F.col("n_box").alias("n_residues"), norm(moved).alias("target_displacement"), norm(guess).alias("predicted_displacement"), norm(minus(guess, moved)).alias("displacement_error"),
        angle(guess, moved).alias("displacement_cosine"), far("b0", "ref").alias("start_distance"), far("bt", "ref").alias("target_distance"), far("bp", "ref").alias("predicted_distance"),
        change["bt"].alias("target_exposure"), change["bp"].alias("predicted_exposure"), (change["bp"] - change["bt"]).alias("exposure_error"),
        exposure_state(change["bt"], threshold).alias("target_state"), exposure_state(change["bp"], threshold).alias("predicted_state"),
        angle(minus(at("bt"), at("ref")), minus(at("b0"), at("ref"))).alias("target_axis_cosine"), angle(minus(at("bp"), at("ref")), minus(at("bt"), at("ref"))).alias("predicted_axis_cosine"),
        (far("bt", "plug") - far("b0", "plug")).alias("target_plug_change"), (far("bp", "plug") - far("b0", "plug")).alias("predicted_plug_change"),
        F.col("extension_n").alias("extension_n_residues"), F.sqrt("ext_t").alias("extension_target_rms"), F.sqrt("ext_e").alias("extension_error_rms"),
        (1 - ratio(F.col("ext_e"), F.nullif("ext_t", F.lit(0.0)))).alias("extension_mse_improvement_fraction"), "extension_direction_cosine",
    )
    return out.withColumns({"direction_compatible": F.coalesce(F.col("displacement_cosine") >= 0.5, F.lit(False)), "state_correct": F.col("target_state") == F.col("predicted_state"), "plug_change_error": F.col("predicted_plug_change") - F.col("target_plug_change")})


#: What a summary of states averages.
STATE_FIELDS = ("target_displacement", "predicted_displacement", "displacement_error", "displacement_cosine", "target_exposure", "predicted_exposure", "exposure_error", "predicted_axis_cosine", "extension_error_rms", "extension_mse_improvement_fraction")


def state_summary(states: DataFrame, by: list[str]) -> DataFrame:
    """Mean and median of each field, rates, and the counts of each pair of states ("target->predicted") in order."""
    counts = states.groupBy(*by, F.concat_ws("->", "target_state", "predicted_state").alias("pair")).agg(F.count("*").alias("n"))
    confusion = counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", "n")))).alias("confusion"))
    means = [f(c).alias(f"{c}_{n}") for c in STATE_FIELDS for n, f in (("mean", F.avg),)]
    rates = [F.avg(F.col(c).cast("double")).alias(n) for c, n in (("state_correct", "state_accuracy"), ("direction_compatible", "direction_compatible_rate"))]
    out = states.groupBy(*by).agg(F.count("*").alias("n_targets"), *means, *rates)
    out = rejoined(out, quantiles_of(states, by, {c: {f"{c}_median": 0.5} for c in STATE_FIELDS}), by, "left")
    return out.join(confusion, by) if by else out.crossJoin(confusion)


def fitted_scale(rows: DataFrame, by: list[str], most: float = 2.0, least_residues: int = 3) -> DataFrame:
    """Least squares through the origin of target on prediction, within 0 and most; 1 for too few residues."""
    t, p = vector("tx", "ty", "tz"), vector("px", "py", "pz")
    s = ratio(F.sum(dot(p, t)), F.nullif(F.sum(dot(p, p)), F.lit(0.0)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") < least_residues, 1.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(most), s)), F.lit(1.0))).alias("scale"))
