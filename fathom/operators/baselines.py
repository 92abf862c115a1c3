"""Model-free predictors: hierarchical means, priority blends, normalised scores, ridge regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.clean import ratio
from fathom.streaming.incremental import stored

from .ranges import rejoined, with_quantiles
from .regions import by_priority

LEVELS = (("family", "state"), ("family",), ("state",), ())


def group_means(rows: DataFrame, by_sample: bool = False) -> DataFrame:
    """Mean target vector and count of each region by family and state, each alone, and overall, in one pass."""
    keys = [F.col("region"), F.col("family"), F.col("state")]
    if by_sample:
        rows = rows.groupBy("sample_id", "region", "family", "state").agg(*(F.avg(c).alias(c) for c in ("tx", "ty", "tz")))
    out = rows.groupingSets([[F.col("region"), *map(F.col, level)] for level in LEVELS], *keys).agg(
        F.grouping_id("region", "family", "state").alias("level"), F.count("*").alias("n"), *(F.avg(c).alias(f"m{c[1]}") for c in ("tx", "ty", "tz")))
    return out.withColumn("level", F.element_at(F.create_map(F.lit(0), F.lit("family_state"), F.lit(1), F.lit("family"), F.lit(2), F.lit("state"), F.lit(3), F.lit("global")), F.col("level").cast("int")))


def with_fallback(targets: DataFrame, means: DataFrame) -> DataFrame:
    """Each target row's mean of the most special group that has one, and which it was; else zero."""
    out = targets
    for level in LEVELS:
        name = "_".join(level) or "global"
        own = means.where((F.col("level") == name) & (F.col("n") > 0)).select("region", *level, F.struct("mx", "my", "mz", F.lit(name).alias("level")).alias(f"m_{name}"))
        out = out.join(F.broadcast(own) if not level else own, ["region", *level], "left")
    picked = F.coalesce(*(f"m_{'_'.join(x) or 'global'}" for x in LEVELS))
    return out.select(*targets.columns, *(F.coalesce(picked[f"m{c}"], F.lit(0.0)).alias(f"p{c}") for c in "xyz"), F.coalesce(picked["level"], F.lit("zero")).alias("level"))


def targeted_shift(targets: DataFrame, fit: DataFrame, region: str) -> DataFrame:
    """targets with px, py, pz: in one region the mean of the fitted samples' centroid shifts, of the most special group
    that has one; zeros elsewhere. Both have sample_id, region, family, state; fit also tx, ty, tz."""
    means = group_means(fit.where(F.col("region") == region), by_sample=True)
    moved = with_fallback(targets.where(F.col("region") == region), means)
    still = targets.where(F.col("region") != region)
    return moved.unionByName(still, allowMissingColumns=True).fillna(0.0, ["px", "py", "pz"])


def calibrated_scales(validation: DataFrame, regions: Sequence[str], overrides: dict[str, float] | None = None, least_residues: int = 3) -> dict[str, float]:
    """A scale for each region: fitted on the validation rows (region, tx to tz, px to pz), 1 where it can't be, or what overrides says.

    A row for each region reaches the driver.
    """
    from .metrics import fitted_scale

    got = {r.region: float(r.scale) for r in fitted_scale(validation.where(F.col("region").isin(*regions)), ["region"], least_residues=least_residues).collect()}
    return {name: (overrides or {}).get(name, got.get(name, 1.0)) for name in regions}


def one_hot(rows: DataFrame, fit: DataFrame, column: str, most: int = 1000) -> tuple[DataFrame, list[str]]:
    """rows with a 0 or 1 column for each value that the fitted rows have, and the names; a value they lack has zeros only.

    More than `most` values are an error, as each is a column.
    """
    values = sorted(r[0] for r in fit.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    names = [f"{column}={v}" for v in values]
    return rows.select("*", *(F.coalesce((F.col(column).cast("string") == v).cast("double"), F.lit(0.0)).alias(n) for v, n in zip(values, names, strict=True))), names


def blend(sources: dict[str, tuple[DataFrame, float]], bridge: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each residue's prediction from the source of its first region in order, scaled; sources: region to (rows, scale)."""
    owner = by_priority(bridge, order)
    rows = [df.select("sample_id", "idx", F.lit(r).alias("region"), *((F.col(c) * F.lit(float(s))).alias(c) for c in ("px", "py", "pz"))) for r, (df, s) in sources.items()]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return owner.join(every, ["sample_id", "idx", "region"], "left").fillna(0.0, ["px", "py", "pz"])


def clipped(rows: DataFrame, most: float) -> DataFrame:
    length = F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz"))
    s = F.least(F.lit(1.0), F.lit(most) / F.greatest(length, F.lit(1e-8)))
    return rows.withColumns({c: F.col(c) * s for c in ("px", "py", "pz")})


def normalised(rows: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Scores from 0 to 1 in each group: the median for what isn't finite, 0 where all are equal."""
    clean = F.when(~F.isnan(score) & (F.abs(score) < float("inf")), F.col(score))
    out = rows.withColumn("_c", clean)
    ends = with_quantiles(out.groupBy(*by).agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")), out, by, "_c", {"_mid": 0.5})
    out = rejoined(out, stored(ends), by).withColumn("_c", F.coalesce("_c", "_mid"))
    scaled = ratio(F.col("_c") - F.col("_lo"), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    return out.withColumn("normalised", F.coalesce(scaled, F.lit(0.0))).drop("_c", "_lo", "_hi", "_mid")


def ridge(rows: DataFrame, features: Sequence[str], targets: Sequence[str], alpha: float = 1.0) -> pd.DataFrame:
    """Coefficients by feature (and intercept) of a ridge fit on standardised features, intercept not penalised.

    Spark sums the normal equations; the driver solves a system as large as the number of features.
    """
    names = [*features, *targets]
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(names))]
    s = rows.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in pairs)).first()
    n, k = s["n"], len(features)
    mean = np.array([s[f"s{i}"] for i in range(len(names))]) / n
    q = np.zeros((k, len(names)))
    for i, j in pairs:
        q[i, j] = s[f"q{i}_{j}"] / n - mean[i] * mean[j]
        if j < k:
            q[j, i] = q[i, j]
    sd = np.sqrt(np.maximum(np.diag(q[:, :k]), 0))
    sd[sd == 0] = 1
    a = q[:, :k] / np.outer(sd, sd) * n + alpha * np.eye(k)
    try:
        w = np.linalg.solve(a, q[:, k:] / sd[:, None] * n)
    except np.linalg.LinAlgError:
        w = np.linalg.pinv(a) @ (q[:, k:] / sd[:, None] * n)
    w = w / sd[:, None]
    return pd.DataFrame(np.vstack([w, mean[k:] - mean[:k] @ w]), index=[*features, "intercept"], columns=list(targets))


def linear(coefficients: pd.DataFrame, target: str) -> Column:
    out = F.lit(float(coefficients.loc["intercept", target]))
    for name in coefficients.index[:-1]:
        out = out + F.col(name) * F.lit(float(coefficients.loc[name, target]))
    return out
