"""Errors of predicted displacements by range and by confidence, from sums that merge over batches.

rows: target tx, ty, tz, prediction px, py, pz. Means are over components, three for each residue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.clean import ratio
from fathom.functions.vector import dot, minus, norm, vector


def sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, sse, sae and baseline_sse (of no displacement) of each group; rows of two batches add up."""
    t, p = vector("tx", "ty", "tz"), vector("px", "py", "pz")
    e = minus(p, t)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(dot(e, e)).alias("sse"), F.sum(F.abs(e[0]) + F.abs(e[1]) + F.abs(e[2])).alias("sae"), F.sum(dot(t, t)).alias("baseline_sse"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """mse, rmsd, mae, baseline_mse, baseline_rmsd and the share of the baseline's error that is gone, from the sums of all batches."""
    s = parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "sse", "sae", "baseline_sse")))
    cells = 3.0 * F.col("n")
    mse, base = ratio(F.col("sse"), cells), ratio(F.col("baseline_sse"), cells)
    return s.select(*by, "n", mse.alias("mse"), F.sqrt(mse).alias("rmsd"), ratio(F.col("sae"), cells).alias("mae"), base.alias("baseline_mse"), F.sqrt(base).alias("baseline_rmsd"), (1 - ratio(F.col("sse"), F.nullif("baseline_sse", F.lit(0.0)))).alias("gain"))


def in_ranges(rows: DataFrame, ranges: Sequence[tuple[str, float, float]]) -> DataFrame:
    """rows once for each (name, low, high) with low <= size of the target < high; ranges may overlap."""
    size = norm(vector("tx", "ty", "tz"))
    names = F.filter(F.array(*(F.when((size >= lo) & (size < hi), n) for n, lo, hi in ranges)), lambda x: x.isNotNull())
    return rows.withColumn("range", F.explode(names))


def confidence_bin(confidence: Column, edges: Sequence[float] = (0, 60, 70, 80, 90, 100)) -> Column:
    """"<low>to<high>" of the bin, the last one with its upper end; null outside."""
    out = None
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        test = (confidence >= lo) & ((confidence <= hi) if hi == edges[-1] else (confidence < hi))
        out = F.when(test, f"{lo}to{hi}") if out is None else out.when(test, f"{lo}to{hi}")
    return out


def selection_metric(rows: DataFrame, by: list[str], low: float = 1.0, middle: float = 2.0, high: float = 5.0, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """The weighted mean of the errors in [low, middle) and [low, high); null where one of them has no residue.

    Weights without a positive sum are divided by 1.
    """
    t, p = vector("tx", "ty", "tz"), vector("px", "py", "pz")
    e, size, total = minus(p, t), norm(t), sum(weights) if sum(weights) > 0 else 1.0
    mse = lambda top: F.avg(F.when((size >= low) & (size < top), dot(e, e))) / 3.0
    return rows.groupBy(*by).agg(mse(middle).alias("mse_near"), mse(high).alias("mse_all")).withColumn("selection", (weights[0] * F.col("mse_near") + weights[1] * F.col("mse_all")) / total)
