"""ROC and precision-recall curves: equal scores are one step, so groups are summed before any window."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.clean import ratio

from .ranges import rejoined, running_sums


def steps(rows: DataFrame, by: list[str], label: str = "y", score: str = "score") -> DataFrame:
    """True and false positives before and at each distinct score from the highest down, with their totals."""
    each = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    s = running_sums(each.withColumn("_down", -F.col(score)), by, "_down", ["pos", "neg"])
    return s.select(*by, score, F.col("before_pos").alias("tp0"), F.col("before_neg").alias("fp0"), (F.col("before_pos") + F.col("pos")).alias("tp"), (F.col("before_neg") + F.col("neg")).alias("fp"), F.col("all_pos").alias("p"), F.col("all_neg").alias("n"))


def roc(rows: DataFrame, by: list[str], label: str = "y", score: str = "score") -> DataFrame:
    """Points of the ROC curve but for (0, 0); rates are null if a class is empty."""
    s = steps(rows, by, label, score)
    return s.select(*by, score, ratio("fp", F.nullif("n", F.lit(0))).alias("fpr"), ratio("tp", F.nullif("p", F.lit(0))).alias("tpr"))


def areas(rows: DataFrame, by: list[str], label: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve, under the precision-recall curve (from (0, 1), trapezoids), and average precision."""
    rate = lambda a, b: ratio(F.col(a), F.nullif(F.col(b), F.lit(0)))
    seen = F.col("tp0") + F.col("fp0")
    s = steps(rows, by, label, score).withColumns({
        "fpr": rate("fp", "n"), "tpr": rate("tp", "p"), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "fpr0": rate("fp0", "n"), "tpr0": rate("tp0", "p"), "precision0": F.when(seen == 0, 1.0).otherwise(ratio(F.col("tp0"), seen)),
    })
    step = F.col("tpr") - F.col("tpr0")
    return s.groupBy(*by).agg(
        F.max("p").alias("positives"), F.max("n").alias("negatives"),
        F.when((F.max("p") > 0) & (F.max("n") > 0), F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2)).alias("auroc"),
        F.when(F.max("p") > 0, F.sum(step * (F.col("precision") + F.col("precision0")) / 2)).alias("auprc"),
        F.when(F.max("p") > 0, F.sum(step * F.col("precision"))).alias("average_precision"),
    )


def interpolated(points: DataFrame, by: list[str], x: str, y: str, cells: int = 200) -> DataFrame:
    """y at cells + 1 even places of [0, 1]: the highest y of equal x, straight lines, edges held.

    Points are first summed up to the lowest and the highest of each cell between two places, so that what is
    ordered in a group is its cells, not its points.
    """
    one = points.groupBy(*by, x).agg(F.max(y).alias("_y")).select(*by, F.col(x).cast("double").alias("_x"), "_y").where("_x is not null and _y is not null")
    near = F.floor(F.col("_x") * cells)
    cell = F.when(F.col("_x") < near / float(cells), near - 1).when(F.col("_x") >= (near + 1) / float(cells), near + 1).otherwise(near).cast("int")
    at = F.struct("_x", "_y")
    sums = one.groupBy(*by, F.greatest(F.lit(-1), F.least(F.lit(cells), cell)).alias("_i")).agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    grid = points.select(*by).distinct().withColumn("_i", F.explode(F.sequence(F.lit(-1), F.lit(cells))))
    rows = rejoined(grid, sums, [*by, "_i"], "left").withColumn("_place", F.col("_i") / float(cells))
    own = Window.partitionBy(*by).orderBy("_i")
    exact = F.when(F.col("_low._x") == F.col("_place"), F.col("_low"))
    lo = F.coalesce(exact, F.last("_high", True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    hi = F.first("_low", True).over(own.rowsBetween(0, Window.unboundedFollowing))
    both = rows.withColumns({"lo": lo, "hi": hi}).where("_i >= 0")
    line = F.col("lo._y") + (F.col("hi._y") - F.col("lo._y")) * ratio(F.col("_place") - F.col("lo._x"), F.nullif(F.col("hi._x") - F.col("lo._x"), F.lit(0.0)))
    return both.select(*by, F.col("_place").alias("x"), F.coalesce(line, "lo._y", "hi._y").alias("y"))


def method_areas(rows: DataFrame, methods: Mapping[str, str], by: list[str], label: str = "y") -> DataFrame:
    """areas of each method in each group of `by` and over all ("all"), with the rate of positives that a blind guess has.

    methods: name to score column; a row without a method's score doesn't count for it.
    """
    scores = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), F.col(c).cast("double").alias("score")) for n, c in methods.items())))
    long = rows.select(*by, F.col(label).alias("y"), scores.alias("s")).select(*by, "y", "s.method", "s.score").where("score is not null")
    whole = long.select(*(F.lit("all").alias(c) for c in by), "y", "method", "score")
    both = long.select(*(F.col(c).cast("string").alias(c) for c in by), "y", "method", "score").unionByName(whole)
    out = areas(both, ["method", *by])
    return out.withColumn("positive_rate", ratio("positives", F.nullif(F.col("positives") + F.col("negatives"), F.lit(0))))
