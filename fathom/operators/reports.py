"""Summaries, counts, seed aggregates, pivots, quality flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import quantiles_of, rejoined, with_quantiles


def value_counts(rows: DataFrame, fields: Sequence[str], missing: str = "missing") -> DataFrame:
    """field, value, n of every field's cells; blanks are counted as missing."""
    long = rows.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.lit(missing)) for f in fields)))).alias("field", "value"))
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


def describe(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    return with_quantiles(out, rows, by, column, {"median": 0.5, "p10": 0.1, "p90": 0.9})


def seed_aggregate(long: DataFrame, by: list[str], alone: float | None = 0.0) -> DataFrame:
    """n, mean, sample deviation (`alone` for one row), least and most of each metric."""
    sd = F.stddev_samp("value")
    return long.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (sd if alone is None else F.coalesce(sd, F.lit(alone))).alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))


def best_of(rows: DataFrame, by: list[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The row of the highest score in each group; ties go to the first in the given order."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), *ties)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def keep_first(rows: DataFrame, key: list[str], order: Sequence[str]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def bin_grid(rows: DataFrame, by: list[str], group: str, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts in all groups and bins, empty ones too, with shares of the group."""
    from fathom.functions.clean import bin_labels, binned

    counts = rows.where(F.col(value).isNotNull()).withColumn("bin", binned(F.col(value), edges)).where("bin is not null").groupBy(*by, group, "bin").agg(F.count("*").alias("n"))
    bins = F.explode(F.array(*(F.lit(b[2]) for b in bin_labels(edges))))
    grid = rows.select(*by, group).distinct().withColumn("bin", bins)
    out = grid.join(counts, [*by, group, "bin"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(*by, group))
    return out.withColumn("total", total).withColumn("fraction", F.try_divide(F.col("n"), F.nullif("total", F.lit(0))))


def selection_score(gains: Sequence[str], core: str, weight: float = 0.25, allowed: float = 0.05) -> Column:
    """Mean of the gains that are there, less the penalty for a core above what is allowed."""
    have = F.filter(F.array(*gains), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, b: a + b), F.nullif(F.size(have), F.lit(0)))
    return mean - weight * F.coalesce(F.greatest(F.lit(0.0), F.col(core) - allowed), F.lit(0.0))


def reasons(rows: DataFrame, tests: Sequence[tuple[str, Column]]) -> DataFrame:
    """rows with the name of the first test that holds, null for rows that pass all."""
    out = None
    for name, test in tests:
        out = F.when(test, name) if out is None else out.when(test, name)
    return rows.withColumn("reason", out)


def flags(summary: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """severity and issue of each rule that a row of the summary breaks."""
    found = F.filter(F.array(*(F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(i).alias("issue"))) for s, i, test in rules)), lambda x: x.isNotNull())
    return summary.withColumn("flag", F.explode(found)).select("*", "flag.severity", "flag.issue").drop("flag")


def against(rows: DataFrame, key: str, base: str, metrics: Sequence[str]) -> DataFrame:
    """Every row's metrics less those of the base row; one base row, so nothing is multiplied."""
    one = rows.where(F.col(key) == base).select(*(F.col(m).alias(f"_{m}") for m in metrics)).limit(1)
    return rows.crossJoin(F.broadcast(one)).select(key, *((F.col(m) - F.col(f"_{m}")).alias(f"d_{m}") for m in metrics))


def running_windows(count: int, low: str, high: str, width: int) -> Column:
    """Starts of `count` even windows of a width between low and high, distinct and sorted."""
    room = F.greatest(F.col(high) - F.col(low) + 1 - width, F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.col(low) + F.bround(room * i / F.lit(float(max(1, count - 1)))).cast("int"))))


def count_maps(rows: DataFrame, fields: Sequence[str], by: list[str]) -> DataFrame:
    """Rows and, for each field, a map from its values (blanks as missing) to their counts, in order.

    by: columns of which the values are few; the maps have an entry for each distinct value.
    """
    blank = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("missing"))
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), blank(f).alias("value")) for f in fields))).alias("c"))
    counts = long.groupBy(*by, "c.field", "c.value").agg(F.count("*").alias("n"))
    maps = counts.groupBy(*by).pivot("field", list(fields)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))))
    maps = maps.select(*by, *(F.col(f"`{f}`").alias(f"{f}_counts") for f in fields))
    n = rows.groupBy(*by).agg(F.count("*").alias("rows"))
    return n.join(maps, by) if by else n.crossJoin(maps)


def template_selection(rows: DataFrame) -> DataFrame:
    """One row on the templates chosen for all targets: numbers of candidates, identities, coverages, and how many have none.

    rows: candidate_count, nearest_identity and nearest_coverage as numbers (null where there is no template).
    """
    stats = [f(c).alias(f"{c}_{n}") for c in ("candidate_count", "nearest_identity", "nearest_coverage") for n, f in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))]
    out = rows.agg(F.count("*").alias("rows"), *stats, F.count_if(F.coalesce("candidate_count", F.lit(0)) == 0).alias("targets_with_no_candidate"))
    middles = quantiles_of(rows, [], {c: {f"{c}_median": 0.5} for c in ("candidate_count", "nearest_identity", "nearest_coverage")})
    return rejoined(out, middles, [], "left")


def first_in_tiers(rows: DataFrame, tier: str, most: dict[str, int], order: Sequence[str], limit: int | None = None) -> DataFrame:
    """The first rows of each tier in order, as many as `most` says, and of those the first `limit`; a tier without a number has none."""
    place = F.row_number().over(Window.partitionBy(tier).orderBy(*order))
    room = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in most.items() for x in kv)), F.col(tier)), F.lit(0))
    kept = rows.withColumn("_k", place).where(F.col("_k") <= room).drop("_k")
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def latest_run(runs: DataFrame, by: list[str]) -> DataFrame:
    """The newest file of each group: by the folder's name, then the time, then the file's name."""
    return runs.groupBy(*by).agg(F.max_by("path", F.struct("folder", "modified", "name")).alias("path"))
