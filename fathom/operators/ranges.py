"""Running sums and exact quantiles of groups that may be far larger than a task.

Equal values are counted first and stored. Groups with at most MOST distinct values are summed as they are; larger
ones are cut into ranges, and every range that is still larger again, until none holds more than MOST. The ranges'
sums are added up, and only values of one range are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.streaming.incremental import stored

#: Distinct values that are sorted together at most, and the ranges that a larger one is cut into at once.
MOST = 1 << 20
CUTS = 64


def rejoined(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, by keys that may be null."""
    own = right.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(c for c in right.columns if c not in by))
    test = F.lit(True)
    for c in by:
        test = test & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return left.join(own, test, how).drop(*(f"_by_{c}" for c in by))


def _cut(rows: DataFrame, keys: Sequence[str], value: str, most: int) -> DataFrame | None:
    """rows with `_lo`, the lower bound of each row's range, cut once more where a range is too large; None if none is."""
    cells = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)
    if not cells.take(1):
        return None
    large = stored(rejoined(rows.select(*keys, value), cells.drop("_rows"), keys).groupBy(*keys).agg(
        F.percentile_approx(value, F.array(*(F.lit(k / CUTS) for k in range(1, CUTS))), F.lit(1000)).alias("_cuts")))
    # the list of cuts has a size on disk, by which Spark decides whether it is broadcast
    both = rejoined(rows, large, keys, "left")
    below = F.filter("_cuts", lambda x: x < F.col(value))
    return stored(both.withColumn("_lo", F.coalesce(F.when(F.size(below) > 0, F.array_max(below)), F.col("_lo"))).drop("_cuts"))


def running_sums(counts: DataFrame, by: Sequence[str], value: str, columns: Sequence[str], most: int = MOST) -> DataFrame:
    """counts with before_<c> and all_<c>: sums of column c over smaller values of the group, and over all of it.

    counts has one row for each group and value; no value is null. most: the values of a range.
    """
    rows = stored(counts)
    names, own = rows.columns, Window.partitionBy(*by)
    large = rows.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)
    if not large.take(1):
        up = own.orderBy(value)
        return rows.select(*names, *((F.sum(c).over(up) - F.col(c)).alias(f"before_{c}") for c in columns), *(F.sum(c).over(own).alias(f"all_{c}") for c in columns))
    rows = rows.withColumn("_lo", F.lit(None).cast(rows.schema[value].dataType))
    while (finer := _cut(rows, [*by, "_lo"], value, most)) is not None:
        rows = finer
    ranges = rows.groupBy(*by, "_lo").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    up = own.orderBy(F.asc_nulls_first("_lo"))
    ranges = stored(ranges.select(*by, "_lo", *((F.sum(f"_{c}").over(up) - F.col(f"_{c}")).alias(f"_below_{c}") for c in columns), *(F.sum(f"_{c}").over(own).alias(f"all_{c}") for c in columns)))
    inside = Window.partitionBy(*by, "_lo").orderBy(value)
    out = rejoined(rows, ranges, [*by, "_lo"])
    out = out.withColumns({f"before_{c}": F.col(f"_below_{c}") + F.sum(c).over(inside) - F.col(c) for c in columns})
    return out.select(*names, *(f"before_{c}" for c in columns), *(f"all_{c}" for c in columns))


def _places(s: DataFrame, by: Sequence[str], places: Mapping[str, float]) -> DataFrame:
    def at(q: float) -> Column:
        h = q * (F.col("all__n") - 1)
        holds = lambda k: (F.col("before__n") <= k) & (k < F.col("before__n") + F.col("_n"))
        lo, hi = F.max(F.when(holds(F.floor(h)), F.col("_v"))), F.max(F.when(holds(F.ceil(h)), F.col("_v")))
        return lo + (hi - lo) * F.max(h - F.floor(h))

    return s.groupBy(*by).agg(*(at(q).cast("double").alias(n) for n, q in places.items()))


def quantiles(rows: DataFrame, by: Sequence[str], value: Column | str, places: Mapping[str, float], most: int = MOST) -> DataFrame:
    """by and a column for each name in places: the exact quantile, straight between neighbours; nulls don't count."""
    counts = rows.select(*by, (F.col(value) if isinstance(value, str) else value).alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    return _places(running_sums(counts, by, "_v", ["_n"], most), by, places)


def quantiles_of(rows: DataFrame, by: Sequence[str], columns: Mapping[str, Mapping[str, float]], most: int = MOST) -> DataFrame:
    """The same for several columns in one pass: names of quantiles by column."""
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns))).alias("_x")).select(*by, "_x.*").where("_v is not null")
    sums = running_sums(long.groupBy(*by, "_c", "_v").agg(F.count("*").alias("_n")), [*by, "_c"], "_v", ["_n"], most)
    each = _places(sums, [*by, "_c"], {f"_q{q}": q for places in columns.values() for q in places.values()})
    return each.groupBy(*by).agg(*(F.max(F.when(F.col("_c") == c, F.col(f"`_q{q}`"))).alias(n) for c, places in columns.items() for n, q in places.items()))


def with_quantiles(summary: DataFrame, rows: DataFrame, by: Sequence[str], value: Column | str, places: Mapping[str, float]) -> DataFrame:
    """summary (a row for each group) with quantiles of its rows."""
    return rejoined(summary, quantiles(rows, by, value, places), by, "left")
