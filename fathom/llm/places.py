"""Positions of rows in a global order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def positions(df: DataFrame, groups: list[str], order: list[Column], place: str = "place", size: str = "size") -> DataFrame:
    """df with the position (0, 1, 2 ...) of each row in its group by `order`, and the rows of its group.

    Rows are dealt by ranges of (groups, order) and sorted in each range, so a group of any size is spread
    over many tasks; a row's position is its number in its range plus the rows of the group's earlier ranges,
    one number for each range and group in it. Rows equal in `groups` and `order` may take each other's
    position: let `order` end with all columns that matter. Groups mustn't be null. df is read twice (ranges
    are drawn from a sample of it): store it first if it is dear.
    """
    named = [f"g{i}" for i in range(len(groups))]
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    kept = stored(ranged.select(F.struct(*df.columns).alias("row"), *(F.col(g).alias(n) for g, n in zip(groups, named, strict=True)), F.monotonically_increasing_id().alias("at")))
    kept = kept.withColumn("part", F.shiftright("at", 33))
    parts = kept.groupBy("part", *named).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*named)
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = stored(parts.select("part", *named, (before - F.col("first")).alias("base"), F.sum("n").over(whole).alias("total")))
    return kept.join(base, ["part", *named]).select("row.*", (F.col("at") + F.col("base")).alias(place), F.col("total").alias(size))
