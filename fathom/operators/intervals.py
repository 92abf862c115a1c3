"""Joins of ranges, and of rows with a few others that no key tells apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of ranges [lo, hi] of a and [start, end] of b that overlap, within equal keys.

    Ranges are cut into bins of `width` and joined by bin; a pair counts in the bin of its greater beginning, so
    it comes once. Ranges that end before they begin overlap nothing.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    left = a.where("lo <= hi").withColumn("_bin", bins("lo", "hi"))
    right = b.where("start <= end").withColumn("_bin", bins("start", "end"))
    pairs = left.join(right, [*keys, "_bin"]).where((F.col("lo") <= F.col("end")) & (F.col("hi") >= F.col("start")))
    return pairs.where(F.col("_bin") == F.floor(F.greatest("lo", "start") / width)).drop("_bin")


def with_few(rows: DataFrame, few: DataFrame, test: Column, most: int = 10_000) -> DataFrame:
    """rows with each of the few others that passes a test; more than `most` others is an error, raised when the plan runs.

    The others are broadcast, as their number is held; a join by keys is for all else.
    """
    n = few.limit(most + 1).agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > most, F.raise_error(F.lit(f"more than {most} rows to compare with")).cast("boolean")).otherwise(True).alias("_few"))
    held = few.limit(most + 1).crossJoin(n).where("_few").drop("_few")
    return rows.join(F.broadcast(held), test)
