"""Splits by hash, rank and metadata, and the check for leaks between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_percent(key: str) -> Column:
    return F.conv(F.substring(F.sha2(F.col(key).cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("bigint") % 100


def hash_split(key: str, train: int = 70, val: int = 85) -> Column:
    """All rows of a key fall in one split."""
    p = hash_percent(key)
    return F.when(p < train, "train").when(p < val, "val").otherwise("test")


def rank_split(rows: DataFrame, key: str, train: float = 0.7, val: float = 0.15, given: str | None = None, open_splits: tuple[str, ...] = ("", "expansion", "candidate")) -> DataFrame:
    """Splits by the order of the keys' hashes; a given split stays unless it is null or one of open_splits.

    Of three rows or more each split gets one at least. Keys are ordered by their hash's first digits, counted,
    and placed by running sums, so no single task sorts all rows.
    """
    rows = rows.withColumn("_h", F.sha2(F.col(key).cast("string").cast("binary"), 256)).withColumn("_b", F.substring("_h", 1, 3))
    dealt = F.lit(True) if given is None else F.coalesce(F.trim(given).isin(*open_splits), F.lit(True))
    free = rows.where(dealt)
    sizes = free.groupBy("_b").agg(F.count("*").alias("_n"))
    below = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("_n")
    placed = free.join(F.broadcast(below), "_b").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h")))
    n = F.col("_all")
    a = F.greatest(F.lit(1), F.bround(n * train))
    b = F.when(n >= 3, F.greatest(F.lit(1), F.bround(n * val))).otherwise(0)
    full = (n >= 3) & (a + b >= n)
    a, b = F.when(full, n - 2).otherwise(a), F.when(full, 1).otherwise(b)
    out = placed.withColumn("split", F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= a + b, "val").otherwise("test")).drop("_h", "_b", "_before", "_all", "_rank")
    if given is None:
        return out
    return out.unionByName(rows.where(~dealt).withColumn("split", F.col(given)).drop("_h", "_b"))


def chosen_splits(rows: DataFrame, targets: str | None = None, donors: tuple[str, ...] = ("train", "val")) -> tuple[DataFrame, DataFrame]:
    """Rows of the target split (all if None) and of the donor splits; the first row of an empty choice raises an error.

    The check is part of the plan: a one-row aggregate on the side, so that no job runs while the plan is made.
    """
    def some(df: DataFrame, what: str) -> DataFrame:
        n = df.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"no {what} rows")).cast("boolean")).otherwise(True).alias("_some"))
        return n.join(df, F.lit(True), "left").where("_some").drop("_some")

    return some(rows if targets is None else rows.where(F.col("split") == targets), "target"), some(rows.where(F.col("split").isin(*donors)), "donor")


def leaks(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split."""
    return rows.groupBy(group).agg(F.sort_array(F.collect_set(split)).alias("splits"), F.count("*").alias("n")).where(F.size("splits") > 1)
