"""Connected components of a table of links, by alternating large and small stars.

Cases: links to itself, and those with a null end, link nothing; repeated links count once; a node without a link
has no row; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's larger (or smaller) neighbours to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # with a hash in the key both sides are dealt anew, and Spark may split a node of very many links
    rows = both.withColumn("h", F.xxhash64("u")).join(least.withColumn("h", F.xxhash64("u")), ["h", "u"])
    if large:
        return rows.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rows.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that has a link; root is the least node of the component.

    edges: columns u and v of one comparable type. Each round is a grouping and a join of the links; their
    number never grows beyond one for each node and round, and rounds grow with the logarithm of the
    longest path. Nothing but a checksum reaches the driver.
    """
    edges = cut_lineage(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    while True:
        edges = cut_lineage(_star(_star(edges, True), False).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
