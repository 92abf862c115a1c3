"""Neighbour joins in space: nearest k, contacts within a radius, and functions of them.

Points within a radius meet through cubic cells: a join sees its own and the 26 cells around; those of a sample of few
points all meet. Nearest points are
found over a tree of cells (`celltree`). Neither compares all pairs of a large sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.clean import ratio

from .celltree import nearest_of


def _distance(a: str, b: str):
    return F.sqrt(sum((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in "xyz"))


#: Points of a sample that are all compared with each other.
FEW = 64


def _near(points: DataFrame, radius: float, source: Sequence[str], few: int) -> list[DataFrame]:
    """sample_id, src, dst, dist, columns of source (as s_<c>) and dx, dy, dz of ordered pairs within the radius: of samples of at most `few` points, and of others.

    A small sample's points meet by the sample, without copies; those of larger ones by cells.
    """
    sized = points.join(points.groupBy("sample_id").agg(F.count("*").alias("_points")), "sample_id")
    own = ["sample_id", F.col("idx").alias("src"), "x", "y", "z", *(F.col(c).alias(f"s_{c}") for c in source)]
    other = ["sample_id", F.col("idx").alias("dst"), "x", "y", "z"]
    out = ["sample_id", "src", "dst", _distance("a", "b").alias("dist"), *(f"s_{c}" for c in source), *(F.col(f"b.{c}").alias(f"d{c}") for c in "xyz")]
    small, large = sized.where(F.col("_points") <= few), sized.where(F.col("_points") > few)
    within = small.select(*own).alias("a").join(small.select(*other).alias("b"), "sample_id")
    cell = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xyz"]
    shift = F.explode(F.array(*(F.struct(*(F.lit(s[k]).alias(f"d{c}") for k, c in enumerate("xyz"))) for s in ((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))))
    b = large.select(*other, *cell).withColumn("s", shift)
    b = b.select("sample_id", "dst", "x", "y", "z", *((F.col(f"c{c}") + F.col(f"s.d{c}")).alias(f"c{c}") for c in "xyz"))
    across = large.select(*own, *cell).alias("a").join(b.alias("b"), ["sample_id", "cx", "cy", "cz"])
    return [pairs.where("src <> dst").select(*out).where(F.col("dist") <= radius) for pairs in (within, across)]


def contacts(points: DataFrame, radius: float, eps: float = 1e-9, few: int = FEW) -> DataFrame:
    """sample_id, src, dst, dist of all ordered pairs with eps < dist <= radius; samples of at most `few` points meet whole."""
    small, large = (pairs.select("sample_id", "src", "dst", "dist").where(F.col("dist") > eps) for pairs in _near(points, radius, (), few))
    return small.unionByName(large)


def nearest(points: DataFrame, k: int) -> DataFrame:
    """sample_id, src, dst, dist, rank of the k nearest others, ties by dst; a sample may have any number of points."""
    found = nearest_of(points.select("sample_id", F.col("idx").alias("q"), *"xyz"), points, k + 1)
    pairs = found.where("q <> dst").select("sample_id", F.col("q").alias("src"), "dst", "dist")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id", "src").orderBy("dist", "dst"))).where(F.col("rank") <= k)


def depth(points: DataFrame, surface: DataFrame) -> DataFrame:
    """sample_id, idx, depth: distance to the nearest surface point of the sample; none where it has no surface point."""
    found = nearest_of(points.select("sample_id", F.col("idx").alias("q"), *"xyz"), surface, 1)
    return found.select("sample_id", F.col("q").alias("idx"), F.col("dist").alias("depth"))


def coordination(points: DataFrame, radius: float) -> DataFrame:
    n = contacts(points, radius).groupBy("sample_id", F.col("src").alias("idx")).agg(F.count("*").alias("cn"))
    return points.select("sample_id", "idx").join(n, ["sample_id", "idx"], "left").fillna(0, ["cn"])


def chain_steps(points: DataFrame) -> DataFrame:
    """Unit steps to the previous and next point, and the central difference; zeros at the ends."""
    w = Window.partitionBy("sample_id").orderBy("idx")
    out = points.select("sample_id", "idx", *"xyz", *(F.lag(c).over(w).alias(f"p{c}") for c in "xyz"), *(F.lead(c).over(w).alias(f"n{c}") for c in "xyz"))
    for name, a, b in (("prev", "{c}", "p{c}"), ("next", "n{c}", "{c}"), ("mid", "n{c}", "p{c}")):
        d = {c: F.col(a.format(c=c)) - F.col(b.format(c=c)) for c in "xyz"}
        length = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
        out = out.withColumns({f"{name}_{c}": F.coalesce(ratio(d[c], F.nullif(length, F.lit(0.0))), F.lit(0.0)) for c in "xyz"})
    return out.select("sample_id", "idx", *(f"{n}_{c}" for n in ("prev", "next", "mid") for c in "xyz"))


def half_sphere(points: DataFrame, radius: float, few: int = FEW) -> DataFrame:
    """sample_id, idx, up, down: neighbours on either side of the plane through a point across the chain's direction.

    The direction is that from the point before to the one after, at a chain's end the step that there is,
    for a lone point the x axis; a neighbour in the plane itself counts as up. Pairs bring both points and the direction along.
    """
    w = Window.partitionBy("sample_id").orderBy("idx")
    step = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    lone = F.lag("x").over(w).isNull() & F.lead("x").over(w).isNull()
    turned = points.select("sample_id", "idx", *"xyz", *(F.when(lone, F.lit(float(c == "x"))).otherwise(step(c)).alias(f"a{c}") for c in "xyz"))
    side = sum((F.col(f"d{c}") - F.col(f"s_{c}")) * F.col(f"s_a{c}") for c in "xyz")
    counted = [pairs.groupBy("sample_id", F.col("src").alias("idx")).agg(F.count_if(side >= 0).alias("up"), F.count_if(side < 0).alias("down")) for pairs in _near(turned, radius, ("x", "y", "z", "ax", "ay", "az"), few)]
    return points.select("sample_id", "idx").join(counted[0].unionByName(counted[1]), ["sample_id", "idx"], "left").fillna(0, ["up", "down"])


def radial_basis(distance: str, centres: int = 16, most: float = 20.0):
    """exp(-((d - c) / width)^2) at even centres from 0 to most."""
    step = most / (centres - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(centres - 1)), lambda i: F.exp(-F.pow((F.col(distance) - i * step) / step, F.lit(2.0))))


def separation_bucket(src: str, dst: str, edges=(1, 2, 4, 8, 16, 32, 64)):
    """Number of edges that are at most the distance along the chain."""
    gap = F.abs(F.col(dst) - F.col(src))
    return sum((gap >= e).cast("int") for e in edges)


def messages(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Mean of the source nodes' values at each destination; 0 without an edge."""
    got = edges.join(nodes.select("sample_id", F.col("idx").alias("src"), value), ["sample_id", "src"]).groupBy("sample_id", F.col("dst").alias("idx")).agg(F.avg(value).alias("message"))
    return nodes.select("sample_id", "idx").join(got, ["sample_id", "idx"], "left").fillna(0.0, ["message"])


def submatrix(matrix: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """Cells (sample_id, i, j, value) at pairs of wanted places, renumbered; missing cells are 0, or an error if strict."""
    row, col = (wanted.select("sample_id", F.col("place").alias(c), F.col("pos").alias(f"new_{c}")) for c in "ij")
    lost = F.raise_error(F.lit("no cell for a wanted place")).cast("double") if strict else F.lit(0.0)
    grid = row.join(col, "sample_id")
    return grid.join(matrix, ["sample_id", "i", "j"], "left").select("sample_id", F.col("new_i").alias("i"), F.col("new_j").alias("j"), F.coalesce("value", lost).alias("value"))
