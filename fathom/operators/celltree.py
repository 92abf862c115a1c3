"""Nearest points by branch and bound over a tree of cells, level by level as joins.

A sample's points fill a box; a box that holds more than MOST points is halved along each axis, and each part
shrinks to the box that its own points fill, so that a tight cluster is cut after a few levels. Every cell knows
its points' number and their box. A query first goes down to a small cell with k points, whose farthest corner
bounds its k nearest; then it takes, level by level, all cells whose nearest corner isn't farther than that. Only
the last cells' points meet the query, so the work grows with the points and not with their pairs, in clusters
and for far queries too.

Of points in one place only the first k are kept, by idx, as ties go to the smaller idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.streaming.incremental import stored

#: Points of a cell that isn't halved, and the most levels (three bits each of a cell's number).
MOST = 32
DEEPEST = 20
_AXES = "xyz"
_CELL = ["sample_id", "cell"]


def tree(points: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """By level: the cells (number, points, box, and whether they are halved), and the points of cells that aren't.

    A part's number is its cell's times eight, plus one bit for each axis.
    """
    rows, cells, leaves = stored(points.withColumn("cell", F.lit(0).cast("bigint"))), [], []
    for level in range(DEEPEST + 1):
        own = rows.groupBy(*_CELL).agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in _AXES))
        wide = F.greatest(*(F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in _AXES)) > 0
        own = stored(own.withColumn("crowded", (F.col("n") > MOST) & wide & F.lit(level < DEEPEST)))
        cells.append(own)
        if not own.where("crowded").take(1):
            leaves.append(rows)
            break
        keyed = rows.join(own.drop("n"), _CELL)
        leaves.append(keyed.where("not crowded").select(*rows.columns))
        bits = [F.when(F.col(c) > F.col(f"lo_{c}") / 2 + F.col(f"hi_{c}") / 2, 4 >> k).otherwise(0) for k, c in enumerate(_AXES)]
        part = F.col("cell") * 8 + bits[0] + bits[1] + bits[2]
        rows = stored(keyed.where("crowded").withColumn("cell", part).select(*rows.columns))
    return cells, leaves


def _squares(of: list[Column]) -> Column:
    return of[0] * of[0] + of[1] * of[1] + of[2] * of[2]


def _bounds() -> tuple[Column, Column]:
    """Squares of the least and the greatest distance between a query and a point of the cell's box."""
    under = [F.greatest(F.lit(0.0), F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}")) for c in _AXES]
    over = [F.greatest(F.abs(F.col(c) - F.col(f"lo_{c}")), F.abs(F.col(c) - F.col(f"hi_{c}"))) for c in _AXES]
    return _squares(under), _squares(over)


def _bounded(queries: DataFrame, cells: list[DataFrame], k: int) -> DataFrame:
    """queries with `bound`: a square that k points lie within; null where the sample has fewer.

    From each cell a query goes on to the part with k points whose farthest corner is nearest. Parts lie in
    their cell's box, so the last one's corner bounds best.
    """
    at = queries.join(cells[0].where(F.col("n") >= k), "sample_id").withColumn("over", _bounds()[1]).select("sample_id", "q", *_AXES, "cell", "crowded", "over")
    every = at.select("sample_id", "q", "over")
    for own in cells[1:]:
        child = own.where(F.col("n") >= k).withColumn("up", F.shiftright("cell", 3)).drop("n")
        parts = at.where("crowded").select("sample_id", "q", *_AXES, F.col("cell").alias("up")).join(child, ["sample_id", "up"])
        best = parts.groupBy("sample_id", "q").agg(F.min(F.struct(_bounds()[1].alias("over"), F.col("cell"), F.col("crowded"), *map(F.col, _AXES))).alias("m"))
        at = stored(best.select("sample_id", "q", "m.*"))
        every = every.unionByName(at.select("sample_id", "q", "over"))
    return queries.join(every.groupBy("sample_id", "q").agg(F.min("over").alias("bound")), ["sample_id", "q"], "left")


def _keyed(leaf: DataFrame) -> DataFrame:
    return leaf.select("sample_id", "cell", F.col("idx").alias("dst"), *(F.col(c).alias(f"p{c}") for c in _AXES))


def nearest_of(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """sample_id, q, dst, dist of the k nearest points of the same sample for every query, ties by the smaller dst.

    queries: sample_id, q, x, y, z; points: sample_id, idx, x, y, z. Points and queries with a null or NaN
    coordinate have no neighbours; a sample with fewer than k points gives those it has.
    """
    def solid(df: DataFrame, *names: str) -> DataFrame:
        test = F.lit(True)
        for c in _AXES:
            test = test & F.col(c).isNotNull() & ~F.isnan(c)
        return df.select("sample_id", *names, *(F.col(c).cast("double").alias(c) for c in _AXES)).where(test)

    points, queries = solid(points, "idx"), solid(queries, "q")
    if k == 1:
        points = points.groupBy("sample_id", *_AXES).agg(F.min("idx").alias("idx"))
    else:
        first = F.row_number().over(Window.partitionBy("sample_id", *_AXES).orderBy("idx"))
        points = points.withColumn("_k", first).where(F.col("_k") <= k).drop("_k")
    cells, leaves = tree(points)
    if len(cells) == 1:  # one cell holds each sample
        pairs = queries.withColumn("cell", F.lit(0).cast("bigint")).join(_keyed(leaves[0]), _CELL)
    else:
        front, pairs = _bounded(queries, cells, k), None
        near = F.col("bound").isNull() | (_bounds()[0] <= F.col("bound") * (1 + 1e-9))  # a slack of a few last digits keeps ties
        for level, own in enumerate(cells):
            if level == 0:
                front = front.join(own, "sample_id")
            else:
                child = own.withColumn("up", F.shiftright("cell", 3))
                front = front.where("crowded").select("sample_id", "q", *_AXES, "bound", F.col("cell").alias("up")).join(child, ["sample_id", "up"]).where(near)
            front = stored(front.select("sample_id", "q", *_AXES, "bound", "cell", "crowded"))
            met = front.where("not crowded").drop("bound", "crowded").join(_keyed(leaves[level]), _CELL)
            pairs = met if pairs is None else pairs.unionByName(met)
    dist = F.sqrt(_squares([F.col(c) - F.col(f"p{c}") for c in _AXES]))
    pairs = pairs.select("sample_id", "q", "dst", dist.alias("dist"))
    if k == 1:
        return pairs.groupBy("sample_id", "q").agg(F.min(F.struct("dist", "dst")).alias("m")).select("sample_id", "q", F.col("m.dst").alias("dst"), F.col("m.dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("sample_id", "q").orderBy("dist", "dst"))
    return pairs.withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")
