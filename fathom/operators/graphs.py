"""Edges of residue graphs with errors, scalars and vectors, and the conditions of a graph on its nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import radial_basis, separation_bucket

#: Bounds of the distance along the chain.
SEPARATIONS = (1, 2, 4, 8, 16, 32, 64)


def edges_with_error(edges: DataFrame, cells: DataFrame | None, strict: bool = True) -> DataFrame:
    """edges with pae, the expected error of (src, dst) among cells (sample_id, i, j, value).

    A cell that isn't there is an error if strict, else 0; without cells all are 0.
    """
    if cells is None:
        return edges.withColumn("pae", F.lit(0.0))
    lost = F.raise_error(F.lit("no error for an edge")).cast("double") if strict else F.lit(0.0)
    own = cells.select("sample_id", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("value").alias("pae"))
    return edges.join(own, ["sample_id", "src", "dst"], "left").withColumn("pae", F.coalesce("pae", lost))


def edge_scalars(distance: str = "dist", pae: str = "pae", centres: int = 16, most: float = 20.0, scale: float = 30.0, tau: float = 8.0) -> Column:
    """Radial basis of the distance, the error over `scale` (0 to 1), exp(-error / tau), and a one for the bucket of src and dst."""
    bucket = separation_bucket("src", "dst", SEPARATIONS)
    ones = F.transform(F.sequence(F.lit(0), F.lit(len(SEPARATIONS))), lambda k: (k == bucket).cast("double"))
    error = F.array(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(pae) / scale)), F.exp(-F.col(pae) / tau))
    return F.concat(radial_basis(distance, centres, most), error, ones)


def edge_vectors(edges: DataFrame, points: DataFrame, eps: float = 1e-8) -> DataFrame:
    """edges with ux, uy, uz: the unit vector from src to dst, zeros for points in one place."""
    at = lambda k, p: points.select("sample_id", F.col("idx").alias(k), *(F.col(c).alias(f"{p}{c}") for c in "xyz"))
    rows = edges.join(at("src", "_s"), ["sample_id", "src"]).join(at("dst", "_d"), ["sample_id", "dst"])
    d = {c: F.col(f"_d{c}") - F.col(f"_s{c}") for c in "xyz"}
    length = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    return rows.select(*edges.columns, *(F.when(length > eps, d[c] / length).otherwise(0.0).alias(f"u{c}") for c in "xyz"))


def condition_ids(nodes: DataFrame, graphs: DataFrame, columns: list[str], sizes: dict[str, int]) -> DataFrame:
    """nodes with their graph's ids, each the first entry of an array; one that isn't there is 0, and all are held to the vocabulary.

    graphs: sample_id and the columns (array<int>), one row for each graph.
    """
    rows = nodes.join(graphs.select("sample_id", *columns), "sample_id", "left")
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(0))
    return rows.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(sizes[c] - 1), first(c))) for c in columns})
