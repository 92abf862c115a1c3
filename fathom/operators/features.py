"""Residue and graph features, and the choices between alternative records."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relative_exposure(area: str, name: str, most: Mapping[str, float], default: float = 180.0) -> Column:
    """Area over the most that a residue of the name has, from 0 to 1.5."""
    table = F.create_map(*(F.lit(x) for kv in most.items() for x in kv)) if most else F.create_map().cast("map<string,double>")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.5), F.col(area) / F.coalesce(table[F.col(name)], F.lit(default))))


def rescaled(rows: DataFrame, column: str, by: list[str], most: float = 1.5) -> Column:
    """column / 100 in groups where any value is over `most`, as it is elsewhere."""
    big = F.max(column).over(Window.partitionBy(*by)) > most
    return F.when(big, F.col(column) / 100.0).otherwise(F.col(column))


def sequence_features(letter: str, idx: str, n: str, alphabet: str, dim: int = 128) -> Column:
    """dim numbers that stand in for a residue's learned ones: a one for the letter (an unknown one counts as the
    alphabet's last), a one for the place modulo what is left, and in the last two the phase of the place among n."""
    size = min(len(alphabet), dim)
    found = F.instr(F.lit(alphabet), F.upper(letter))
    own = F.when((found > 0) & (F.length(letter) == 1), found - 1).otherwise(len(alphabet) - 1) % dim
    place = size + F.col(idx) % (dim - size) if dim > size else F.lit(-1)
    turn = 2 * math.pi * F.col(idx) / F.greatest(F.lit(1), F.col(n) - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.when(k == dim - 2, F.sin(turn)).when(k == dim - 1, F.cos(turn)).otherwise(((k == own) | (k == place)).cast("double")))


def backbone_angles(residues: DataFrame) -> DataFrame:
    """residues with dihedrals: sin and cos of phi, psi and omega, from atoms n, a and c (columns nx to cz).

    phi and omega need the residue before, psi the one behind; an angle whose atoms aren't all there is 0.
    """
    w = Window.partitionBy("sample_id").orderBy("idx")
    near = {f"{side}_{atom}{c}": f(f"{atom}{c}").over(w) for side, f in (("before", F.lag), ("behind", F.lead)) for atom in "nac" for c in "xyz"}
    rows = residues.withColumns(near)
    angles = (dihedral("before_c", "n", "a", "c"), dihedral("n", "a", "c", "behind_n"), dihedral("before_a", "before_c", "n", "a"))
    return rows.withColumn("dihedrals", F.array(*(f(x) for x in angles for f in (F.sin, F.cos)))).drop(*near)


def node_features(rows: DataFrame, base: str = "base") -> Column:
    """The base features (128) and 16 more, each scaled to 0 to 1 but for the dihedrals: confidence (percent), area
    (250), relative exposure, depth (20), neighbours (32), half spheres up and down (32), dihedrals, 3 structure states."""
    scaled = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / most))
    parts = [scaled(c, m) for c, m in (("plddt", 100.0), ("sasa", 250.0), ("rsa", 1.0), ("depth", 20.0), ("cn", 32.0), ("up", 32.0), ("down", 32.0))]
    return F.concat(base, F.array(*parts), "dihedrals", "states")


def length_mismatch(samples: DataFrame, expected: str, counts: Sequence[str]) -> Column:
    """Names of the counts that differ from the expected one, null where all agree."""
    names = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(expected)), c) for c in counts)), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, F.array_join(names, ","))


def checked_graphs(samples: DataFrame, required: Sequence[str], expected: str, counts: Sequence[str]) -> DataFrame:
    """samples, one row for each graph; a column that isn't there is an error at once, a count that differs from the
    expected one an error of the row."""
    if lost := [c for c in required if c not in samples.columns]:
        raise KeyError(f"columns missing: {', '.join(lost)}")
    wrong = length_mismatch(samples, expected, counts)
    ok = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("lengths differ: "), wrong)).cast("boolean")).otherwise(True)
    return samples.withColumn("_ok", ok).where("_ok").drop("_ok")


def dihedral(a: str, b: str, c: str, d: str) -> Column:
    """Angle of four points given by the prefixes of their x, y, z columns; 0 where one is missing."""
    at = lambda p: tuple(F.col(f"{p}{x}") for x in "xyz")
    sub = lambda p, q: tuple(x - y for x, y in zip(q, p, strict=True))
    cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=True))
    u, v, w = sub(at(a), at(b)), sub(at(b), at(c)), sub(at(c), at(d))
    n, m = cross(u, v), cross(v, w)
    return F.coalesce(F.atan2(dot(cross(n, m), v) / F.sqrt(dot(v, v)), dot(n, m)), F.lit(0.0))


def chain_dihedrals(points: DataFrame) -> DataFrame:
    """Dihedral of each point with the one before and the two after."""
    w = Window.partitionBy("sample_id").orderBy("idx")
    cols = [F.lag(x).over(w).alias(f"a{x}") for x in "xyz"] + [F.col(x).alias(f"b{x}") for x in "xyz"] + [F.lead(x).over(w).alias(f"c{x}") for x in "xyz"] + [F.lead(x, 2).over(w).alias(f"d{x}") for x in "xyz"]
    return points.select("sample_id", "idx", *cols).select("sample_id", "idx", dihedral("a", "b", "c", "d").alias("angle"))


def principal_components(rows: DataFrame, column: str, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the k main directions (their largest entry positive). Tasks sum products; the driver solves width x width."""

    def run(batches):
        n, s, q = 0, np.zeros(width), np.zeros((width, width))
        for pdf in batches:
            x = np.stack(pdf[column].to_numpy()).astype(float)
            n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        cells = np.concatenate([[n], s, q.ravel()])
        yield pd.DataFrame({"cell": np.arange(len(cells)), "v": cells})

    parts = rows.select(column).mapInPandas(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    cells = np.zeros(1 + width + width * width)
    cells[parts["cell"].to_numpy()] = parts["v"]
    n, mean = cells[0], cells[1 : width + 1] / cells[0]
    cov = cells[width + 1 :].reshape(width, width) / n - np.outer(mean, mean)
    _, v = np.linalg.eigh(cov)
    v = v[:, ::-1][:, :k].T
    return mean, v * np.sign(v[np.arange(k), np.abs(v).argmax(axis=1)])[:, None]


def projected(column: str, mean: np.ndarray, directions: np.ndarray) -> Column:
    """Scores along the directions, as one array."""
    dot = lambda d: F.aggregate(F.zip_with(F.col(column), F.array(*map(F.lit, d.tolist())), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, b: a + b) - F.lit(float(mean @ d))
    return F.array(*map(dot, directions))


def largest_group(atoms: DataFrame, by: list[str], group: list[str], pad: float = 4.0, least: float = 10.0) -> DataFrame:
    """The group with most atoms (ties: the greatest key), its centre and padded box."""
    agg = [F.count("*").alias("n")] + [f(c).alias(f"{n}_{c}") for n, f in (("mid", F.avg), ("lo", F.min), ("hi", F.max)) for c in "xyz"]
    w = Window.partitionBy(*by).orderBy(F.desc("n"), *(F.desc(g) for g in group))
    rows = atoms.groupBy(*by, *group).agg(*agg).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return rows.select(*by, *group, "n", *(F.col(f"mid_{c}").alias(f"center_{c}") for c in "xyz"), *(F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}") + 2 * pad, F.lit(least)).alias(f"size_{c}") for c in "xyz"))


def best_alternative(atoms: DataFrame, key: list[str]) -> DataFrame:
    """One record of each atom: a blank alternative first, then A, then the highest occupancy."""
    w = Window.partitionBy(*key).orderBy(F.when(F.trim("altloc") == "", 0).when(F.col("altloc") == "A", 1).otherwise(2), F.desc_nulls_last("occupancy"), "altloc")
    return atoms.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_accepted(hits: DataFrame, by: list[str], ok: Column) -> DataFrame:
    """Position of the first hit in rank order that is accepted, and how many came before it."""
    return hits.groupBy(*by).agg(F.min(F.when(ok, F.col("rank"))).alias("accepted"), F.count("*").alias("n_hits")).withColumn("n_rejected", F.coalesce(F.col("accepted") - 1, F.col("n_hits")))


def gated_mask(rows: DataFrame, mask: Column, by: list[str]) -> Column:
    """mask and is_eval where the group has a residue to evaluate, mask elsewhere."""
    some = F.max(F.col("is_eval")).over(Window.partitionBy(*by))
    return mask & (F.col("is_eval") | ~some)


def range_slices(rows: DataFrame, name: str, parts: Mapping[str, tuple[float, float]], seed: int) -> DataFrame:
    """rows with `part`: slices int(n * lo) to int(n * hi) of the names in a seeded order of hashes; rows in no slice are left out.

    Names are unique. Their places are counted by the hash's first digits, so no task orders all of them.
    """
    keyed = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string")).cast("binary"), 256)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    whole = Window.orderBy("_b")  # 4096 rows at most
    below = sizes.select("_b", (F.sum("_n").over(whole) - F.col("_n")).alias("_before"), F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    placed = keyed.join(F.broadcast(below), "_b").withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", name)) - 1)
    part = None
    for label, (lo, hi) in parts.items():
        test = (F.col("_place") >= F.floor(F.col("_all") * lo)) & (F.col("_place") < F.floor(F.col("_all") * hi))
        part = F.when(test, label) if part is None else part.when(test, label)
    return placed.withColumn("part", part).where("part is not null").select(*rows.columns, "part")


def cache_keys(fields: Mapping[str, Column]) -> Column:
    """12 hex digits for each row's parameters (texts of JSON values), as cache_key gives for the same payload."""
    body = []
    for k in sorted(fields):
        body += [F.lit((", " if body else "") + json.dumps(k) + ": "), fields[k]]
    return F.substring(F.sha2(F.concat(F.lit("{"), *body, F.lit("}")).cast("binary"), 256), 1, 12)


def cache_key(payload: Mapping) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:12]
