"""Deviation of ligand poses from a reference that doesn't depend on how symmetric atoms are numbered.

The heavy atoms of a pose are matched with the reference's by element and bonds: colour refinement finds which
atoms can correspond, a search over atoms of one colour finds the correspondence of least deviation, without a
fit. Bond orders don't count, so the oxygens of a carboxylate and the sides of a ring are alike. Where bonds
don't match, atoms are compared in order, and must then be of the same elements.

A row of the search is one pose: its arrays hold one ligand's atoms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a search after which the best correspondence so far is taken, with status `not_proved`.
STEPS = 200_000


def refined(elements: list[str], neighbours: list[list[int]]) -> list[str]:
    """A colour for each atom, as text: its element, then its own and its neighbours' colours, until no colour splits."""
    colours = list(elements)
    for _ in elements:
        new = [f"{c}({','.join(sorted(colours[n] for n in near))})" for c, near in zip(colours, neighbours, strict=True)]
        names = {c: f"{i}" for i, c in enumerate(sorted(set(new)))}
        if len(names) == len(set(colours)):
            break
        colours = [f"{e}{names[c]}" for e, c in zip(elements, new, strict=True)]
    return colours


def _adjacent(n: int, bonds: list[tuple[int, int]]) -> list[list[int]]:
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in bonds:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return [sorted(x) for x in near]


def _both_refined(elements: list[str], near: list[list[int]], other: list[str], other_near: list[list[int]]) -> tuple[list[str], list[str]]:
    """Colours of two graphs with the same names."""
    n = len(elements)
    colours = refined([*elements, *other], [*near, *([n + x for x in row] for row in other_near)])
    return colours[:n], colours[n:]


def least_deviation(elements: list[str], xyz: np.ndarray, bonds: list[tuple[int, int]], ref_elements: list[str], ref_xyz: np.ndarray, ref_bonds: list[tuple[int, int]], steps: int = STEPS) -> tuple[str, float | None]:
    """Status and least root mean square deviation over all correspondences that keep elements and bonds."""
    n = len(ref_elements)
    if len(elements) != n:
        return "atom_counts_differ", None
    if not n:
        return "no_heavy_atoms", None
    square = ((ref_xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(axis=2)
    near, ref_near = _adjacent(n, bonds), _adjacent(n, ref_bonds)
    colours, ref_colours = _both_refined(elements, near, ref_elements, ref_near)
    found = None
    if sorted(colours) == sorted(ref_colours):
        found = _search(square, colours, near, ref_colours, ref_near, steps)
    if found is None:
        if elements != ref_elements:
            return "elements_differ", None
        return "in_order", float(np.sqrt(square.trace() / n))
    best, proved = found
    return ("ok" if proved else "not_proved"), float(np.sqrt(best / n))


def _search(square: np.ndarray, colours: list[str], near: list[list[int]], ref_colours: list[str], ref_near: list[list[int]], steps: int) -> tuple[float, bool] | None:
    """The least sum of squares over graph isomorphisms and whether the search was complete; None if there is none."""
    n = len(colours)
    sizes = {c: colours.count(c) for c in colours}
    order: list[int] = []
    while len(order) < n:  # atoms next to those placed first, then those of rare colours
        placed = set(order)
        rest = [a for a in range(n) if a not in placed]
        order.append(min(rest, key=lambda a: (-sum(b in placed for b in ref_near[a]), sizes[ref_colours[a]], a)))
    own = [sorted((p for p in range(n) if colours[p] == ref_colours[a]), key=lambda p: square[a, p]) for a in order]  # noqa: B023
    floor = np.r_[np.cumsum([square[a, c[0]] for a, c in zip(order, own, strict=True)][::-1])[::-1], 0.0]
    links = [set(x) for x in near]
    before = [[b for b in ref_near[a] if b in set(order[:k])] for k, a in enumerate(order)]
    best, left = np.inf, steps
    image: dict[int, int] = {}
    used = [False] * n
    stack = [(0, iter(own[0]), 0.0)]
    while stack and left:
        k, options, cost = stack[-1]
        a = order[k]
        if a in image:
            used[image.pop(a)] = False
        for p in options:
            left -= 1
            total = cost + square[a, p]
            if total + floor[k + 1] >= best:
                break  # options are sorted: the others cost more
            if used[p] or not all(image[b] in links[p] for b in before[k]) or sum(used[q] for q in near[p]) != len(before[k]):
                continue
            if k == n - 1:
                best = total
                break
            image[a], used[p] = p, True
            stack.append((k + 1, iter(own[k + 1]), total))
            break
        else:
            stack.pop()
            continue
        if stack[-1][0] == k:
            stack.pop()
    return None if best == np.inf else (float(best), bool(left))


def heavy(element: str = "element") -> Column:
    """Atoms that count: all but hydrogen and deuterium; an unknown element counts as one of its own."""
    return ~F.coalesce(F.upper(F.trim(element)), F.lit("")).isin("H", "D")


def _gathered(atoms: DataFrame, bonds: DataFrame | None, by: list[str], prefix: str) -> DataFrame:
    atom = F.struct(F.col("serial"), F.coalesce(F.upper(F.trim("element")), F.lit("")).alias("element"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    out = atoms.where(heavy()).groupBy(*by).agg(F.array_sort(F.collect_list(atom)).alias(f"{prefix}atoms"))
    if bonds is None:
        return out
    links = bonds.groupBy(*by).agg(F.collect_list(F.array("src", "dst")).alias(f"{prefix}bonds"))
    return out.join(links, by, "left")


def symmetric_deviation(atoms: DataFrame, bonds: DataFrame, reference: DataFrame, reference_bonds: DataFrame, target: str, pose: str, strict: bool = False, steps: int = STEPS) -> DataFrame:
    """target, pose, status, rmsd of every pose whose target has a reference.

    atoms: target, pose, serial, element, x, y, z; bonds: target, pose, src, dst (serials); reference and
    reference_bonds: the same without pose. status: ok, not_proved (the search was cut after `steps`, rmsd is an
    upper bound), in_order (bonds don't match, the elements do), and without an rmsd elements_differ,
    atom_counts_differ and no_heavy_atoms, which are errors if strict.
    """
    rows = _gathered(atoms, bonds, [target, pose], "").join(_gathered(reference, reference_bonds, [target], "ref_"), target)

    def arrays(atoms: list, bonds: list | None) -> tuple[list[str], np.ndarray, list[tuple[int, int]]]:
        place = {a["serial"]: i for i, a in enumerate(atoms)}
        kept = [(place[s], place[d]) for s, d in (bonds if bonds is not None else ()) if s in place and d in place]
        return [a["element"] for a in atoms], np.array([[a["x"], a["y"], a["z"]] for a in atoms], dtype=float).reshape(-1, 3), kept

    def run(batches):
        for pdf in batches:
            got = [least_deviation(*arrays(r.atoms, r.bonds), *arrays(r.ref_atoms, r.ref_bonds), steps) for r in pdf.itertuples(index=False)]
            out = pd.DataFrame({"t": pdf["t"], "p": pdf["p"], "status": [s for s, _ in got], "rmsd": [float("nan") if d is None else d for _, d in got]})
            yield out

    kinds = dict(rows.dtypes)
    named = rows.select(F.col(target).alias("t"), F.col(pose).alias("p"), "atoms", "bonds", "ref_atoms", "ref_bonds")
    out = named.mapInPandas(run, f"t {kinds[target]}, p {kinds[pose]}, status string, rmsd double")
    rmsd = F.when(~F.isnan("rmsd"), F.col("rmsd"))
    if strict:
        wrong = F.concat(F.lit("ligand atoms can't be matched: "), F.col("status"))
        rmsd = F.when(F.col("status").isin("ok", "not_proved", "in_order"), rmsd).otherwise(F.raise_error(wrong).cast("double"))
    return out.select(F.col("t").alias(target), F.col("p").alias(pose), "status", rmsd.alias("rmsd"))
