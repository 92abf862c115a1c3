"""Grouped geometry: rigid fits, sequence alignment, principal frames, elastic networks.

A group is one structure (hundreds of residues), so that a group's arrays fit a task; groups spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def kabsch(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation r and shift t with p @ r.T + t nearest to q, without reflections; three points at least."""
    if p.shape != q.shape or len(p) < 3:
        raise ValueError("need two equal sets of three points or more")
    a, b = p.mean(axis=0), q.mean(axis=0)
    u, _, vt = np.linalg.svd((p - a).T @ (q - b))
    d = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    r = vt.T @ np.diag([1.0, 1.0, d]) @ u.T
    return r, b - r @ a


def trimmed_kabsch(p: np.ndarray, q: np.ndarray, share: float = 0.6, least: int = 10, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Refit on the closest points as long as their deviation, after the refit, falls."""
    if rounds <= 0 or not 0 < share <= 1:
        raise ValueError("need a positive number of rounds and a share in (0, 1]")
    best, low = kabsch(p, q), np.inf
    for _ in range(rounds):
        r, t = best
        core = np.argsort(np.linalg.norm(p @ r.T + t - q, axis=1), kind="stable")[: min(len(p), max(least, int(share * len(p))))]
        if len(core) < 3:
            break
        r, t = kabsch(p[core], q[core])
        rms = float(np.sqrt(((p[core] @ r.T + t - q[core]) ** 2).sum(axis=1).mean()))
        if rms >= low:
            break
        best, low = (r, t), rms
    return best


_MOTION = [*(f"r{i}{j}" for i in range(3) for j in range(3)), "t0", "t1", "t2"]


def fits(pairs: DataFrame, core: str | None = None) -> DataFrame:
    """sample_id and the rigid motion (r00 to r22, t0 to t2) of x, y, z onto u, v, w; null below three points.

    core: a boolean column; the fit uses these points where there are three or more of them. One aggregate
    makes the sums of a sample, and the 3 x 3 systems of many samples are solved together.
    """
    inner = lambda c: F.when(F.col(core), F.col(c)) if core else F.col(c)
    aggs = []
    for tag, at in (("a", F.col), ("c", inner)):
        aggs.append(F.count(at("x")).alias(f"{tag}n"))
        aggs += [F.avg(at(c)).alias(f"{tag}{c}") for c in "xyzuvw"]
        aggs += [F.covar_pop(at(i), at(j)).alias(f"{tag}{i}{j}") for i in "xyz" for j in "uvw"]
    sums = pairs.groupBy("sample_id").agg(*aggs)

    def run(batches):
        for pdf in batches:
            use = pdf["cn"].to_numpy() >= 3
            value = lambda name: np.where(use, pdf[f"c{name}"].to_numpy(float), pdf[f"a{name}"].to_numpy(float))  # noqa: E731, B023
            a, b = (np.stack([value(c) for c in cs], axis=1) for cs in ("xyz", "uvw"))
            h = np.stack([value(i + j) for i in "xyz" for j in "uvw"], axis=1).reshape(-1, 3, 3)
            good = value("n") >= 3
            u, _, vt = np.linalg.svd(np.where(good[:, None, None], h, 0.0))
            v, ut = vt.transpose(0, 2, 1), u.transpose(0, 2, 1)
            d = np.sign(np.linalg.det(v @ ut))
            v = v * np.stack([np.ones_like(d), np.ones_like(d), np.where(d == 0, 1.0, d)], axis=1)[:, None, :]
            r = v @ ut
            t = b - (r @ a[:, :, None])[:, :, 0]
            cells = np.concatenate([r.reshape(-1, 9), t], axis=1)
            cells[~good] = np.nan
            yield pd.DataFrame({"sample_id": pdf["sample_id"], **{c: cells[:, k] for k, c in enumerate(_MOTION)}})

    kind = pairs.schema["sample_id"].dataType.simpleString()
    out = sums.mapInPandas(run, f"sample_id {kind}, " + ", ".join(f"{c} double" for c in _MOTION))
    return out.select("sample_id", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in _MOTION))


def _turned(xyz: tuple[str, str, str], shift: bool) -> list[Column]:
    """The point or vector in the columns xyz after the motion."""
    return [sum((F.col(f"r{i}{j}") * F.col(c) for j, c in enumerate(xyz)), F.col(f"t{i}") if shift else F.lit(0.0)) for i in range(3)]


def aligned(pairs: DataFrame, core: str | None = None) -> DataFrame:
    """sample_id, idx, dx, dy, dz: displacement of x, y, z (moved onto the target) to u, v, w; 0 where no fit is possible."""
    moved = pairs.join(fits(pairs, core), "sample_id")
    d = [F.coalesce(F.col(q) - p, F.lit(0.0)).alias(f"d{c}") for q, p, c in zip("uvw", _turned(("x", "y", "z"), True), "xyz", strict=True)]
    return moved.select("sample_id", "idx", *d)


class Tables:
    """An alignment with affine gaps: scores by antidiagonals, of which two are kept, and a byte for the way back from each cell.

    Layer 0 are prefixes that end in a match, 1 in a gap of b, 2 in a gap of a. A byte holds the best layer at its
    cell, the best but for layer 1 and but for layer 2, and whether a gap in either goes on.
    """

    def __init__(self, a: str, b: str, match: float, mismatch: float, gap_open: float, gap_more: float, local: bool):
        n, m, low = len(a), len(b), -1e9
        x, y = (np.array([ord(c) for c in t], dtype=np.int64) for t in (a, b))
        none = np.full((3, n + 1), low)
        last, now = none.copy(), none.copy()
        now[0, 0] = 0
        self.n, self.m, self.local = n, m, local
        self.codes: list[np.ndarray] = []
        self.empty: list[np.ndarray] = []  # of local alignments: cells where none is worth a match
        self.first = np.maximum(0, np.arange(n + m + 1) - m)
        self.top, self.at = -np.inf, (n, m)
        self._note(0, now, none, gap_more)
        for d in range(1, n + m + 1):
            before, last, now = last, now, none.copy()
            if local:
                now[0, [k for k in (0, d) if (d <= m if k == 0 else d <= n)]] = 0
            else:
                if d <= n:
                    now[1, d] = gap_open + gap_more * (d - 1)
                if d <= m:
                    now[2, 0] = gap_open + gap_more * (d - 1)
            lo, hi = max(1, d - m), min(n, d - 1) + 1
            if lo < hi:
                here, up = slice(lo, hi), slice(lo - 1, hi - 1)
                now[1, here] = np.maximum(last[1, up] + gap_more, np.maximum(last[0, up], last[2, up]) + gap_open)
                now[2, here] = np.maximum(last[2, here] + gap_more, np.maximum(last[0, here], last[1, here]) + gap_open)
                own = np.arange(lo, hi)
                s = before[:, up].max(axis=0) + np.where(x[own - 1] == y[d - own - 1], match, mismatch)
                now[0, here] = np.maximum(0.0, s) if local else s
            self._note(d, now, last, gap_more)
        self.end = float(now[:, n].max())

    def _note(self, d: int, now: np.ndarray, last: np.ndarray, gap_more: float) -> None:
        lo, hi = int(self.first[d]), min(self.n, d) + 1
        t = now[:, lo:hi]
        code = t.argmax(axis=0).astype(np.uint8)
        for k in (1, 2):
            held = t.copy()
            held[k] = -1e9
            code |= held.argmax(axis=0).astype(np.uint8) << np.uint8(2 * k)
        i = np.arange(lo, hi)
        longer = last[1, np.maximum(i - 1, 0)] + gap_more, last[2, lo:hi] + gap_more
        on_b, on_a = (np.abs(x - y) <= 1e-8 + 1e-5 * np.abs(y) for x, y in zip(t[1:], longer, strict=True))
        on_b, on_a = on_b & (i > 1), on_a & (d - i > 1)
        self.codes.append(code | on_b.astype(np.uint8) << np.uint8(6) | on_a.astype(np.uint8) << np.uint8(7))
        if self.local:
            self.empty.append(np.packbits(t[0] <= 0))
            k = int(t[0].argmax())
            if t[0, k] > self.top or (t[0, k] == self.top and (lo + k, d - lo - k) < self.at):
                self.top, self.at = float(t[0, k]), (lo + k, d - lo - k)

    def score(self) -> float:
        return self.top if self.local else self.end

    def pairs(self) -> list[tuple[int, int]]:
        """Matched places of a best alignment; of equal ones that with matches latest, then gaps in b."""
        i, j = self.at if self.local else (self.n, self.m)
        code = lambda: int(self.codes[i + j][i - self.first[i + j]])
        layer = code() & 3
        out: list[tuple[int, int]] = []

        def worthless() -> bool:
            k = i - int(self.first[i + j])
            return self.local and bool(self.empty[i + j][k >> 3] >> (7 - (k & 7)) & 1)

        while i > 0 or j > 0:
            if layer == 0:
                if i == 0 or j == 0 or worthless():
                    break
                out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
                layer = code() & 3
                if layer == 0 and worthless():
                    break
            elif layer == 1:
                more = code() >> 6 & 1
                i -= 1
                layer = 1 if more else code() >> 2 & 3
            else:
                more = code() >> 7 & 1
                j -= 1
                layer = 2 if more else code() >> 4 & 3
        return out[::-1]


def align(a: str, b: str, match: float = 2, mismatch: float = -3, gap_open: float = -8, gap_more: float = -0.5, local: bool = False) -> list[tuple[int, int]]:
    """Matched places of the best alignment with affine gaps."""
    return Tables(a, b, match, mismatch, gap_open, gap_more, local).pairs()


def local_alignments(most: int = 4096) -> Callable[[str, str], tuple[float, np.ndarray]]:
    """A function for score and matched places of two chains; equal sequences recur among chains and samples, so that the last ones are kept."""

    @lru_cache(maxsize=most)
    def aligned(a: str, b: str) -> tuple[float, np.ndarray]:
        tables = Tables(a, b, 2.0, -4.0, -10.0, -0.5, True)
        return tables.score(), np.array(tables.pairs(), dtype=np.int32).reshape(-1, 2)

    return aligned


def select_chain(chains: DataFrame, requested: str | None = None) -> DataFrame:
    """One chain of each sample: the one that the column `requested` names, an error where it isn't there; the longest, of equal ones the first, where it is null.

    chains: sample_id, pos, chain, sequence.
    """
    wish = F.col(requested) if requested else F.lit(None).cast("string")
    key = F.struct(F.coalesce(F.col("chain") == wish, F.lit(False)), F.length("sequence"), -F.col("pos"))
    best = chains.groupBy("sample_id").agg(F.max_by(F.struct(*chains.columns), key).alias("c"), F.max(wish).alias("wish"))
    found = F.when(F.col("wish").isNull() | (F.col("c.chain") == F.col("wish")), F.col("c.chain")).otherwise(F.raise_error(F.concat(F.lit("no chain "), "wish")).cast("string"))
    return best.select(*(found.alias(c) if c == "chain" else F.col(f"c.{c}").alias(c) for c in chains.columns))


def displacement_target(first: DataFrame, second: DataFrame, core: DataFrame | None = None, ratio: float = 0.4, least: int = 15, identity: float = 0.9) -> DataFrame:
    """Displacement of every aligned residue between the best pair of chains of two structures.

    first, second: sample_id, pos, chain, sequence, ids (array<string>), xyz (array<array<double>>), a row for each
    chain. Pairs of chains whose lengths have a ratio of `ratio` or more are scored by local alignment; the
    best one, of equal ones the first, is fitted: on the residues of `core` (sample_id, ids: array<string>) if
    given, else on the closest residues, refitted. A sample without a target has one row that says why in
    `status`: no_alignable_chains, alignment_too_short, low_identity or core_too_small. A structure's chains are
    one row of the job, as their number and length are bounded by the molecule.
    """
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chain", "sequence", "ids", "xyz"))).alias(name))

    rows = packed(first, "a").join(packed(second, "b"), "sample_id", "full")
    rows = rows.join(core.select("sample_id", F.col("ids").alias("core")), "sample_id", "left") if core is not None else rows.withColumn("core", F.lit(None).cast("array<string>"))
    kind = first.schema["sample_id"].dataType.simpleString()
    columns = ["sample_id", "status", "chain_a", "chain_b", "n", "identity", "idx", "a_idx", "b_idx", "residue_id", "dx", "dy", "dz", "ax", "ay", "az"]

    def target(a: list, b: list, ids, aligned) -> dict | str:
        best, chosen = -np.inf, None
        for x in a:
            for y in b:
                small, large = sorted((len(x["sequence"]), len(y["sequence"])))
                if large and small / large >= ratio:
                    score, at = aligned(x["sequence"], y["sequence"])
                    if score > best:
                        best, chosen = score, (x, y, at)
        if chosen is None:
            return "no_alignable_chains"
        x, y, at = chosen
        if len(at) < least:
            return "alignment_too_short"
        same = float(np.mean([x["sequence"][i] == y["sequence"][j] for i, j in at]))
        if same < identity:
            return "low_identity"
        p, q = np.stack(list(x["xyz"]))[at[:, 0]], np.stack(list(y["xyz"]))[at[:, 1]]
        names = [x["ids"][i] for i in at[:, 0]]
        if ids is not None:
            use = np.isin(names, list(ids))
            if use.sum() < 3:
                return "core_too_small"
            r, t = kabsch(p[use], q[use])
        else:
            r, t = trimmed_kabsch(p, q)
        moved = p @ r.T + t
        n = len(at)
        out = {"status": ["ok"] * n, "chain_a": [x["chain"]] * n, "chain_b": [y["chain"]] * n, "n": [n] * n, "identity": [same] * n, "idx": range(n), "a_idx": at[:, 0], "b_idx": at[:, 1], "residue_id": names}
        return out | {f"d{c}": (q - moved)[:, k] for k, c in enumerate("xyz")} | {f"a{c}": moved[:, k] for k, c in enumerate("xyz")}

    number, text = pa.int64(), pa.string()
    kinds = dict(zip(columns, (to_arrow_type(first.schema["sample_id"].dataType), text, text, text, number, pa.float64(), number, number, number, text, *[pa.float64()] * 6), strict=True))

    def run(batches):
        known = local_alignments()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in kinds}
            for row in batch.to_pylist():
                got = target(row["a"] or [], row["b"] or [], row["core"], known)
                got = {"status": [got]} if isinstance(got, str) else got
                n = len(got["status"])
                for c, cells in out.items():
                    cells.extend([row["sample_id"]] * n if c == "sample_id" else got[c] if c in got else [None] * n)
            yield pa.RecordBatch.from_pydict({c: pa.array(out[c], t) for c, t in kinds.items()})

    schema = f"sample_id {kind}, status string, chain_a string, chain_b string, n bigint, identity double, idx bigint, a_idx bigint, b_idx bigint, residue_id string, dx double, dy double, dz double, ax double, ay double, az double"
    return rows.mapInArrow(run, schema)


def pair_samples(targets: DataFrame, features: DataFrame, manifest: DataFrame) -> DataFrame:
    """Training residues: targets that are ok with their regions' features and their sample's conditions.

    features: sample_id, residue_id and columns such as region_id, loss_weight, is_eval; a residue without a row
    has nulls. manifest: sample_id and columns such as family_id and split, one row for each sample; a sample
    that it lacks is left out.
    """
    return targets.where("status = 'ok'").join(features, ["sample_id", "residue_id"], "left").join(manifest, "sample_id")


def alignment_pairs(pairs: DataFrame, **scores) -> DataFrame:
    """key, a_idx, b_idx of the aligned places of the strings a and b of each row."""

    def run(batches):
        for pdf in batches:
            rows = [(k, i, j) for k, a, b in zip(pdf["key"], pdf["a"], pdf["b"], strict=True) for i, j in align(a, b, **scores)]
            yield pd.DataFrame(rows, columns=["key", "a_idx", "b_idx"])

    return pairs.select("key", "a", "b").mapInPandas(run, "key bigint, a_idx bigint, b_idx bigint")


def gapped_pairs(rows: DataFrame) -> DataFrame:
    """key, a_idx, b_idx of the columns where both gapped strings a and b have a letter."""
    letters = lambda c: F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1))
    cells = rows.select("key", F.posexplode(F.arrays_zip(letters("a").alias("a"), letters("b").alias("b"))).alias("pos", "c"))
    w = Window.partitionBy("key").orderBy("pos")
    place = lambda s: (F.sum((F.col(f"c.{s}") != "-").cast("int")).over(w) - 1).cast("bigint")
    return cells.withColumns({"a_idx": place("a"), "b_idx": place("b")}).where("c.a <> '-' and c.b <> '-'").select("key", "a_idx", "b_idx")


def moments(points: DataFrame) -> DataFrame:
    """Centre and covariance of each sample's points, by plain aggregates."""
    aggs = [F.avg(c).alias(f"c{c}") for c in "xyz"] + [F.covar_pop(a, b).alias(f"v{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return points.groupBy("sample_id").agg(F.count("*").alias("n"), *aggs)


def frames(points: DataFrame) -> DataFrame:
    """Centre and main axis (unit, its largest component positive) of each sample."""

    def run(batches):
        for pdf in batches:
            axes = []
            for r in pdf.itertuples():
                _, v = np.linalg.eigh(np.array([[r.vxx, r.vxy, r.vxz], [r.vxy, r.vyy, r.vyz], [r.vxz, r.vyz, r.vzz]]))
                a = v[:, -1]
                axes.append(a * np.sign(a[np.abs(a).argmax()]))
            axes = np.array(axes).reshape(-1, 3)
            yield pdf[["sample_id", "n", "cx", "cy", "cz"]].assign(ax=axes[:, 0], ay=axes[:, 1], az=axes[:, 2])

    return moments(points).mapInPandas(run, "sample_id bigint, n bigint, cx double, cy double, cz double, ax double, ay double, az double")


_AXES = [f"e{i}{j}" for i in range(3) for j in range(3)]


def axes(points: DataFrame) -> DataFrame:
    """sample_id, centre and three right-handed axes (e00 to e22, an axis in each row) of each sample, by falling variance.

    An axis points where its largest component is positive; the third is the product of the others.
    """

    def run(batches):
        for pdf in batches:
            v = pdf[["vxx", "vxy", "vxz", "vxy", "vyy", "vyz", "vxz", "vyz", "vzz"]].to_numpy(float).reshape(-1, 3, 3)
            _, e = np.linalg.eigh(v)
            e = e[:, :, ::-1].transpose(0, 2, 1)[:, :2]
            e = e * np.sign(np.take_along_axis(e, np.abs(e).argmax(axis=2)[:, :, None], axis=2))
            e = np.concatenate([e, np.cross(e[:, 0], e[:, 1])[:, None]], axis=1).reshape(-1, 9)
            yield pdf[["sample_id", "cx", "cy", "cz"]].assign(**{c: e[:, k] for k, c in enumerate(_AXES)})

    kind = points.schema["sample_id"].dataType.simpleString()
    return moments(points).mapInPandas(run, f"sample_id {kind}, cx double, cy double, cz double, " + ", ".join(f"{c} double" for c in _AXES))


def in_axes(rows: DataFrame, frame: DataFrame, xyz: tuple[str, str, str], vectors: bool = False) -> DataFrame:
    """rows with their points (or vectors) in each sample's axes."""
    both = rows.join(frame, "sample_id")
    at = [F.col(c) - (0.0 if vectors else F.col(f"c{o}")) for c, o in zip(xyz, "xyz", strict=True)]
    return both.withColumns({c: sum((F.col(f"e{i}{j}") * at[j] for j in range(3)), F.lit(0.0)) for i, c in enumerate(xyz)}).select(*rows.columns)


def from_axes(rows: DataFrame, frame: DataFrame, xyz: tuple[str, str, str], vectors: bool = False) -> DataFrame:
    """The inverse of in_axes."""
    both = rows.join(frame, "sample_id")
    return both.withColumns({c: sum((F.col(f"e{i}{j}") * F.col(xyz[i]) for i in range(3)), F.lit(0.0) if vectors else F.col(f"c{'xyz'[j]}")) for j, c in enumerate(xyz)}).select(*rows.columns)


def aligned_scores(rows: DataFrame) -> DataFrame:
    """key, idx, score of each place of `part`, from `scores` of the places of `whole` that it is aligned with; the median of the scores elsewhere."""

    def run(batches):
        for pdf in batches:
            for key, whole, part, scores in zip(pdf["key"], pdf["whole"], pdf["part"], pdf["scores"], strict=True):
                x = np.full(len(part), float(np.median(scores)) if len(scores) else 0.0)
                for i, j in align(whole, part) if whole and part else []:
                    if i < len(scores):
                        x[j] = scores[i]
                yield pd.DataFrame({"key": key, "idx": np.arange(len(part)), "score": x})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", F.coalesce("whole", F.lit("")).alias("whole"), F.coalesce("part", F.lit("")).alias("part"), F.coalesce("scores", F.array().cast("array<double>")).alias("scores")).mapInPandas(run, f"key {kind}, idx bigint, score double")


def mobility(points: DataFrame, radius: float, modes: int = 20) -> DataFrame:
    """sample_id, idx, gnm, anm: squared amplitudes of the lowest modes above 1e-8, over their eigenvalues."""

    def low(h: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(h)
        use = np.flatnonzero(w > 1e-8)[:modes]
        return (v[:, use] ** 2 / w[use]).sum(axis=1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x = pdf[["x", "y", "z"]].to_numpy(float)
        n = len(x)
        d = x[:, None] - x[None]
        d2 = (d**2).sum(axis=2)
        near = (d2 <= radius * radius) & (d2 > 1e-12)
        g = -near.astype(float)
        np.fill_diagonal(g, near.sum(axis=1))
        blocks = np.where(near[:, :, None, None], -d[:, :, :, None] * d[:, :, None, :] / np.where(near, d2, 1)[:, :, None, None], 0.0)
        blocks[np.arange(n), np.arange(n)] = -blocks.sum(axis=1)
        a = low(blocks.transpose(0, 2, 1, 3).reshape(3 * n, 3 * n)).reshape(n, 3).sum(axis=1)
        return pd.DataFrame({"sample_id": pdf["sample_id"], "idx": pdf["idx"], "gnm": low(g), "anm": a})

    return points.groupBy("sample_id").applyInPandas(run, "sample_id bigint, idx bigint, gnm double, anm double")


def transferred(rows: DataFrame) -> DataFrame:
    """Donor displacements dx, dy, dz turned into each target's frame: the fit of x, y, z onto u, v, w, by `core`, rotates them."""
    moved = rows.join(fits(rows, "core"), "sample_id")
    return moved.select("sample_id", "idx", *(F.coalesce(c, F.lit(0.0)).alias(p) for c, p in zip(_turned(("dx", "dy", "dz"), False), ("px", "py", "pz"), strict=True)))


def averaged_transfers(rows: DataFrame) -> DataFrame:
    """Mean of the candidates' non-zero vectors for each target residue."""
    some = F.when(F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2) > 0, 1)
    n = F.greatest(F.count(some), F.lit(1))
    return rows.groupBy("sample_id", "idx").agg(*((F.sum(c) / n).alias(c) for c in ("px", "py", "pz")))
