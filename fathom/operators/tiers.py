"""Manifests in tiers: candidates are taken tier by tier, and what one tier took is barred from the next.

In a tier candidates are examined by position. The first test that fails is a candidate's reason; a key that a
tier before has taken bars it, a key taken earlier in the same tier makes it a repeat; after `cap` accepted
ones the tier is full and those behind aren't examined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.streaming.incremental import stored



@dataclass(frozen=True)
class Test:
    """Fails where the condition holds; null counts as no failure."""

    reason: str
    failing: Column


@dataclass(frozen=True)
class Barred:
    """Fails where earlier tiers (all, or those named) have taken a row with the same keys."""

    reason: str
    keys: Sequence[str]
    tiers: Sequence[str] | None = None


@dataclass(frozen=True)
class Tier:
    """name, candidates with a unique `position`, steps in order, the key that tells repeats, the most rows taken."""

    name: str
    candidates: DataFrame
    steps: Sequence[Test | Barred]
    cap: int
    unique: Sequence[str] = ()
    repeated: str = "duplicate"
    values: dict = field(default_factory=dict)


def _flagged(rows: DataFrame, tier: Tier, taken: DataFrame | None) -> DataFrame:
    """rows with the first failing step as reason; barred keys are looked up by left joins with what was taken."""
    reason = None
    for k, step in enumerate(tier.steps):
        if isinstance(step, Test):
            test = step.failing
        else:
            if taken is None:
                continue
            from_tiers = taken if step.tiers is None else taken.where(F.col("tier").isin(*step.tiers))
            keys = from_tiers.select(*step.keys).dropna().distinct().withColumn(f"_barred{k}", F.lit(True))
            rows = rows.join(keys, list(step.keys), "left")
            test = F.col(f"_barred{k}").isNotNull()
        reason = F.when(test, f"{tier.name}_{step.reason}") if reason is None else reason.when(test, f"{tier.name}_{step.reason}")
    rows = rows.withColumn("reason", F.lit(None).cast("string") if reason is None else reason)
    return rows.drop(*(c for c in rows.columns if c.startswith("_barred")))


def select_tiers(tiers: Sequence[Tier], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Taken rows (tier, position, columns, the tier's values) and rejected ones (tier, position, columns, reason).

    Every candidate is in one of both, a rejected one with one reason: a step's, a repeat's, the same tier's
    repeat of an earlier tier's key, or `<tier>_beyond_cap`. Each tier is stored before the next reads it.
    """
    names = list(dict.fromkeys(n for t in tiers for n in t.values))
    taken, rejected = None, None
    for tier in tiers:
        steps = list(tier.steps) + ([Barred(tier.repeated, tier.unique)] if tier.unique else [])
        rows = _flagged(tier.candidates.select("position", *columns, *(c for c in tier.candidates.columns if c not in {"position", *columns})), Tier(tier.name, tier.candidates, steps, tier.cap), taken)
        if tier.unique:
            free = rows.where("reason is null")
            first = free.groupBy(*tier.unique).agg(F.min("position").alias("_first"))
            rows = rows.join(first, list(tier.unique), "left")
            late = F.col("reason").isNull() & (F.col("position") > F.col("_first"))
            rows = rows.withColumn("reason", F.when(late, f"{tier.name}_{tier.repeated}").otherwise(F.col("reason"))).drop("_first")
        rows = stored(rows.select("position", *columns, "reason"))
        # the position of the last one that fits: those behind a full tier aren't examined
        last = rows.where("reason is null").select("position").orderBy("position").limit(tier.cap).agg(F.max("position").alias("last"), F.count("*").alias("n")).first()
        full = F.col("position") > F.lit(last["last"]) if last["n"] >= tier.cap and tier.cap else F.lit(not tier.cap)
        rows = rows.withColumn("reason", F.when(full, f"{tier.name}_beyond_cap").otherwise(F.col("reason"))).withColumn("tier", F.lit(tier.name))
        mine = rows.where("reason is null").select("tier", "position", *columns, *(F.lit(tier.values.get(n)).alias(n) for n in names))
        lost = rows.where("reason is not null").select("tier", "position", *columns, "reason")
        taken, rejected = (mine, lost) if taken is None else (taken.unionByName(mine), rejected.unionByName(lost))
    return taken, rejected


def tier_report(taken: DataFrame, rejected: DataFrame, fields: Sequence[str]) -> DataFrame:
    """kind, name, n: taken rows by tier, by each field's values, and rejected rows by reason."""
    out = taken.groupBy(F.lit("tier").alias("kind"), F.col("tier").alias("name")).agg(F.count("*").alias("n"))
    for f in fields:
        out = out.unionByName(taken.groupBy(F.lit(f).alias("kind"), F.col(f).cast("string").alias("name")).agg(F.count("*").alias("n")))
    return out.unionByName(rejected.groupBy(F.lit("reason").alias("kind"), F.col("reason").alias("name")).agg(F.count("*").alias("n")))
