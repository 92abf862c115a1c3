"""Rows of a manifest from nested entries and their entities, and external result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_id(ids: str) -> Column:
    """The first id of an array that isn't blank."""
    return F.get(F.filter(ids, lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(0))


def greatest_coverage(alignments: str) -> Column:
    """The highest coverage among alignments (structs with coverage), null without one."""
    return F.array_max(F.transform(alignments, lambda a: a["coverage"]))


def least_resolution(values: str) -> Column:
    """The best (lowest) positive resolution of an array."""
    return F.array_min(F.filter(values, lambda x: x > 0))


def compound_ids(ligands: str) -> Column:
    """Distinct compound ids in upper case, sorted, joined by semicolons; empty for none."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(ligands, lambda x: F.upper(F.trim(x))), lambda x: x.isNotNull() & (x != "")))), ";")


def entity_rows(entities: DataFrame, entries: DataFrame, fixed: dict[str, str] | None = None) -> DataFrame:
    """A manifest row for each entity with its entry; entities whose entry isn't there are left out.

    entities: entry, entity, accessions, alignments, chains, length; entries: entry, resolutions, ligands, method. fixed: constant columns.
    """
    rows = entities.join(entries, "entry")
    own = [
        F.concat(F.lower("entry"), F.lit("_"), "entity").alias("pair_id"), F.upper("entry").alias("pdb_id"), first_id("accessions").alias("accession"), first_id("chains").alias("chain"), greatest_coverage("alignments").alias("coverage"),
        least_resolution("resolutions").alias("resolution"), compound_ids("ligands").alias("ligands"), F.col("length").alias("sequence_length"), F.coalesce("method", F.lit("")).alias("method"),
    ]
    return rows.select(*own, *(F.lit(v).alias(k) for k, v in (fixed or {}).items()))


def localisation(rows: DataFrame, methods: Sequence[str], regions: Sequence[str], seeds: Sequence[int] | None = None) -> DataFrame:
    """Rows of the methods and regions (and seeds) asked for, with their places in those lists for an ordered sort."""
    place = lambda c, order: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    out = rows.withColumns({"method_order": place("method", methods), "region_order": place("region", regions)}).where("method_order > 0 and region_order > 0")
    return out if seeds is None else out.where(F.col("seed").isin(*seeds))


def checked_list(text: str, known: Sequence[str] | None = None, numbers: bool = False, least: int | None = None) -> list:
    """Items of a comma-separated list as a plan's parameters: not empty, not repeated, known, and numbers of `least` or more."""
    items = [x.strip() for x in text.split(",") if x.strip()]
    out = [int(x) for x in items] if numbers else items
    if not out or len(set(out)) != len(out):
        raise ValueError(f"an empty list or a repeated item: {text!r}")
    if known is not None and (lost := [x for x in out if x not in known]):
        raise ValueError(f"not known: {lost}")
    if least is not None and (low := [x for x in out if x < least]):
        raise ValueError(f"below {least}: {low}")
    return out
