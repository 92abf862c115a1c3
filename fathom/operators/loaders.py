"""Samples of loose records as one typed table of residues.

A record has arrays under several names, labels in its manifest row, its metadata or itself, and numbers that may
be one for all residues. What a sample must have is checked here, once, and named in the error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.clean import label

#: The names under which a record holds its vectors, and its labels with their fallback ids.
TARGETS = ("y_delta", "target", "displacement")
POSITIONS = ("pos", "af2_pos")
LABELS = {"family": (("family",), "family_id"), "state": (("state_label", "state"), "state_id"), "substrate": (("substrate_class", "substrate"), "substrate_id")}


def first_column(rows: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns that df has and that isn't null."""
    have = [F.col(n) for n in names if n in rows.columns]
    return F.coalesce(*have) if have else F.lit(None)


def field(rows: DataFrame, names: Sequence[str], fallback: str) -> Column:
    """A label: for each name the manifest row's, the metadata's, the record's own; else id_<number>; else unknown."""
    options = []
    for n in names:
        for source in ("manifest_row", "metadata"):
            if source in rows.columns:
                options.append(F.nullif(F.col(source)[n], F.lit("")))
        if n in rows.columns:
            options.append(F.nullif(F.col(n).cast("string"), F.lit("")))
    number = F.concat(F.lit("id_"), F.col(fallback).cast("bigint").cast("string")) if fallback in rows.columns else F.lit(None)
    named = F.coalesce(*options) if options else F.lit(None).cast("string")
    return F.when(named.isNotNull(), label(named)).otherwise(F.coalesce(number, F.lit("unknown")))


def load_samples(records: DataFrame, vocabularies: Mapping[str, Sequence[str]] | None = None, key: str = "sample_id") -> DataFrame:
    """key, idx, x, y, z, tx, ty, tz, plddt, family, state, substrate: one row for each residue.

    records: a row for each sample with arrays of vectors under one of TARGETS and of POSITIONS, plddt (an array),
    manifest_row and metadata (maps of strings), labels and ids. A sample without vectors or positions, or whose
    lengths differ, is an error that names it; plddt of one value holds for all residues, of another wrong
    length it is 0. vocabularies: the labels that are known, by name; others are an error.
    """
    target, pos = first_column(records, TARGETS), first_column(records, POSITIONS)
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col(key).cast("string"))).cast("array<array<double>>")
    target = F.coalesce(target.cast("array<array<double>>"), fail("no target vectors in "))
    pos = F.coalesce(pos.cast("array<array<double>>"), fail("no start coordinates in "))
    labels = {n: field(records, *names) for n, names in LABELS.items()}
    for n, known in (vocabularies or {}).items():
        wrong = F.raise_error(F.concat(F.lit(f"unknown {n} "), labels[n], F.lit(" in "), F.col(key).cast("string"))).cast("string")
        labels[n] = F.when(labels[n].isin(*known), labels[n]).otherwise(wrong)
    rows = records.select(key, target.alias("t"), pos.alias("p"), (F.col("plddt") if "plddt" in records.columns else F.lit(None)).cast("array<double>").alias("l"), *(c.alias(n) for n, c in labels.items()))
    rows = rows.withColumn("p", F.when(F.size("p") == F.size("t"), F.col("p")).otherwise(fail("coordinates and targets differ in length in ")))
    rows = rows.withColumn("p", F.when(F.exists("p", lambda v: F.size(v) != 3) | F.exists("t", lambda v: F.size(v) != 3), fail("vectors without three numbers in ")).otherwise(F.col("p")))
    one = F.when(F.size("l") == F.size("t"), F.col("l")).when(F.size("l") == 1, F.array_repeat(F.col("l")[0], F.size("t"))).otherwise(F.array_repeat(F.lit(0.0), F.size("t")))
    long = rows.select(key, *LABELS, F.posexplode(F.arrays_zip(F.col("p"), F.col("t"), one.alias("l"))).alias("idx", "v"))
    return long.select(key, F.col("idx").cast("bigint").alias("idx"), *(F.col("v.p")[k].alias(c) for k, c in enumerate("xyz")), *(F.col("v.t")[k].alias(f"t{c}") for k, c in enumerate("xyz")), F.col("v.l").alias("plddt"), *LABELS)
