"""One sample shown in full: lines of its structures, centroids of its regions; and audits of what a figure needs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The regions by precedence, with the residue name and the number that mark them in a structure's lines.
CODES = (("tonb_box", "TON", 100.0), ("plug", "PLG", 80.0), ("barrel_core", "BAR", 60.0), ("eval", "EVL", 40.0))
OTHER = ("other", "GLY", 20.0)


def region_code(regions: Column) -> Column:
    """region, name and mark (a struct) of a residue with an array of regions: the first by precedence."""
    pack = lambda region, name, mark: F.struct(F.lit(region).alias("region"), F.lit(name).alias("name"), F.lit(mark).alias("mark"))
    out = None
    for code in CODES:
        test = F.array_contains(regions, code[0])
        out = F.when(test, pack(*code)) if out is None else out.when(test, pack(*code))
    return out.otherwise(pack(*OTHER))


def place_of(residue_id: Column) -> tuple[Column, Column]:
    """Chain (one character, A where there is none) and number (0 where there is none) of <chain>_<number>."""
    parted = residue_id.contains("_")
    chain = F.when(parted, F.substring(F.substring_index(residue_id, "_", 1), 1, 1)).otherwise("A")
    rest = F.when(parted, F.regexp_replace(residue_id, "^[^_]*_", "")).otherwise(residue_id)
    digits = F.regexp_replace(rest, "[^0-9-]", "")
    return F.when(chain == "", "A").otherwise(chain), F.coalesce(F.trim(rest).try_cast("int"), digits.try_cast("int"), F.lit(0))


def stacked(residues: DataFrame, structures: Mapping[str, str]) -> DataFrame:
    """residues once for each structure: x, y, z of the start, moved by the displacement with the structure's prefix ('' for none)."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("structure"), *((F.col(c) + F.col(f"{p}{c}") if p else F.col(c)).alias(f"at_{c}") for c in "xyz")) for n, p in structures.items())))
    return residues.withColumn("_s", rows).select(*residues.columns, "_s.*")


def case_lines(residues: DataFrame, structures: Mapping[str, str]) -> DataFrame:
    """sample_id, structure, line_no, line: fixed-width lines of every structure, in the order of idx, and END.

    residues: sample_id, idx, residue_id, regions (an array), x, y, z and displacements. A case is one sample.
    """
    chain, number = place_of(F.col("residue_id"))
    serial = F.row_number().over(Window.partitionBy("sample_id", "structure").orderBy("idx"))
    rows = stacked(residues, structures).withColumns({"line_no": serial, "code": region_code(F.col("regions"))})
    line = F.format_string("ATOM  %5d  CA  %3s %1s%4d    %8.3f%8.3f%8.3f  1.00%6.2f           C", "line_no", "code.name", chain, number, "at_x", "at_y", "at_z", "code.mark")
    out = rows.select("sample_id", "structure", "line_no", line.alias("line"))
    return out.unionByName(out.groupBy("sample_id", "structure").agg((F.max("line_no") + 1).alias("line_no"), F.lit("END").alias("line")))


def case_centroids(residues: DataFrame, structures: Mapping[str, str]) -> DataFrame:
    """sample_id, region, structure, centroid and its shift from the first structure's, with the region's residues."""
    first = next(iter(structures))
    rows = stacked(residues, structures).withColumn("region", F.explode("regions"))
    out = rows.groupBy("sample_id", "region", "structure").agg(*(F.avg(f"at_{c}").alias(f"centroid_{c}") for c in _XYZ), F.count("*").alias("n_residues"))
    base = out.where(F.col("structure") == first).select("sample_id", "region", *(F.col(f"centroid_{c}").alias(f"base_{c}") for c in _XYZ))
    out = out.join(base, ["sample_id", "region"]).withColumns({f"delta_{c}": F.col(f"centroid_{c}") - F.col(f"base_{c}") for c in _XYZ})
    shift = F.sqrt(sum((F.col(f"delta_{c}") * F.col(f"delta_{c}") for c in _XYZ), F.lit(0.0)))
    return out.withColumn("displacement", shift).drop(*(f"base_{c}" for c in _XYZ))


_XYZ = ("x", "y", "z")


def audit(figures: DataFrame, listing: DataFrame, formats: Sequence[str], caveats: Sequence[str] = ()) -> DataFrame:
    """figure_id, technical_status, scientific_status, missing_sources and missing_outputs of every figure, in order of name.

    figures: figure_id, sources (array of paths), output (path without ending); listing: path of every file that
    is there. A figure passes if all its sources and its output in every format are there.
    """
    ends = F.array(*map(F.lit, formats))
    wanted = F.concat(F.transform("sources", lambda s: F.struct(F.lit("source").alias("kind"), s.alias("path"))), F.transform(ends, lambda e: F.struct(F.lit("output").alias("kind"), F.concat("output", F.lit("."), e).alias("path"))))
    long = figures.select("figure_id", F.explode(wanted).alias("w")).select("figure_id", "w.*")
    gone = long.join(listing.select("path").distinct(), "path", "left_anti")
    text = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("path")))), ";")
    lost = gone.groupBy("figure_id").agg(text("source").alias("missing_sources"), text("output").alias("missing_outputs"))
    out = figures.select("figure_id").join(lost, "figure_id", "left").fillna("", ["missing_sources", "missing_outputs"])
    caveat = F.when(F.col("figure_id").isin(*caveats), "fit_for_stated_claim_with_caveat").otherwise("fit_for_stated_claim") if caveats else F.lit("fit_for_stated_claim")
    return out.select("figure_id", F.when((F.col("missing_sources") == "") & (F.col("missing_outputs") == ""), "pass").otherwise("needs_attention").alias("technical_status"), caveat.alias("scientific_status"), "missing_sources", "missing_outputs")
