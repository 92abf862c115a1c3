"""Writers: ordered CSV, JSON without non-finite numbers, a folder for each key, hashes, Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def in_order(df: DataFrame, columns: Sequence[str] | None = None, sort: bool = False) -> DataFrame:
    """Fixed columns (lacking ones empty, others dropped), or all, sorted by name if asked for."""
    if columns is None:
        return df.select(*sorted(df.columns)) if sort else df
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, sort: bool = False) -> None:
    in_order(df, columns, sort).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def json_safe(df: DataFrame) -> DataFrame:
    """nan and infinite numbers as null."""
    return df.select(*((F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)) for c, t in df.dtypes))


def write_json(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_by_key(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def hashes(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """path, exists, bytes, sha256 of the expected file names below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return expected.join(found, "path", "left").withColumn("exists", F.col("bytes").isNotNull())


def displaced(atoms: DataFrame, shifts: DataFrame, key: list[str]) -> DataFrame:
    """atoms with every atom of a residue moved by its residue's dx, dy, dz; residues without a shift stay."""
    moved = atoms.join(shifts.select(*key, "dx", "dy", "dz"), key, "left")
    return moved.withColumns({c: F.col(c) + F.coalesce(f"d{c}", F.lit(0.0)) for c in "xyz"}).drop("dx", "dy", "dz")


def atom_line(serial: Column, atom: Column, resname: Column, chain: Column, resseq: Column, x: Column, y: Column, z: Column) -> Column:
    return F.format_string("ATOM  %5d  %-3s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", serial, atom, resname, chain, resseq, x, y, z, F.lit(1.0), F.lit(0.0))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table for a report: at most `most` rows, as it is for reading."""
    rows = df.limit(most).collect()
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])
