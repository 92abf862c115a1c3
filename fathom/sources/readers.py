"""Scans: delimited tables, JSON, matrices, structure files, tool reports. Cells stay strings until cast."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AMINO_ACIDS = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever store Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def table(spark: SparkSession, paths: str | Sequence[str], required: Sequence[str] = (), provenance: str | None = None, missing_ok: bool = False) -> DataFrame:
    """A delimited table with a header, all strings; tabs for .tsv and .tab. Several files are united by name.

    missing_ok: a file that isn't there has no rows; if none is, the table has the required columns only.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if missing_ok:
        paths = [p for p in paths if exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in required) or "value string")
    out = None
    for p in paths:
        one = spark.read.csv(p, header=True, sep="\t" if p.endswith((".tsv", ".tab")) else ",", inferSchema=False, multiLine=True, escape='"')
        if provenance:
            one = one.withColumn(provenance, F.input_file_name())
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    lacking = [c for c in required if c not in out.columns]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return out


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no from 1, value: each file is read whole, as its lines' order matters."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return numbered(whole, "file", "value")


def numbered(rows: DataFrame, key: str, text: str) -> DataFrame:
    cells = rows.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "value"))
    return cells.withColumn("line_no", F.col("line_no") + 1)


def listed_ids(lines_of: DataFrame) -> DataFrame:
    """File stems of a list with # comments and blank lines."""
    name = F.trim(F.regexp_replace("value", "#.*", ""))
    return lines_of.select(name.alias("name")).where("name <> ''").select(F.regexp_extract("name", r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1).alias("id"))


def json_objects(rows: DataFrame, column: str, schema: str, strict: bool = False) -> DataFrame:
    """rows with the parsed object; what isn't one is null, or an error if strict."""
    got = F.from_json(column, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return rows.withColumn("object", got)


def matrix_cells(rows: DataFrame, key: str, column: str, strict: bool = False) -> DataFrame:
    """key, i, j, value of a square JSON matrix, bare or in an object (or a list of one) under either usual name.

    What isn't a square matrix has no cells, or is an error if strict.
    """
    kinds = ("$.predicted_aligned_error", "$.pae", "$[0].predicted_aligned_error", "$[0].pae")
    text = F.coalesce(*(F.get_json_object(column, k) for k in kinds), F.col(column))
    m = F.from_json(text, "array<array<double>>")
    square = F.coalesce(~F.exists(m, lambda r: r.isNull() | (F.size(r) != F.size(m))) & (F.size(m) > 0), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("no square matrix for "), F.col(key).cast("string"))).cast("array<array<double>>") if strict else F.lit(None).cast("array<array<double>>")
    rows = rows.select(key, F.posexplode(F.when(square, m).otherwise(wrong)).alias("i", "row"))
    return rows.select(key, F.col("i").cast("bigint").alias("i"), F.posexplode("row").alias("j", "value")).select(key, "i", F.col("j").cast("bigint").alias("j"), "value")


def array_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, i, j, value of square numpy arrays in files; a file is one matrix, so that a task holds it whole."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                if m.ndim != 2 or m.shape[0] != m.shape[1]:
                    raise ValueError(f"no square matrix in {name}")
                i, j = np.indices(m.shape)
                yield pd.DataFrame({"path": name, "i": i.ravel(), "j": j.ravel(), "value": m.ravel().astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, i bigint, j bigint, value double")


def atoms(lines_of: DataFrame, key: str) -> DataFrame:
    """key, line_no and fields of fixed-width atom lines; coordinates fall back to blank-separated fields.

    A serial of more than five digits that pushed the rest of its line to the right, decimal points included, is read whole.
    """
    v = F.col("value")
    digits = F.length(F.regexp_extract(v, r"^.{6} *(\d+)", 1))
    dot = lambda a: F.substring(v, a, 1) == "."
    over = F.when((digits > 5) & ~(dot(35) & dot(43)), digits - 5).otherwise(0)
    rows = lines_of.where(v.startswith("ATOM") | v.startswith("HETATM")).withColumn("_over", over)
    cut = lambda a, n: F.trim(v.substr(F.lit(a) + F.col("_over"), F.lit(n)))
    parts = F.split(F.trim(v), r"\s+")
    coordinate = lambda a, k: F.coalesce(cut(a, 8).try_cast("double"), F.get(parts, F.lit(k)).try_cast("double"))
    return rows.select(
        key, "line_no", v.startswith("HETATM").alias("hetero"), F.trim(v.substr(F.lit(7), F.lit(5) + F.col("_over"))).try_cast("int").alias("serial"), cut(13, 4).alias("atom"), cut(17, 1).alias("altloc"), cut(18, 3).alias("resname"),
        cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resseq"), cut(27, 1).alias("icode"), coordinate(31, 6).alias("x"), coordinate(39, 7).alias("y"), coordinate(47, 8).alias("z"), cut(55, 6).try_cast("double").alias("occupancy"), cut(61, 6).try_cast("double").alias("b_factor"),
    )


def chains(atoms_of: DataFrame, key: str, least: int = 15) -> DataFrame:
    """C-alpha residues of the standard amino acids, numbered in each chain of `least` residues or more."""
    ca = atoms_of.where((F.col("atom") == "CA") & ~F.col("hetero") & F.col("resname").isin(*AMINO_ACIDS))
    first = Window.partitionBy(key, "chain", "resseq", "icode").orderBy("line_no")
    ca = ca.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    own = Window.partitionBy(key, "chain")
    out = ca.withColumns({"idx": F.row_number().over(own.orderBy("line_no")) - 1, "n": F.count("*").over(own)}).where(F.col("n") >= least)
    return out.withColumn("residue_id", F.concat("chain", F.lit("_"), F.col("resseq").cast("string"), "icode"))


def hits(lines_of: DataFrame, key: str, width: int, score_fields: Sequence[int]) -> DataFrame:
    """Tab-separated hits without comments and short lines, by falling score, the first finite of the fields."""
    parts = F.split("value", "\t")
    finite = lambda k: F.when(F.abs(F.get(parts, F.lit(k)).try_cast("double")) < float("inf"), F.get(parts, F.lit(k)).try_cast("double"))
    rows = lines_of.where(~F.col("value").startswith("#") & (F.size(parts) >= width))
    rows = rows.select(key, "line_no", F.get(parts, F.lit(0)).alias("query"), F.get(parts, F.lit(1)).alias("target"), F.coalesce(*map(finite, score_fields)).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key, "query").orderBy(F.desc_nulls_last("score"), "line_no")))


def carried(lines_of: DataFrame, key: str, header: str, field: str) -> DataFrame:
    """header's match carried down to the lines that match field: key, section, value."""
    w = Window.partitionBy(key).orderBy("line_no")
    section = F.last(F.nullif(F.regexp_extract("value", header, 1), F.lit("")), True).over(w)
    rows = lines_of.withColumn("section", section)
    return rows.where(F.col("value").rlike(field)).select(key, "line_no", "section", F.regexp_extract("value", field, 1).alias("value"))


def first_existing(rows: DataFrame, key: str, candidates: Sequence[str], listing: DataFrame) -> DataFrame:
    """The first of a row's candidate paths that the listing has."""
    long = rows.select(key, F.posexplode(F.array(*candidates)).alias("pos", "path")).where("path is not null")
    return long.join(listing.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "pos").alias("path"))


def docking_scores(lines_of: DataFrame, key: str) -> DataFrame:
    """Scores of result remarks in the order of their lines."""
    rows = lines_of.select(key, "line_no", F.regexp_extract("value", r"^REMARK VINA RESULT:\s+(-?\d+(?:\.\d+)?)", 1).try_cast("double").alias("score")).where("score is not null")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("line_no")))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below a path; an error where there is none."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
