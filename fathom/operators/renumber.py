"""New serial numbers for atoms of ordered files of any length, with a TER record at each change of chain.

Two passes: lines are dealt by ranges of their order, and each range counts its lines and chain changes; the
counts of earlier ranges, and the chain that the range before ended with, then give each line its number. No
task sorts a whole file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.streaming.incremental import stored



def chosen_atoms(atoms: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """One line for each atom: a blank alternative first, then A, then the highest occupancy, then the mark; at the place of the atom's first line."""
    mark = F.coalesce(F.trim("altloc"), F.lit(""))
    rank = F.struct((mark != "").cast("int"), (mark != "A").cast("int"), -F.coalesce("occupancy", F.lit(0.0)), mark, F.col("line_no"))
    rest = [c for c in atoms.columns if c not in {*by, *key, "line_no"}]
    best = atoms.groupBy(*by, *key).agg(F.min("line_no").alias("line_no"), F.min_by(F.struct(*rest) if rest else F.lit(None), rank).alias("_best"))
    return best.select(*by, *key, "line_no", *(F.col(f"_best.{c}").alias(c) for c in rest))


def renumbered(lines: DataFrame, by: Sequence[str], order: str, chain: str, residue: str) -> DataFrame:
    """by, record (ATOM or TER), serial, chain, residue, and the line's order (null for TER).

    Serials run from 1 in each file, through ATOM and TER lines alike; a TER stands between chains, with the
    residue before it, and at the file's end. A null chain is a chain of its own.
    """
    named = lines.select(F.struct(*by).alias("f") if by else F.struct(F.lit(0).alias("one")).alias("f"), F.col(order).alias("o"), F.coalesce(F.col(chain).cast("string"), F.lit("")).alias("c"), F.col(residue).alias("r"))
    kept = stored(named.repartitionByRange("f", "o").sortWithinPartitions("f", "o").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    inside = Window.partitionBy("f", "part").orderBy("at")
    rows = kept.withColumns({"n": F.row_number().over(inside), "c0": F.lag("c").over(inside), "r0": F.lag("r").over(inside)})
    rows = rows.withColumn("changes", F.sum(F.coalesce((F.col("c") != F.col("c0")).cast("int"), F.lit(0))).over(inside))
    ranges = rows.groupBy("f", "part").agg(F.max("n").alias("lines"), F.max("changes").alias("inner"), F.min_by("c", "n").alias("head"), F.max_by("c", "n").alias("tail"), F.max_by("r", "n").alias("tail_r"))
    file = Window.partitionBy("f").orderBy("part")
    before = lambda c: F.coalesce(F.sum(c).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumns({"last_c": F.lag("tail").over(file), "last_r": F.lag("tail_r").over(file)})
    ranges = ranges.withColumn("border", F.coalesce((F.col("head") != F.col("last_c")).cast("int"), F.lit(0)))
    ranges = ranges.withColumns({"offset": before("lines") + before("inner") + before("border") + F.col("border"), "final": F.lead("part").over(file).isNull()})
    ranges = stored(ranges)
    placed = rows.join(ranges.select("f", "part", "offset", "last_c", "last_r", "border"), ["f", "part"])
    serial = (F.col("offset") + F.col("n") + F.col("changes")).cast("bigint")
    changed = F.coalesce(F.col("c") != F.col("c0"), (F.col("n") == 1) & (F.col("border") == 1))
    atom = F.struct(F.lit("ATOM").alias("record"), serial.alias("serial"), F.col("c"), F.col("r"), F.col("o"))
    ter = F.struct(F.lit("TER").alias("record"), (serial - 1).alias("serial"), F.coalesce("c0", "last_c").alias("c"), F.when(F.col("n") == 1, F.col("last_r")).otherwise(F.col("r0")).alias("r"), F.lit(None).cast(lines.schema[order].dataType).alias("o"))
    body = placed.select("f", F.explode(F.when(changed, F.array(ter, atom)).otherwise(F.array(atom))).alias("x")).select("f", "x.*")
    end = ranges.where("final").select("f", F.lit("TER").alias("record"), (F.col("offset") + F.col("lines") + F.col("inner") + 1).cast("bigint").alias("serial"), F.col("tail").alias("c"), F.col("tail_r").alias("r"), F.lit(None).cast(lines.schema[order].dataType).alias("o"))
    return body.unionByName(end).select(*(F.col(f"f.{c}").alias(c) for c in by), "record", "serial", F.col("c").alias(chain), F.col("r").alias(residue), F.col("o").alias(order))


def ter_line(serial: str, residue_name: Column | str, chain: str, place: Column | str) -> Column:
    """The text of a TER record; place: residue number and insertion code, five characters."""
    return F.concat(F.lit("TER   "), F.lpad(F.col(serial).cast("string"), 5, " "), F.lit("      "), F.lpad(residue_name, 3, " "), F.lit(" "), F.when(F.trim(chain) != "", F.col(chain)).otherwise(" "), place)
