"""Nested records, keys, strict lookups, and tables around ligands and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.clean import blank_to_null, number


def marked(entries: str, field: str, ids: Sequence[str]) -> Column:
    """Whether an array of structs has an entry whose field is one of ids."""
    return F.coalesce(F.exists(entries, lambda e: e[field].isin(*ids)), F.lit(False))


def mentions(text: Column, wanted: Sequence[str], unless: str | None = None) -> Column:
    """A wanted word in lower case, unless a pattern is there too."""
    low, hit = F.lower(text), F.lit(False)
    for w in wanted:
        hit = hit | low.contains(w)
    return hit if unless is None else hit & ~low.rlike(unless)


def flat_text(entries: str, *fields: str) -> Column:
    """All fields of an array of structs as one text."""
    return F.concat_ws(" ", F.flatten(F.transform(entries, lambda e: F.array_compact(F.array(*(e[f].cast("string") for f in fields))))))


def slug(*parts: Column | str) -> Column:
    """Parts joined by _, in lower case, with all but letters, digits, _, . and - as _."""
    return F.regexp_replace(F.lower(F.concat_ws("_", *parts)), r"[^a-z0-9_.\-]+", "_")


def short_labels(rows: DataFrame, label: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Labels made unique by an ordinal behind the second and later of a kind."""
    k = F.row_number().over(Window.partitionBy(*by, label).orderBy(*order))
    return rows.withColumn("short", F.when(k == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" #"), k.cast("string"))))


def first_complete(df: DataFrame, groups: Sequence[Sequence[str]], names: Sequence[str]) -> Column:
    """A struct of numbers from the first group of columns all of which hold one."""
    options = []
    for group in groups:
        if all(c in df.columns for c in group):
            cells = [number(c) for c in group]
            test = cells[0].isNotNull()
            for c in cells[1:]:
                test = test & c.isNotNull()
            options.append(F.when(test, F.struct(*(c.alias(n) for c, n in zip(cells, names, strict=True)))))
    return F.coalesce(*options) if options else F.lit(None)


def infer_columns(columns: Sequence[str], prefixes: Sequence[str], skip: Sequence[str] = ()) -> dict[str, str]:
    """Label to column, of columns that begin with one of the prefixes."""
    return {c[len(p) :]: c for p in prefixes for c in columns if c.startswith(p) and c not in skip and len(c) > len(p)}


def strict_lookup(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Inner join that fails on a key which the table lacks."""
    out = rows.join(table.withColumn("_found", F.lit(True)), key, "left")
    return out.withColumn("_ok", F.coalesce("_found", F.raise_error(F.concat(F.lit("no match for "), F.concat_ws(", ", *key))).cast("boolean"))).where("_ok").drop("_found", "_ok")


def gathered(wanted: DataFrame, middle: DataFrame, scores: DataFrame) -> DataFrame:
    """sample_id, idx, score through two lookups (idx to place, place to score); what either lacks is 0."""
    out = wanted.join(middle, ["sample_id", "idx"], "left").join(scores, ["sample_id", "place"], "left")
    return out.select("sample_id", "idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def placed_scores(wanted: DataFrame, scores: DataFrame) -> DataFrame:
    """sample_id, idx, score of arrays of scores by place; an array of another length than the sample has residues is an error.

    wanted: sample_id, idx from 0; scores: sample_id, scores (array<double>).
    """
    n = wanted.groupBy("sample_id").agg(F.count("*").alias("_n"))
    rows = n.join(scores, "sample_id")
    fits = F.when(F.size("scores") == F.col("_n"), F.col("scores")).otherwise(F.raise_error(F.concat(F.lit("number of scores of "), F.col("sample_id").cast("string"))).cast("array<double>"))
    long = rows.select("sample_id", F.posexplode(fits).alias("idx", "score"))
    return wanted.select("sample_id", "idx").join(long.withColumn("idx", F.col("idx").cast("bigint")), ["sample_id", "idx"], "left")


def matched_entities(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Each row's first entity (by position) that lists its accession and chain."""
    hit = rows.join(entities.select("entry", "entity", "pos", F.explode("accessions").alias("accession"), "chains"), ["entry", "accession"]).where(F.array_contains("chains", F.col("chain")))
    return hit.groupBy("entry", "accession", "chain").agg(F.min_by("entity", "pos").alias("entity"))


def ligand_choice(atoms: DataFrame, by: list[str], key: list[str], name: str, allowed: Sequence[str], excluded: Sequence[str], given: str | None = None) -> DataFrame:
    """The ligand of each structure: the one given, else an allowed one, else any that isn't excluded; most atoms win."""
    groups = atoms.groupBy(*by, *key, *([given] if given else [])).agg(F.count("*").alias("n"))
    label = F.concat_ws(":", *key)
    rank = F.when(label == F.col(given), 0).when(F.col(name).isin(*allowed), 1).when(~F.col(name).isin(*excluded), 2) if given else F.when(F.col(name).isin(*allowed), 1).when(~F.col(name).isin(*excluded), 2)
    groups = groups.withColumn("_rank", rank).where("_rank is not null")
    w = Window.partitionBy(*by).orderBy("_rank", F.desc("n"), *(F.desc(k) for k in key))
    return groups.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_rank")


def bonds_of(bonds: DataFrame, serials: DataFrame, key: list[str]) -> DataFrame:
    """key, src, dst of the bonds both of whose atoms are kept; bonds have src and an array dsts."""
    long = bonds.select(*key, "src", F.explode("dsts").alias("dst"))
    keep = lambda c: serials.select(*key, F.col("serial").alias(c))
    return long.join(keep("src"), [*key, "src"], "left_semi").join(keep("dst"), [*key, "dst"], "left_semi")


def pose_deviation(atoms: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """Root mean square distance of heavy atoms in order, without a fit; null where their number or an element differs.

    An unknown element is one of its own. `ligands.symmetric_deviation` compares atoms by their bonds instead.
    """
    kind = F.coalesce(F.upper(F.trim("element")), F.lit(""))
    w = lambda keys: Window.partitionBy(*keys).orderBy("serial")
    heavy = lambda df, keys, p: df.where(~kind.isin("H", "D")).select(*keys, F.row_number().over(w(keys)).alias("k"), kind.alias(f"{p}kind"), *(F.col(c).alias(f"{p}{c}") for c in "xyz"), F.count("*").over(Window.partitionBy(*keys)).alias(f"{p}n"))
    target = by[:1]
    both = heavy(atoms, by, "a").join(heavy(reference, target, "b"), [*target, "k"])
    square = sum((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz")
    same = (F.max("an") == F.max("bn")) & (F.count("*") == F.max("an")) & F.bool_and(F.col("akind") == F.col("bkind"))
    return both.groupBy(*by).agg(F.when(same, F.sqrt(F.avg(square))).alias("rmsd"))


def sequence_scores(rows: DataFrame) -> DataFrame:
    """key, idx, score of the whole sequence's scores at the places where the observed part lies in it; null if it isn't a part."""
    at = F.instr("whole", F.col("part")) - 1
    hit = rows.withColumn("_at", at).withColumn("_s", F.when(F.col("_at") >= 0, F.slice("scores", F.col("_at") + 1, F.length("part"))))
    return hit.select("key", F.posexplode_outer("_s").alias("idx", "score"))


def ordered_ids(atoms: DataFrame, by: list[str], chain: str | None = None) -> DataFrame:
    """Distinct residue ids in order of their first line."""
    rows = atoms if chain is None else atoms.where(F.col("chain") == chain)
    first = rows.groupBy(*by, "residue_id").agg(F.min("line_no").alias("_line"))
    return first.withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy("_line")) - 1).drop("_line")


def present(df: DataFrame, column: str) -> DataFrame:
    """Rows whose cell isn't blank."""
    return df.where(blank_to_null(column).isNotNull())
