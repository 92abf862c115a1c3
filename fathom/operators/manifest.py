"""The training manifest: unique pairs, tests in order, annotations made from features, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.clean import blank_to_null, label

from .reports import keep_first, reasons
from .splits import rank_split


def feature_ranges(features: str, marks: Sequence[str]) -> Column:
    """[start, end] of the features (structs of name, start, end) whose name has a mark, sorted."""
    test = lambda f: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(F.lower(f["name"]), m))
    return F.array_sort(F.transform(F.filter(features, lambda f: test(f) & (f["start"] <= f["end"])), lambda f: F.array(f["start"], f["end"])))


#: The regions' names, those that are evaluated, and the weights of their residues.
REGIONS = ("barrel_core", "plug", "extracellular_loop", "tonb_box", "substrate_contact")
EVALUATED = ("plug", "extracellular_loop", "tonb_box", "substrate_contact")
WEIGHTS = {"default": 1.0, "barrel_core": 0.1, "plug": 2.0, "extracellular_loop": 2.0, "tonb_box": 3.0, "substrate_contact": 3.0}


def windows(lo: Column, hi: Column, count: int, size: int) -> Column:
    """[start, end] of even windows of a size between lo and hi, distinct and sorted; one window where they are the whole."""
    size, half = max(3, size), max(3, size) // 2
    length = hi - lo + 1
    if count <= 1:
        centres = F.array(F.floor((lo + hi) / 2))
    else:
        centres = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(lo + half + i * (length - size) / F.lit(float(count - 1))))

    def window(centre: Column) -> Column:
        end = F.least(hi, F.greatest(lo, centre - half) + size - 1)
        return F.array(F.greatest(lo, end - size + 1).cast("int"), end.cast("int"))

    return F.when(length <= size, F.array(F.array(lo.cast("int"), hi.cast("int")))).otherwise(F.array_sort(F.array_distinct(F.transform(centres, window))))


def annotation(rows: DataFrame, key: str, lo: str = "modelled_lo", hi: str = "modelled_hi", count: int = 16, size: int = 10, box: int = 7) -> DataFrame:
    """key, annotation: regions as JSON, made from ranges plug and barrel (arrays of [start, end]) and the modelled span.

    Without barrel ranges the barrel begins behind the plug, at the model's end at most, else behind the first
    quarter of the span; its core is sampled by `count` even windows of `size` residues. The box is the first
    `box` modelled residues, cut before the plug but never below one residue.
    """
    first, last = F.col(lo), F.col(hi)
    none = F.array().cast("array<array<int>>")
    sides = lambda ranges, k: F.transform(ranges, lambda x: x[k])
    start = F.when(F.size("plug") > 0, F.least(last, F.array_max(sides("plug", 1)) + 1)).otherwise(first + F.floor((last - first + 1) * 0.25).cast("int"))
    barrel = F.when(F.size("barrel") > 0, F.col("barrel")).when(start <= last, F.array(F.array(start, last))).otherwise(none)
    core = F.when(F.size(barrel) > 0, windows(F.array_min(sides(barrel, 0)), F.array_max(sides(barrel, 1)), count, size)).otherwise(none)
    end = first + max(1, box) - 1
    end = F.when(F.size("plug") > 0, F.least(end, F.greatest(first, F.array_min(sides("plug", 0)) - 1))).otherwise(end)
    boxed = F.when(end >= first, F.array(F.array(first, end))).otherwise(none)
    entry = lambda ranges: F.array(F.struct(F.col("chain").alias("chain"), ranges.alias("ranges")))
    empty = F.array().cast("array<struct<chain:string,ranges:array<array<int>>>>")
    ranges = {"barrel_core": entry(core), "plug": entry(F.col("plug")), "tonb_box": entry(boxed)}
    body = F.struct(
        F.col("chain").alias("default_chain"), F.struct(*(ranges.get(n, empty).alias(n) for n in REGIONS)).alias("regions"),
        F.array(*map(F.lit, EVALUATED)).alias("eval_regions"), F.struct(*(F.lit(w).alias(n) for n, w in WEIGHTS.items())).alias("loss_weights"),
    )
    return rows.select(key, F.to_json(body).alias("annotation"))


def training_manifest(rows: DataFrame, states: Sequence[str], files: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Kept rows with splits, and rejected ones with the first reason: a repeated pair, its state, a file that is missing.

    rows: pair_id, state_label, path, split (may be blank); files: path.
    """
    first = keep_first(rows, ["pair_id"], order)
    repeated = rows.join(first.select("pair_id", *order), ["pair_id", *order], "left_anti").withColumn("reason", F.lit("duplicate_pair"))
    there = first.join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    tested = reasons(there, [("state_not_wanted", ~label("state_label").isin(*states)), ("file_missing", F.col("_there").isNull())]).drop("_there")
    kept = tested.where("reason is null").drop("reason").withColumn("given", blank_to_null(F.lower("split"))).drop("split")
    return rank_split(kept, "pair_id", given="given").drop("given"), tested.where("reason is not null").unionByName(repeated)


#: The note that a prepared row gets, and the one that it takes the place of.
NOTE = "training_manifest_auto_annotation"
NOTES = ("requires region annotation before supervised training.", "auto region annotation generated for supervised smoke training.")


def annotation_path(folder: str, target: Column, family: Column, accession: Column) -> Column:
    """folder/<slug>.json of a target, or of its family and accession where it has no name."""
    name = F.coalesce(blank_to_null(target), F.concat(F.coalesce(blank_to_null(family), F.lit("tbdt")), F.lit("_"), F.lower(F.coalesce(accession, F.lit("")))))
    return F.concat(F.lit(f"{folder}/"), F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""), F.lit(".json"))


def looked_up(rows: DataFrame, path: Column, table: DataFrame, unique: str) -> DataFrame:
    """rows with the other columns of a table by path; those without a path (null or blank) are dealt out by their own number, not to one task."""
    none = F.concat(F.lit("\0"), F.col(unique).cast("string"))  # no path has a NUL
    key = F.when(blank_to_null(path).isNotNull(), path).otherwise(none)
    return rows.withColumn("_path", key).join(table.withColumnRenamed("path", "_path"), "_path", "left").drop("_path")


def found_paths(rows: DataFrame, unique: str, paths: Mapping[str, Column], table: DataFrame, value: str) -> DataFrame:
    """unique, name and the table's value of each of a row's named paths that the table has; a path that is null or blank is nowhere.

    table: path (unique) and value. Only numbers, names and paths of rows are dealt out, not the rows.
    """
    at = lambda n, c: F.when(blank_to_null(c).isNotNull(), F.struct(F.lit(n).alias("name"), c.alias("path")))
    asked = rows.select(unique, F.explode(F.array_compact(F.array(*(at(n, c) for n, c in paths.items())))).alias("_at")).select(unique, "_at.*")
    return asked.join(table.select("path", value), "path").select(unique, "name", value)


def prepared_manifest(rows: DataFrame, files: DataFrame, annotations: DataFrame, found: DataFrame, folder: str, needed: Sequence[str] = ("af2_pdb", "experimental_pdb"), exclude_uncertain: bool = True) -> tuple[DataFrame, DataFrame]:
    """Training rows with chains, the place and source of their annotation, notes and splits; and rejected ones with their reason.

    rows: position (unique), pair_id, target_id, family, uniprot_id, pdb_chain, state_label, region_annotation_json,
    notes, split and the needed files; files: path; annotations: path, has_core of those that are there; found:
    pair_id of rows whose entity is known, from which an annotation can be made. annotation_source: existing (the
    row's own, or the target's beside the folder), cached, generated, or regenerated_missing_core. The first row of
    a path that can make it does; rows behind it find it, rows before it that can't are rejected.
    """
    # what is known of a row comes from narrow tables by its position, so that the row itself is dealt out once
    own = blank_to_null(F.col("region_annotation_json"))
    beside = F.concat(F.lit(folder.rpartition("/")[0] + "/"), blank_to_null("target_id"), F.lit(".json"))
    made = annotation_path(folder, F.col("target_id"), F.col("family"), F.col("uniprot_id"))
    there = files.where("path is not null").groupBy("path").agg(F.lit(True).alias("value"))
    known = annotations.groupBy("path").agg(F.bool_or("has_core").alias("value")).where("value is not null")
    pairs = rows.where("pair_id is not null").groupBy("pair_id").agg(F.min("position").alias("position"))
    pairs = pairs.join(found.select("pair_id").distinct().withColumn("value", F.lit(True)), "pair_id", "left")
    facts = pairs.select("position", F.lit("first").alias("name"), F.coalesce("value", F.lit(False)).alias("value"))
    facts = facts.unionByName(found_paths(rows, "position", {f"file{k}": F.col(c) for k, c in enumerate(needed)}, there, "value"))
    facts = facts.unionByName(found_paths(rows, "position", {"own": own, "beside": beside, "made": made}, known, "value"))
    names = ("first", *(f"file{k}" for k in range(len(needed))), "own", "beside", "made")
    facts = facts.groupBy("position").agg(*(F.bool_or(F.when(F.col("name") == n, F.col("value"))).alias(f"_{n}") for n in names))
    tested = rows.join(facts, "position", "left")
    missing = F.array_compact(F.array(*(F.when(blank_to_null(c).isNotNull() & F.col(f"_file{k}").isNull(), c) for k, c in enumerate(needed))))
    tested = reasons(tested, [("duplicate_pair_id", F.col("pair_id").isNotNull() & F.col("_first").isNull()), *([("uncertain_state", F.trim("state_label") == "uncertain")] if exclude_uncertain else [])])
    tested = tested.withColumn("reason", F.coalesce("reason", F.when(F.size(missing) > 0, F.concat(F.lit("missing_local_files:"), F.array_join(missing, ",")))))
    existing = F.coalesce(F.when(F.col("_own").isNotNull(), own), F.when(F.col("_beside").isNotNull(), beside))
    tested = tested.withColumns({"_existing": existing, "_path": made})
    asks = F.col("reason").isNull() & F.col("_existing").isNull() & ~F.coalesce("_made", F.lit(False))
    asking = tested.where(asks).select("position", "_path", "_first")
    maker = asking.where("_first").groupBy("_path").agg(F.min("position").alias("_maker"))
    tested = tested.join(asking.join(maker, "_path").select("position", "_maker"), "position", "left")
    source = F.when(F.col("_existing").isNotNull(), "existing").when(~asks, "cached").when(F.col("position") > F.col("_maker"), "cached").when(F.col("position") == F.col("_maker"), F.when(F.col("_made").isNull(), "generated").otherwise("regenerated_missing_core"))
    tested = tested.withColumn("annotation_source", F.when(F.col("reason").isNull(), source))
    tested = tested.withColumn("reason", F.when(F.col("reason").isNull() & F.col("annotation_source").isNull(), "no_matching_entity").otherwise(F.col("reason")))
    notes = F.replace(F.coalesce("notes", F.lit("")), F.lit(NOTES[0]), F.lit(NOTES[1]))
    kept = tested.where("reason is null").withColumns({
        "chain": F.col("pdb_chain"), "af2_chain": F.lit("A"), "holo_chain": F.col("pdb_chain"), "region_annotation_json": F.coalesce("_existing", "_path"),
        "notes": F.when(notes != "", F.concat(notes, F.lit(f"; {NOTE}"))).otherwise(NOTE), "given": blank_to_null(F.lower("split")),
    }).select(*rows.columns, "chain", "af2_chain", "holo_chain", "annotation_source", "given").drop("split")
    return rank_split(kept, "pair_id", given="given").drop("given"), tested.where("reason is not null").select("position", "pair_id", "reason")


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a log whose columns may grow: readers merge the files' columns."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def bundle(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write each table of a report below a folder; name and number of rows of each."""
    out = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        one = df.sparkSession.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
