"""Region annotations as a long bridge table, derived regions, precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANNOTATION = "default_chain string, regions map<string, string>, eval_regions array<string>, loss_weights map<string, double>"


def parsed(annotations: DataFrame, column: str = "annotation") -> DataFrame:
    """annotations with the parsed object `a`; each region stays JSON text, as its entries have many forms."""
    return annotations.withColumn("a", F.from_json(column, ANNOTATION))


def _cells(text: Column) -> Column:
    """The items of a JSON array, or the one cell that isn't one; none for null. Items that are objects or arrays stay JSON."""
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))


def leading_number(text: Column) -> Column:
    """The integer that a cell begins with, null if it doesn't."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^(-?\d+)", 1), F.lit("")).cast("int")


def _ranges(text: Column) -> Column:
    """Pairs of cells: [a, b], [[a, b], ...], "a-b" or a list of such; what has no two ends is left out."""
    items = _cells(text)
    plain = (F.size(items) == 2) & ~F.exists(items, lambda x: F.ltrim(x).startswith("[") | x.contains("-"))
    pair = lambda x: F.when(F.ltrim(x).startswith("["), F.from_json(x, "array<string>")).when(x.contains("-"), F.split(x, "-", 2))
    pairs = F.when(plain & F.ltrim(text).startswith("["), F.array(items)).otherwise(F.transform(items, pair))
    return F.filter(pairs, lambda p: p.isNotNull() & (F.size(p) == 2))


def members(annotations: DataFrame, key: str) -> DataFrame:
    """key, region, residue_id. A region is an entry, a list of entries, or of residues, or one residue; an entry has a
    chain (else the default one), ranges (inclusive, may fall), residues (numbers or ids) and residue_ids."""
    rows = annotations.select(key, F.col("a.default_chain").alias("default_chain"), F.explode("a.regions").alias("region", "text")).where("text is not null")
    rows = rows.select(key, "region", "default_chain", F.explode(_cells(F.col("text"))).alias("e"))
    whole = F.ltrim(F.col("e")).startswith("{")
    entry = F.from_json(F.when(whole, F.col("e")), "chain string, ranges string, residues string, residue_ids string")
    rows = rows.withColumn("x", entry).select(key, "region", F.coalesce("x.chain", "default_chain").alias("chain"), F.col("x.ranges").alias("ranges"), F.when(whole, F.col("x.residues")).otherwise(F.to_json(F.array("e"))).alias("residues"), F.col("x.residue_ids").alias("ids"))
    ends = F.transform(_ranges(F.col("ranges")), lambda p: F.struct(leading_number(p[0]).alias("a"), leading_number(p[1]).alias("b")))
    spans = F.flatten(F.transform(F.filter(ends, lambda r: r["a"].isNotNull() & r["b"].isNotNull()), lambda r: F.sequence(r["a"], r["b"])))
    cells = F.transform(_cells(F.col("residues")), lambda c: F.trim(c))
    numbers = F.concat(spans, F.filter(F.transform(F.filter(cells, lambda c: ~c.contains("_")), leading_number), lambda n: n.isNotNull()))
    named = F.when(F.col("chain").isNotNull() & (F.trim("chain") != ""), F.transform(numbers, lambda n: F.concat(F.trim("chain"), F.lit("_"), n.cast("string")))).otherwise(F.array().cast("array<string>"))
    given = F.filter(F.transform(F.concat(_cells(F.col("ids")), F.filter(cells, lambda c: c.contains("_"))), lambda c: F.trim(c)), lambda c: c != "")
    return rows.select(key, "region", F.explode(F.concat(named, given)).alias("residue_id")).distinct()


def overridden(bridge: DataFrame, residues: DataFrame, overrides: DataFrame) -> DataFrame:
    """sample_id, idx, region: membership from samples with overrides applied; the last that names a region replaces it.

    bridge: sample_id, idx, region; residues: sample_id, idx, residue_id; overrides: scope (a sample's id as text, or *
    for all), region, and mask (array<boolean>), indices (array<int>) or residue_ids (array<string>), the first that
    isn't null. A sample's own override wins over one for all. An id that the sample lacks, or a mask of another length, is an error.
    """
    info = residues.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("idx", "residue_id"))).alias("r"))
    scoped = lambda rank, test: info.join(overrides.withColumn("_rank", F.lit(rank)), test)
    hit = scoped(1, F.col("scope") == "*").unionByName(scoped(2, F.col("scope") == F.col("sample_id").cast("string")))
    top = hit.groupBy("sample_id", "region").agg(F.max_by(F.struct("r", "mask", "indices", "residue_ids"), "_rank").alias("o")).select("sample_id", "region", "o.*")
    wrong = lambda why: F.raise_error(F.concat(F.lit(f"{why} of region "), "region")).cast("array<bigint>")
    places = F.transform("r", lambda x: x["idx"])
    by_mask = F.when(F.size("mask") != F.size("r"), wrong("length")).otherwise(F.transform(F.filter(F.arrays_zip(places.alias("p"), F.col("mask").alias("m")), lambda z: z["m"]), lambda z: z["p"]))
    lost = F.size(F.array_except("residue_ids", F.transform("r", lambda x: x["residue_id"]))) > 0
    by_id = F.when(lost, wrong("unknown id")).otherwise(F.transform(F.filter("r", lambda x: F.array_contains("residue_ids", x["residue_id"])), lambda x: x["idx"]))
    idx = F.when(F.col("mask").isNotNull(), by_mask).when(F.col("indices").isNotNull(), F.col("indices").cast("array<bigint>")).otherwise(by_id)
    named = top.select("sample_id", "region").distinct()
    kept = bridge.select("sample_id", "idx", "region").join(named, ["sample_id", "region"], "left_anti").select("sample_id", "idx", "region")
    return kept.unionByName(top.select("sample_id", F.explode(idx).alias("idx"), "region"))


def region_features(residues: DataFrame, bridge: DataFrame, annotations: DataFrame, key: str, id_order: Sequence[str], weight_order: Sequence[str]) -> DataFrame:
    """Each residue's main region, weight, and whether it is evaluated (all are if no region hits)."""
    place = lambda order: F.array_position(F.array(*map(F.lit, order)), F.col("region"))
    info = annotations.select(key, F.col("a.eval_regions").alias("eval_regions"), F.col("a.loss_weights").alias("w"))
    rows = residues.join(bridge, [key, "residue_id"], "left").join(info, key)
    rows = rows.groupBy(key, "residue_id").agg(
        F.max_by("region", F.when(F.col("region").isNotNull(), place(id_order))).alias("region"),
        F.max_by(F.col("w")[F.col("region")], F.when(F.col("region").isNotNull(), place(weight_order))).alias("weight"),
        F.first(F.col("w")["default"]).alias("default_weight"),
        F.max(F.coalesce(F.array_contains("eval_regions", F.col("region")), F.lit(False))).alias("hit"),
    )
    some = F.max("hit").over(Window.partitionBy(key))
    return rows.select(key, "residue_id", "region", F.coalesce("weight", "default_weight").alias("weight"), (F.col("hit") | ~some).alias("is_eval"))


def derived_plug_regions(bridge: DataFrame, plug: str = "plug", box: str = "tonb_box", first: int = 3, last_share: float = 0.5) -> DataFrame:
    """sample_id, idx, region: the first residues of the plug, the last share of the others outside the box, the core."""
    flags = bridge.groupBy("sample_id", "idx").agg(F.max((F.col("region") == plug).cast("int")).alias("plug"), F.max((F.col("region") == box).cast("int")).alias("box")).where("plug = 1")
    own = Window.partitionBy("sample_id")
    flags = flags.withColumn("up", F.row_number().over(own.orderBy("idx")))
    n_terminal = F.col("up") <= first
    rest = flags.withColumn("head", n_terminal).withColumn("free", ~n_terminal & (F.col("box") == 0))
    rest = rest.withColumn("down", F.sum(F.col("free").cast("int")).over(own.orderBy(F.desc("idx")))).withColumn("m", F.sum(F.col("free").cast("int")).over(own))
    region = F.when(F.col("head"), "plug_n_terminal").when(F.col("free") & (F.col("down") <= F.ceil(F.col("m") * last_share)), "plug_apical").otherwise("plug_core")
    return rest.select("sample_id", "idx", region.alias("region"))


def by_priority(bridge: DataFrame, order: Sequence[str]) -> DataFrame:
    """One region for each residue: the first of the order that it is in."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("region"))
    w = Window.partitionBy("sample_id", "idx").orderBy("place", "region")
    return bridge.withColumn("place", place).where("place > 0").withColumn("k", F.row_number().over(w)).where("k = 1").drop("place", "k")


def ordered_case(c: Column, order: Sequence[str], other: int = 99) -> Column:
    out = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(out > 0, out).otherwise(other)
