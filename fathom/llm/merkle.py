"""A Merkle manifest of a table: leaves by group, roots by group, one root, and a proof for every row.

A parent's preimage is the text of its children's hashes, 64 characters each. Levels are built upwards, each
stored and an eighth of the one below. Paths come down the other way: a node's path is its parent's preimage
and then the parent's path, so preimages are joined once for each node of the level above, and leaves join
the finished paths of their parents once. From a path a leaf excises its own slot for the siblings of its
proof, and splices a replacement into the slot to fold the path up to a root.

Positions in a group come from ranges (`places`), so a group that holds most rows is spread over all tasks;
every other key is a parent's, with `FANOUT` children.

Cases: nulls in fields are hashed as `-`; a null group is one of its own and comes first; null ids come first
in their group; rows equal in id are ordered by their leaves, and equal rows take their places in any order;
a group of one row has its leaf as its subroot, and a table of one group its subroot as root; an empty table
gives an empty table; columns that aren't among the fields are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, stored, table
from .places import positions
from .resampling import crc32_sql

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOT = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<preimage:string,slot:int>>"


def leaf(values: Sequence[Column]) -> Column:
    """sha256 of the values, each with its length in bytes; a null is `-`."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The tree's levels above nodes (g, n, pos, hash): each g, n, pos, preimage, hash, where n counts the group's nodes of the level."""
    out: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = nodes.where("n > 1").groupBy("g", ((F.col("n") + FANOUT - 1) / FANOUT).cast("bigint").alias("n"), F.floor(F.col("pos") / FANOUT).alias("pos"))
        children = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda c: c["hash"])
        nodes = stored(up.agg(F.array_join(children, "").alias("preimage")).withColumn("hash", F.sha2("preimage", 256)))
        out.append(nodes)
        most = -(-most // FANOUT)
    return out


def roots(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """g and hash of every group's root."""
    out = nodes.where("n = 1").select("g", "hash")
    for level in above:
        out = out.unionByName(level.where("n = 1").select("g", "hash"))
    return out


def paths(above: list[DataFrame], tops: DataFrame) -> DataFrame:
    """g, up, preimage, path and subroot of the parents of leaves, by the leaf's position divided by FANOUT.

    tops: g, path and subroot of every group's root. A group of one leaf has a row without a preimage.
    """
    out = None
    for level in reversed(above):
        started = level.where("n = 1").join(tops, "g").select("g", F.col("pos").alias("up"), "preimage", "path", "subroot")
        if out is not None:
            below = level.where("n > 1").select("g", "pos", F.floor(F.col("pos") / FANOUT).alias("up"), F.col("preimage").alias("own"))
            below = below.join(out, ["g", "up"]).select("g", F.col("pos").alias("up"), F.col("own").alias("preimage"), F.array_prepend("path", _step(F.col("preimage"), F.col("pos"))).alias("path"), "subroot")
            started = below.unionByName(started)
        out = started
    lone = tops.where("lone").select("g", F.lit(0).cast("bigint").alias("up"), F.lit(None).cast("string").alias("preimage"), "path", "subroot")
    return lone if out is None else out.unionByName(lone)


def _step(preimage: Column, pos: Column) -> Column:
    return F.struct(preimage.alias("preimage"), (pos % FANOUT).cast("int").alias("slot"))


def siblings(path: Column) -> Column:
    """The preimages of a path without the slots that lead to the leaf."""
    rest = lambda s: F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * SLOT), F.substr(s["preimage"], s["slot"] * SLOT + SLOT + 1))
    return F.array_join(F.transform(path, rest), "")


def folded(path: Column, start: Column) -> Column:
    """The root that a path gives with `start` in the leaf's slot."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.overlay(s["preimage"], h, s["slot"] * SLOT + 1, SLOT), 256))


def manifest(docs: DataFrame, replaced: Column | None = None, *, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Of every row: the order column, leaf, subroot, root, path, n_siblings, proof_sha256, folded_root and verified.

    replaced: another value for the field `text`, null where the row is to be proved as it is. path holds the
    preimages from the leaf's parent to the root, with the slot of the leaf's side in each.
    """
    other = F.lit(None).cast("string") if replaced is None else F.when(replaced.isNotNull(), leaf([replaced if f == "text" else F.col(f) for f in fields]))
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = stored(docs.select(F.col(order).alias("id"), key.alias("g"), leaf([F.col(f) for f in fields]).alias("hash"), other.alias("other")))
    placed = positions(leaves, ["g"], [F.asc_nulls_first("id"), F.asc("hash"), F.asc("other")], "pos", "n")
    above = levels(placed)
    subroots = stored(roots(placed, above))
    ranked = positions(subroots, [], [F.asc("g")], "pos", "n").select(F.lit("").alias("g"), F.col("g").alias("of"), "n", "pos", "hash")
    top = levels(ranked)
    root = (roots(ranked, top).first() or [None, None])[1]
    start = ranked.sparkSession.createDataFrame([("", [], root, not top)], f"g string, path {_PATH}, subroot string, lone boolean")
    whole = paths(top, start).select("up", "preimage", "path")
    path = F.when(F.col("preimage").isNull(), F.col("path")).otherwise(F.array_prepend("path", _step(F.col("preimage"), F.col("pos"))))
    tops = ranked.withColumn("up", F.floor(F.col("pos") / FANOUT)).join(whole, "up").select(F.col("of").alias("g"), path.alias("path"), F.col("hash").alias("subroot"))
    lone = placed.where("n = 1").select("g", F.lit(True).alias("lone"))
    tops = stored(tops.join(lone, "g", "left").withColumn("lone", F.coalesce("lone", F.lit(False))))
    rows = placed.withColumn("up", F.floor(F.col("pos") / FANOUT)).join(paths(above, tops), ["g", "up"])
    rows = rows.select("id", "hash", F.coalesce("other", "hash").alias("shown"), "subroot", F.lit(root).alias("root"), path.alias("path"))
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.col("shown")))
    return rows.select(
        F.col("id").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "path", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_mod("doc_id", 3) == 0, F.translate("text", _UPPER, _LOWER))
    return manifest(docs, tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in (text if f == "text" else f for f in FIELDS)]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, depth: int) -> str:
    """Tables {name}0 ... {name}depth of levels from {name}0 (g, n, pos, hash), and {name}up: level, g, pos, siblings around each node and its parent's preimage."""
    out = []
    for k in range(1, depth + 1):
        out.append(f"{name}{k} AS MATERIALIZED (SELECT g, (n + {FANOUT - 1}) // {FANOUT} AS n, pos // {FANOUT} AS pos, string_agg(hash, '' ORDER BY pos) AS preimage, sha256(string_agg(hash, '' ORDER BY pos)) AS hash FROM {name}{k - 1} WHERE n > 1 GROUP BY g, n, pos // {FANOUT})")
    return ",\n".join(out)


#: Levels of the SQL below: enough for FANOUT ** 8 rows of a group.
_DEPTH, _TOP = 8, 3


def _climb_sql() -> str:
    """Proof and folded hash of each leaf, level by level."""
    out = ["c0 AS (SELECT row, doc_id, g, n, pos, leaf, '' AS proof, shown AS fold FROM l)"]
    for name, depth in (("a", _DEPTH), ("t", _TOP)):
        for k in range(1, depth + 1):
            c, slot = len(out) - 1, f"(c.pos % {FANOUT})"
            step = f"SELECT c.row, c.doc_id, c.g, CASE WHEN p.g IS NULL THEN c.n ELSE p.n END AS n, CASE WHEN p.g IS NULL THEN c.pos ELSE p.pos END AS pos, c.leaf, CASE WHEN p.g IS NULL THEN c.proof ELSE c.proof || substr(p.preimage, 1, {slot} * {SLOT}) || substr(p.preimage, {slot} * {SLOT} + {SLOT + 1}) END AS proof, CASE WHEN p.g IS NULL THEN c.fold ELSE sha256(substr(p.preimage, 1, {slot} * {SLOT}) || c.fold || substr(p.preimage, {slot} * {SLOT} + {SLOT + 1})) END AS fold"
            out.append(f"c{c + 1} AS MATERIALIZED ({step} FROM c{c} c LEFT JOIN {name}{k} p ON p.g = {'c.g' if name == 'a' else repr('')} AND p.pos = c.pos // {FANOUT} AND c.n > 1)")
        if name == "a":
            c = len(out) - 1
            out.append(f"c{c + 1} AS (SELECT c.row, c.doc_id, c.g, t.n, t.pos, c.leaf, c.proof, c.fold FROM c{c} c JOIN t0 t ON t.of = c.g)")
    return ",\n".join(out)


OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("text")} AS leaf,
  CASE WHEN {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf_sql("text")} END AS shown FROM documents),
l AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS pos FROM d),
a0 AS (SELECT g, n, pos, leaf AS hash FROM l),
{_tree_sql("a", _DEPTH)},
r AS MATERIALIZED ({" UNION ALL ".join(f"SELECT g, hash FROM a{k} WHERE n = 1" for k in range(_DEPTH + 1))}),
t0 AS MATERIALIZED (SELECT '' AS g, g AS of, count(*) OVER () AS n, row_number() OVER (ORDER BY g) - 1 AS pos, hash FROM r),
{_tree_sql("t", _TOP)},
top AS MATERIALIZED ({" UNION ALL ".join(f"SELECT hash FROM t{k} WHERE n = 1" for k in range(_TOP + 1))}),
{_climb_sql()}
SELECT c.doc_id, leaf, r.hash AS subroot, top.hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = top.hash AS verified FROM c{_DEPTH + _TOP + 1} c JOIN r ON r.g = c.g CROSS JOIN top
"""
