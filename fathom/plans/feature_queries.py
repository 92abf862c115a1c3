"""Queries for features, alternative records, and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.operators import features, reports
from fathom.registry import query

from .spatial_queries import _PTS, points
from .virtual import SQL_BRIDGE, SQL_POSES, SQL_REGION, SQL_RES, SQL_RUNS, TIES, bridge, poses, predicted, primary, r, read, residues, runs, tidy


@query("relative_exposure", f"SELECT p_partkey, {r('greatest(0, least(1.5, p_retailprice / CASE p_size % 3 WHEN 0 THEN 900 WHEN 1 THEN 1100 ELSE 1000 END))', 'rsa')} FROM part")
def relative_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("name", F.element_at(F.array(F.lit("ALA"), F.lit("GLY"), F.lit("X")), (F.col("p_size") % 3 + 1).cast("int")))
    return tidy(p.select("p_partkey", features.relative_exposure("p_retailprice", "name", {"ALA": 900.0, "GLY": 1100.0}, 1000.0).alias("rsa")))


@query("rescaled_confidence", f"WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 2 = 0 THEN l_quantity ELSE l_quantity / 100 END AS c FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {r('1 - least(1, greatest(0, CASE WHEN max(c) OVER (PARTITION BY l_orderkey) > 1.5 THEN c / 100 ELSE c END))', 'low')} FROM m")
def rescaled_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumn("c", F.when(F.col("l_orderkey") % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") / 100))
    s = features.rescaled(li, "c", ["l_orderkey"])
    return tidy(li.select("l_orderkey", "l_linenumber", "l_partkey", (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))).alias("low"))).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("sequence_features", f"""WITH t AS (SELECT item_id, text, length(text) AS n, unnest(range(length(text))) AS i FROM benchmark), k AS (SELECT item_id, i, n, upper(substr(text, i + 1, 1)) AS c FROM t) SELECT item_id, i, CASE WHEN strpos('ACDEFGHIKLMNPQRSTVWYX', c) = 0 THEN 21 ELSE strpos('ACDEFGHIKLMNPQRSTVWYX', c) END::BIGINT AS letter,
 CASE WHEN i % 107 < 105 THEN i % 107 ELSE -1 END::BIGINT AS place, {r('sin(2 * pi() * i / greatest(1, n - 1))', 'phase_sin')}, {r('cos(2 * pi() * i / greatest(1, n - 1))', 'phase_cos')} FROM k""")
def sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every letter of every item's whole text; a place in the last two numbers is lost to the phase (-1)."""
    b = read(spark, sf_dir, "benchmark").withColumn("n", F.length("text")).where("n > 0")
    b = b.select("item_id", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substr("text", i, F.lit(1)))).alias("i", "c"))
    b = b.withColumn("f", features.sequence_features("c", "i", "n", "ACDEFGHIKLMNPQRSTVWYX"))
    return tidy(b.select("item_id", F.col("i").cast("bigint").alias("i"), F.array_position(F.slice("f", 1, 21), 1.0).alias("letter"), (F.array_position(F.slice("f", 22, 105), 1.0) - 1).alias("place"), F.get("f", F.lit(126)).alias("phase_sin"), F.get("f", F.lit(127)).alias("phase_cos")))


@query("chain_dihedrals", f"""WITH {_PTS}, s AS (SELECT sample_id, idx, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, z - lag(z) OVER w AS uz, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy, lead(z) OVER w - z AS vz,
 lead(x, 2) OVER w - lead(x) OVER w AS wx, lead(y, 2) OVER w - lead(y) OVER w AS wy, lead(z, 2) OVER w - lead(z) OVER w AS wz FROM pt WINDOW w AS (PARTITION BY sample_id ORDER BY idx)),
 c AS (SELECT *, uy*vz-uz*vy AS nx, uz*vx-ux*vz AS ny, ux*vy-uy*vx AS nz, vy*wz-vz*wy AS mx, vz*wx-vx*wz AS my, vx*wy-vy*wx AS mz FROM s)
 SELECT sample_id, idx, {r('coalesce(atan2(((ny*mz-nz*my)*vx + (nz*mx-nx*mz)*vy + (nx*my-ny*mx)*vz) / sqrt(vx*vx+vy*vy+vz*vz), nx*mx+ny*my+nz*mz), 0)', 'angle', 5)} FROM c""")
def chain_dihedrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(features.chain_dihedrals(points(spark, sf_dir)), 5)


@query("residue_position", f"WITH {SQL_RES} SELECT sample_id, idx, round(idx / 20.0::DOUBLE, 6) + 0.0 AS position FROM residue")
def residue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("idx")
    return tidy(residues(spark, sf_dir).select("sample_id", "idx", F.percent_rank().over(w).alias("position")))


@query("principal_components")
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the vectors along their three main directions."""
    e = read(spark, sf_dir, "embeddings")
    mean, v = features.principal_components(e, "embedding", 64, 3)
    p = features.projected("embedding", mean, v)
    return tidy(e.select("vec_id", *(F.get(p, F.lit(k)).alias(f"pc{k}") for k in range(3))), 4)


@query("largest_groups", f"""WITH g AS (SELECT l_orderkey, l_suppkey, count(*) AS n, avg(l_quantity) AS mx, max(l_quantity) - min(l_quantity) AS sx FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_suppkey DESC) AS k FROM g)
 SELECT l_orderkey, l_suppkey, n, {r('mx', 'center_x')}, {r('greatest(sx + 8, 10)', 'size_x')} FROM k WHERE k = 1""")
def largest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier with most lines of each order and the padded box of its lines."""
    a = read(spark, sf_dir, "lineitem").withColumns({"x": F.col("l_quantity"), "y": F.col("l_discount"), "z": F.col("l_tax")})
    return tidy(features.largest_group(a, ["l_orderkey"], ["l_suppkey"]).select("l_orderkey", "l_suppkey", "n", "center_x", "size_x"))


@query("best_alternatives", "WITH a AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'B' WHEN 'O' THEN 'A' ELSE '' END AS altloc, o_totalprice AS occupancy FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE altloc WHEN '' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, occupancy DESC, altloc) AS k FROM a) SELECT o_custkey, altloc, occupancy FROM k WHERE k = 1")
def best_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    a = read(spark, sf_dir, "orders").select("o_custkey", F.when(s == "F", "B").when(s == "O", "A").otherwise("").alias("altloc"), F.col("o_totalprice").alias("occupancy"))
    return features.best_alternative(a, ["o_custkey"])


@query("first_accepted", f"WITH {SQL_POSES}, t AS (SELECT target, structure, min(CASE WHEN valid AND rmsd < 3 THEN position END) AS accepted, count(*) AS n_hits FROM rk GROUP BY ALL) SELECT target, structure, accepted, n_hits, coalesce(accepted - 1, n_hits) AS n_rejected FROM t")
def first_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.operators.ranking import ranked

    h = ranked(poses(spark, sf_dir), ["target", "structure"], TIES).withColumnRenamed("position", "rank")
    return features.first_accepted(h, ["target", "structure"], F.col("valid") & (F.col("rmsd") < 3))


@query("gated_masks", f"WITH {SQL_RES}, m AS (SELECT sample_id, idx, {SQL_REGION} AS region, family % 2 = 0 AND idx > 10 AS e FROM residue), g AS (SELECT *, bool_or(e) OVER (PARTITION BY sample_id) AS has FROM m) SELECT region, count(*) FILTER (region = 'plug' AND (e OR NOT has)) AS n FROM g GROUP BY region")
def gated_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = residues(spark, sf_dir).withColumns({"region": primary(F.col("idx")), "is_eval": (F.col("family") % 2 == 0) & (F.col("idx") > 10)})
    rows = rows.withColumn("use", features.gated_mask(rows, F.col("region") == "plug", ["sample_id"]))
    return rows.groupBy("region").agg(F.count_if("use").alias("n"))


_TN = "sqrt(tx*tx+ty*ty+tz*tz)"


@query("region_graph_pivot", f"WITH {SQL_BRIDGE} SELECT sample_id, " + ", ".join(r(f"avg({_TN}) FILTER (region = '{g}')", g) for g in ("barrel_core", "plug", "tonb_box")) + " FROM br GROUP BY sample_id")
def region_graph_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean target length of each region side by side."""
    rows = bridge(predicted(spark, sf_dir)).withColumn("t", F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") + F.col("tz") * F.col("tz")))
    return tidy(rows.groupBy("sample_id").pivot("region", ["barrel_core", "plug", "tonb_box"]).agg(F.avg("t")))


@query("seed_mean_and_sd", f"WITH {SQL_RUNS} SELECT target, " + ", ".join(f"{r(f'avg(value) FILTER (method = {m!r})', m + '_mean', 9)}, {r(f'stddev_samp(value) FILTER (method = {m!r})', m + '_sd', 7)}" for m in ("click", "view")) + " FROM runs GROUP BY target")
def seed_mean_and_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation over seeds, wide; no deviation for one seed."""
    wide = runs(spark, sf_dir).groupBy("target").pivot("method", ["click", "view"]).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return wide.select("target", *((F.round(c, 9 if c.endswith("mean") else 7) + F.lit(0.0)).alias(c) for c in wide.columns[1:]))


@query("max_merged_scores", "SELECT l_partkey, l_suppkey, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL")
def max_merged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("score"))


@query("caption_shares", f"WITH {SQL_RES}, t AS (SELECT family, {_TN} AS t FROM residue) SELECT family, {r('avg((t < 0.1)::INT)', 'below')}, {r('avg((t >= 0.1 AND t < 0.2)::INT)', 'middle')}, {r('avg((t >= 0.2)::INT)', 'above')} FROM t GROUP BY family")
def caption_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") + F.col("tz") * F.col("tz"))
    rows = residues(spark, sf_dir).select("family", t.alias("t"))
    share = lambda test: F.avg(test.cast("double"))
    return tidy(rows.groupBy("family").agg(share(F.col("t") < 0.1).alias("below"), share((F.col("t") >= 0.1) & (F.col("t") < 0.2)).alias("middle"), share(F.col("t") >= 0.2).alias("above"))).withColumn("family", F.col("family").cast("int"))


@query("top_categories", "WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM n) SELECT c_nationkey, c_mktsegment, n FROM k WHERE k = 1")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return reports.best_of(n, ["c_nationkey"], "n", ["c_mktsegment"])


@query("report_full_outer", "WITH a AS (SELECT n_regionkey AS k, count(*) AS n_nations FROM nation WHERE n_nationkey < 15 GROUP BY 1), b AS (SELECT c_nationkey % 7 AS k, count(*) AS n_customers FROM customer GROUP BY 1) SELECT coalesce(a.k, b.k)::BIGINT AS k, n_nations, n_customers FROM a FULL JOIN b ON a.k = b.k")
def report_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "nation").where("n_nationkey < 15").groupBy(F.col("n_regionkey").cast("bigint").alias("k")).agg(F.count("*").alias("n_nations"))
    b = read(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 7).cast("bigint").alias("k")).agg(F.count("*").alias("n_customers"))
    return a.join(b, "k", "full")


@query("asset_status", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ';') AS status, count(*) AS n FROM orders GROUP BY 1")
def asset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("s"), F.count("*").alias("n"))
    return o.select("o_custkey", F.array_join("s", ";").alias("status"), "n")


@query("core_windows", "WITH p AS (SELECT p_partkey, p_size AS lo, p_size + 3 * (p_partkey % 11) AS hi FROM part), w AS (SELECT p_partkey, lo, unnest([0, 1, 2, 3]) AS i, greatest(hi - lo + 1 - 5, 0) AS room FROM p) SELECT DISTINCT p_partkey, (lo + round_even(room * i / 3.0, 0))::BIGINT AS start FROM w")
def core_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("lo"), (F.col("p_size") + 3 * (F.col("p_partkey") % 11)).cast("int").alias("hi"))
    rows = p.select("p_partkey", F.explode(reports.running_windows(4, "lo", "hi", 5)).alias("start"))
    return rows.withColumn("start", F.col("start").cast("bigint"))


@query("seed_mean_curves", f"WITH {SQL_RUNS}, c AS (SELECT method, target % 10 AS x, greatest(0, least(1, avg(value) / 100)) AS y, seed FROM runs GROUP BY method, target % 10, seed) SELECT method, x::BIGINT AS x, {r('greatest(0, least(1, avg(y)))', 'mean', 8)}, {r('stddev_samp(y)', 'sd', 7)} FROM c GROUP BY ALL")
def seed_mean_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    c = runs(spark, sf_dir).groupBy("method", (F.col("target") % 10).alias("x"), "seed").agg(one(F.avg("value") / 100).alias("y"))
    g = c.groupBy("method", "x").agg(one(F.avg("y")).alias("mean"), F.stddev_samp("y").alias("sd"))
    return g.select("method", F.col("x").cast("bigint").alias("x"), (F.round("mean", 8) + F.lit(0.0)).alias("mean"), (F.round("sd", 7) + F.lit(0.0)).alias("sd"))


@query("scaffold_anchor", f"WITH {SQL_BRIDGE} SELECT sample_id, {r('avg(px*px+py*py+pz*pz)', 'anchor')} FROM br WHERE region = 'barrel_core' AND idx % 2 = 0 GROUP BY sample_id")
def scaffold_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared predicted length over the confident core."""
    rows = bridge(predicted(spark, sf_dir)).where("region = 'barrel_core' and idx % 2 = 0")
    return tidy(rows.groupBy("sample_id").agg(F.avg(F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")).alias("anchor")))


@query("metadata_splits", "SELECT c_custkey, coalesce(nullif(lower(trim(CASE WHEN c_custkey % 5 = 0 THEN ' Train ' ELSE '' END)), ''), nullif(lower(trim(CASE WHEN c_custkey % 3 = 0 THEN 'VAL' END)), ''), 'unknown') AS split FROM customer")
def metadata_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split that is given, sample before manifest."""
    from fathom.functions.clean import blank_to_null

    k = F.col("c_custkey")
    given = [F.when(k % 5 == 0, " Train ").otherwise(""), F.when(k % 3 == 0, "VAL")]
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(*(blank_to_null(F.lower(F.trim(g))) for g in given), F.lit("unknown")).alias("split"))


@query("last_index", "SELECT l_orderkey, l_linenumber, max(l_partkey) AS idx FROM lineitem GROUP BY ALL")
def last_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last place of each number, where numbers repeat."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max_by("l_partkey", "l_partkey").alias("idx"))


@query("names_parsed", "SELECT p_partkey, regexp_extract('epoch=' || p_size || '-seed' || p_partkey || '.ckpt', 'epoch=(\\d+)', 1)::BIGINT AS epoch, regexp_extract('epoch=' || p_size || '-seed' || p_partkey || '.ckpt', 'seed(\\d+)', 1)::BIGINT AS seed FROM part")
def names_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.format_string("epoch=%d-seed%d.ckpt", "p_size", "p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(name, r"epoch=(\d+)", 1).cast("bigint").alias("epoch"), F.regexp_extract(name, r"seed(\d+)", 1).cast("bigint").alias("seed"))


@query("flat_report", "SELECT l_returnflag AS section, unnest(['price.max', 'price.min', 'n']) AS metric, unnest([max(l_extendedprice), min(l_extendedprice), count(*)::DOUBLE]) AS value FROM lineitem GROUP BY 1")
def flat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report as sections, dotted metrics and values."""
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("section")).agg(F.struct(F.max("l_extendedprice").alias("max"), F.min("l_extendedprice").alias("min")).alias("price"), F.count("*").cast("double").alias("n"))
    flat = g.select("section", *(F.col(f"price.{c}").alias(f"price.{c}") for c in ("max", "min")), "n")
    return flat.unpivot("section", ["`price.max`", "`price.min`", "n"], "metric", "value")
