"""Queries over nested reports, tiers of a manifest, renumbered files, symmetric ligands, builds and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import coordinate_tables as nested
from fathom.operators import cases, curves, ligands, loaders, metrics, publication, renumber, splits, tiers
from fathom.operators import manifest as training
from fathom.registry import query
from fathom.streaming import builds
from fathom.streaming.incremental import shared_folder, stored

from .virtual import REGIONS, SQL_BRIDGE, SQL_MANIFEST, SQL_REGION, SQL_RES, SQL_ROWS, SQL_SCORED, bridge, manifest, points, predicted, r, read, residues, scored, tidy, vector_pairs

_KNOWN = (*REGIONS, "eval")
_T, _E = "tx*tx+ty*ty+tz*tz", "(px-tx)*(px-tx)+(py-ty)*(py-ty)+(pz-tz)*(pz-tz)"


def _bodies(moves: DataFrame) -> DataFrame:
    """A report of nested JSON for every family and 64 vectors: maps by region, a list of samples with maps by region."""
    rows = bridge(moves).withColumn("method", F.concat(F.lit("m"), F.col("family").cast("string"), F.lit("_"), F.floor(F.col("sample_id") / 64).cast("string")))
    names = {"n": "n_residues", "zero_rms": "zero_error_rms", "error_rms": "prediction_error_rms", "mse_improvement_fraction": "mse_improvement_vs_zero_fraction", "better_than_zero_rate": "better_than_zero_rate"}
    packed = lambda: F.struct(*(F.col(a).alias(b) for a, b in names.items()))
    by_map = lambda: F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", packed()))))
    one = metrics.region_metrics(rows, ["method", "sample_id", "region"]).groupBy("method", "sample_id").agg(by_map().alias("regions"))
    one = one.groupBy("method").agg(F.collect_list(F.struct("sample_id", "regions")).alias("samples"))
    pooled = metrics.region_metrics(rows, ["method", "region"]).groupBy("method").agg(by_map().alias("aggregate_by_region"))
    body = F.to_json(F.struct("aggregate_by_region", "samples"))
    return pooled.join(one, "method").select("method", F.concat(F.lit("Method "), F.col("method")).alias("label"), F.when(F.col("method") < "m3", "neural").otherwise("baseline").alias("category"), F.concat("method", F.lit(".json")).alias("source"), body.alias("body"))


_NESTED = SQL_BRIDGE + f""", nr AS (SELECT 'm' || family || '_' || (sample_id // 64) AS method, * FROM br), ns AS (SELECT method, sample_id, region, sqrt(avg({_T})) AS zero, sqrt(avg({_E})) AS err, 1 - avg({_E}) / nullif(avg({_T}), 0) AS gain FROM nr GROUP BY ALL)"""
_CATEGORY = "CASE WHEN method < 'm3' THEN 'neural' ELSE 'baseline' END AS category"


@query("coordinate_aggregate", f"""WITH {_NESTED} SELECT method, region, {_CATEGORY}, count(*) AS n_residues, {r(f'sqrt(avg({_T}))', 'zero_error_rms')}, {r(f'sqrt(avg({_E}))', 'prediction_error_rms')}, {r(f'1 - avg({_E}) / nullif(avg({_T}), 0)', 'mse_improvement_vs_zero_fraction')}, {r(f'avg((sqrt({_E}) < sqrt({_T}))::INT)', 'better_than_zero_rate')}, true AS ordered FROM nr GROUP BY method, region""")
def coordinate_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by method and region from nested reports; `ordered`: both intervals lie around the samples' own values."""
    out, samples = nested.coordinate_tables(_bodies(predicted(spark, sf_dir)), _KNOWN, iterations=400)
    own = samples.groupBy("method", "region").agg(F.avg("sample_improvement").alias("mean"), F.avg((F.col("sample_improvement") > 0).cast("double")).alias("rate"))
    out = out.join(own, ["method", "region"])
    end = lambda n, e: F.col(f"sample_improvement_{n}_ci95_{e}")
    inside = (end("mean", "low") <= F.col("mean") + 1e-9) & (end("mean", "high") >= F.col("mean") - 1e-9) & (end("rate", "low") <= F.col("rate") + 1e-9) & (end("rate", "high") >= F.col("rate") - 1e-9)
    return tidy(out.select("method", "region", "category", "n_residues", "zero_error_rms", "prediction_error_rms", "mse_improvement_vs_zero_fraction", "better_than_zero_rate", inside.alias("ordered")))


@query("coordinate_samples", f"WITH {_NESTED} SELECT method, sample_id::VARCHAR AS sample_id, region, {r('zero', 'zero_error_rms')}, {r('err', 'prediction_error_rms')}, {r('zero - err', 'sample_improvement')}, {r('gain', 'mse_improvement_vs_zero_fraction')} FROM ns")
def coordinate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nested.sample_metrics(_bodies(predicted(spark, sf_dir)), _KNOWN)
    return tidy(out.select("method", "sample_id", "region", "zero_error_rms", "prediction_error_rms", "sample_improvement", "mse_improvement_vs_zero_fraction"))


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two tiers of orders, which share those of three days, and one of customers; a pair is a customer and a priority, an accession a customer."""
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("accession"), F.concat_ws("_", "o_custkey", "o_orderpriority").alias("pair_id"),
        F.col("o_orderkey").cast("string").alias("entity"), (F.col("o_orderkey") % 10).alias("kind"), "o_orderstatus", F.col("o_totalprice").alias("price"),
    )
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), F.col("c_custkey").alias("accession"), F.concat_ws("_", "c_custkey", F.lit("model")).alias("pair_id"), F.lit(None).cast("string").alias("entity"), F.col("c_nationkey").alias("length"))
    quality = tiers.Test("quality_filter", ~F.col("price").between(20000, 300000))
    gold = tiers.Tier("gold", o.where("kind < 6"), [tiers.Test("not_of_kind", F.col("o_orderstatus") == "P"), quality], 220, ["pair_id"], "duplicate_pair_id", {"label_weight": 1.0})
    silver = tiers.Tier("silver", o.where("kind > 2"), [tiers.Barred("overlap_gold_entity", ["entity"], ["gold"]), quality], 320, ["pair_id"], "duplicate_pair_id", {"label_weight": 0.35})
    bronze = tiers.Tier("bronze", customers, [tiers.Barred("already_taken", ["accession"]), tiers.Test("length_filter", ~F.col("length").between(3, 20))], 600, (), values={"label_weight": 0.1})
    return tiers.select_tiers([gold, silver, bronze], ["accession", "pair_id", "entity"])


def _tier_sql() -> str:
    quality = "price NOT BETWEEN 20000 AND 300000"

    def tier(name: str, source: str, reason: str, cap: int, unique: bool, before: str) -> str:
        late = f"WHEN pair_id IN (SELECT pair_id FROM {before}) THEN '{name}_duplicate_pair_id'" if before and unique else ""
        out = f"{name}1 AS MATERIALIZED (SELECT position, accession, pair_id, entity, CASE {reason} {late} END AS reason FROM {source}), "
        again = f"CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY pair_id, reason IS NULL ORDER BY position) > 1 THEN '{name}_duplicate_pair_id' ELSE reason END" if unique else "reason"
        out += f"{name}2 AS MATERIALIZED (SELECT * REPLACE ({again} AS reason) FROM {name}1), {name}3 AS (SELECT coalesce(max(position), -1) AS last, count(*) AS n FROM (SELECT position FROM {name}2 WHERE reason IS NULL ORDER BY position LIMIT {cap})), "
        return out + f"{name}4 AS MATERIALIZED (SELECT a.* REPLACE (CASE WHEN n >= {cap} AND position > last THEN '{name}_beyond_cap' ELSE reason END AS reason) FROM {name}2 a, {name}3)"

    orders = "(SELECT o_orderkey AS position, o_custkey AS accession, o_custkey || '_' || o_orderpriority AS pair_id, o_orderkey::VARCHAR AS entity, o_orderstatus, o_totalprice AS price FROM orders WHERE o_orderkey % 10 {})"
    customers = "(SELECT c_custkey AS position, c_custkey AS accession, c_custkey || '_model' AS pair_id, NULL::VARCHAR AS entity, c_nationkey AS length FROM customer)"
    return ", ".join([
        tier("gold", orders.format("< 6"), f"WHEN o_orderstatus = 'P' THEN 'gold_not_of_kind' WHEN {quality} THEN 'gold_quality_filter'", 220, True, ""),
        tier("silver", orders.format("> 2"), f"WHEN entity IN (SELECT entity FROM gold4 WHERE reason IS NULL) THEN 'silver_overlap_gold_entity' WHEN {quality} THEN 'silver_quality_filter'", 320, True, "gold4 WHERE reason IS NULL"),
        tier("bronze", customers, "WHEN accession IN (SELECT accession FROM gold4 WHERE reason IS NULL UNION ALL SELECT accession FROM silver4 WHERE reason IS NULL) THEN 'bronze_already_taken' WHEN length NOT BETWEEN 3 AND 20 THEN 'bronze_length_filter'", 600, False, ""),
    ])


_ALL_TIERS = " UNION ALL ".join(f"SELECT '{t}' AS tier, {w} AS label_weight, * FROM {t}4" for t, w in (("gold", "1.0::DOUBLE"), ("silver", "0.35::DOUBLE"), ("bronze", "0.1::DOUBLE")))
_SPLIT = "(('0x' || substr(sha256(accession::VARCHAR), 1, 8))::BIGINT) % 100"


@query("mixed_manifest", f"WITH {_tier_sql()}, u AS ({_ALL_TIERS}) SELECT tier, position, accession, pair_id, label_weight, CASE WHEN {_SPLIT} < 70 THEN 'train' WHEN {_SPLIT} < 85 THEN 'val' ELSE 'test' END AS split FROM u WHERE reason IS NULL")
def mixed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taken rows of three tiers under their caps, with splits by accession."""
    taken, _ = _tiers(spark, sf_dir)
    return taken.select("tier", "position", "accession", "pair_id", "label_weight", splits.hash_split("accession").alias("split"))


@query("mixed_rejects", f"WITH {_tier_sql()}, u AS ({_ALL_TIERS}) SELECT tier, position, reason FROM u WHERE reason IS NOT NULL")
def mixed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir)[1].select("tier", "position", "reason")


@query("renumbered_atoms", """WITH l AS (SELECT o_orderpriority AS file, o_orderkey AS line_no, o_orderstatus AS chain, o_custkey AS residue FROM orders),
 b AS (SELECT *, lag(chain) OVER w AS c0, lag(residue) OVER w AS r0, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY file ORDER BY line_no)),
 s AS (SELECT *, n + sum((c0 IS NOT NULL AND chain <> c0)::INT) OVER (PARTITION BY file ORDER BY line_no) AS serial FROM b)
 SELECT file, 'ATOM' AS record, serial::BIGINT AS serial, chain, residue, line_no FROM s UNION ALL SELECT file, 'TER', (serial - 1)::BIGINT, c0, r0, NULL FROM s WHERE chain <> c0
 UNION ALL SELECT file, 'TER', (max(serial) + 1)::BIGINT, max_by(chain, serial), max_by(residue, serial), NULL FROM s GROUP BY file""")
def renumbered_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file for each priority in order, chains by status."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("line_no"), F.col("o_orderstatus").alias("chain"), F.col("o_custkey").alias("residue"))
    return renumber.renumbered(rows, ["file"], "line_no", "chain", "residue")


def _ligands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rings of six atoms of each vector as the pose of the vector ten before; every third has an oxygen on its first atom, every seventh ends in nitrogen."""
    rows = residues(spark, sf_dir, "").select("sample_id", F.col("idx").alias("serial"), "x", "y", "z").where((F.col("serial") < 6) | ((F.col("serial") == 6) & (F.col("sample_id") % 3 == 0)))
    ring = F.array(*(F.struct(F.lit(i).cast("bigint").alias("src"), F.lit((i + 1) % 6).cast("bigint").alias("dst")) for i in range(6)))
    tail = F.array(F.struct(F.lit(0).cast("bigint").alias("src"), F.lit(6).cast("bigint").alias("dst")))
    bonds = rows.select("sample_id").distinct().select("sample_id", F.explode(F.when(F.col("sample_id") % 3 == 0, F.concat(ring, tail)).otherwise(ring)).alias("b")).select("sample_id", "b.*")
    named = rows.withColumn("element", F.when(F.col("serial") == 6, "O").otherwise("C"))
    # the pose of sample s lies on target s - 30, which has the same kind of ring
    pose = named.select((F.col("sample_id") - 30).alias("sample_id"), F.col("sample_id").alias("pose"), "serial", F.when((F.col("sample_id") % 7 == 0) & (F.col("serial") == 5), "N").otherwise(F.col("element")).alias("element"), "x", "y", "z")
    pose_bonds = bonds.select((F.col("sample_id") - 30).alias("sample_id"), F.col("sample_id").alias("pose"), "src", "dst")
    return pose, pose_bonds, named, bonds


_SQUARE = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"


@query("symmetric_deviation", f"""WITH {SQL_RES}, spot AS (SELECT sample_id, idx AS i, tx AS x, ty AS y, tz AS z FROM residue WHERE idx < 6 OR (idx = 6 AND sample_id % 3 = 0)),
 t AS (SELECT s, k FROM (VALUES (1), (-1)) a(s), range(6) b(k)), pr AS (SELECT a.sample_id, b.sample_id AS pose, s, k, count(*) AS n, sum({_SQUARE}) AS total FROM spot a JOIN spot b ON b.sample_id = a.sample_id + 30, t
  WHERE (a.sample_id % 3 <> 0 OR k = 0) AND CASE WHEN a.i = 6 THEN b.i = 6 ELSE b.i <> 6 AND b.i = (s * a.i + k + 6) % 6 END GROUP BY ALL)
 SELECT sample_id, pose, CASE WHEN pose % 7 = 0 THEN 'elements_differ' ELSE 'ok' END AS status, {r('CASE WHEN pose % 7 <> 0 THEN min(sqrt(total / n)) END', 'rmsd')} FROM pr GROUP BY sample_id, pose""")
def symmetric_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least deviation of rings over their turns and mirror images."""
    return tidy(ligands.symmetric_deviation(*_ligands(spark, sf_dir), "sample_id", "pose"))


@query("feature_builds", f"""WITH {SQL_RES}, m AS (SELECT sample_id, count(*) AS n, avg(tx) AS x FROM residue GROUP BY sample_id)
 SELECT sample_id, CASE WHEN sample_id % 10 = 0 THEN 1 ELSE 0 END::BIGINT AS run, {r('CASE WHEN sample_id % 10 = 0 THEN x + 1 ELSE x END', 'x')} FROM m WHERE sample_id % 9 <> 1 AND sample_id % 11 <> 2""")
def feature_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a build: the second finds every tenth sample changed and every ninth gone; some are rejected."""
    rows = residues(spark, sf_dir).groupBy("sample_id").agg(F.count("*").alias("n"), F.round(F.avg("tx"), 9).alias("x"))
    folder = f"{shared_folder(spark).rstrip('/')}/builds-{uuid.uuid4().hex}"
    build = lambda changed: changed.select("sample_id", "x")
    tests = [("length_mismatch", F.col("n") != 21), ("missing_structure", F.col("sample_id") % 11 == 2)]
    builds.build_features(rows, "sample_id", build, folder, tests)
    second = rows.where("sample_id % 9 <> 1").withColumn("x", F.when(F.col("sample_id") % 10 == 0, F.col("x") + 1).otherwise(F.col("x")))
    builds.build_features(second, "sample_id", build, folder, tests)
    return tidy(builds.features(spark, folder, "sample_id").select("sample_id", F.col("run").cast("bigint").alias("run"), "x"))


def _report_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    m = manifest(spark, sf_dir).select(F.lit("mixed").alias("manifest"), F.col("accession").alias("uniprot_id"), F.col("pair_id").cast("string").alias("pdb_id"), F.col("accession").alias("split_group_id"), "family", "state_label", splits.hash_split("accession").alias("split"))
    rows = points(stored(vector_pairs(spark, sf_dir)))  # vectors meet once for all tables
    moved = bridge(rows).select(F.lit("gold").alias("scope"), F.when(F.col("sample_id") % 3 == 0, "test").otherwise("train").alias("split"), "sample_id", "idx", "region", F.sqrt(F.expr("tx*tx + ty*ty + tz*tz")).alias("displacement"))
    each = metrics.paired_deltas(metrics.region_metrics(bridge(rows), ["sample_id", "region"]))
    deltas = each.select((F.col("sample_id") % 5).alias("seed"), F.floor(F.col("sample_id") / 5).alias("target"), "region", "delta")
    lines = read(spark, sf_dir, "lineitem")
    checks = lines.select(F.col("l_linestatus").alias("scope"), F.col("l_orderkey").alias("pair_id"), F.when(F.col("l_quantity") > 49, "too_long").alias("reason"))
    classes = curves.areas(scored(spark, sf_dir), ["lang"]).withColumnRenamed("lang", "label").withColumn("region", F.lit("eval"))
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("selector"), (F.col("user_id") % 3).alias("endpoint"), "value")
    templates = read(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("candidate_count"), (F.col("p_retailprice") / 2000).alias("nearest_identity"), (F.col("p_size") / 50).alias("nearest_coverage"))
    files = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return {"manifests": m, "residues": moved, "checks": checks, "reports": _bodies(rows), "deltas": deltas, "classification": classes, "selectors": events, "templates": templates, "files": files}


_COUNTS = {
    "manifest_field_counts.csv": "(SELECT count(DISTINCT family) + count(DISTINCT coalesce(nullif(trim(state_label), ''), 'missing')) FROM manifest)",
    "graph_region_summary.csv": "(SELECT count(*) FROM (SELECT DISTINCT sample_id % 3 = 0, region FROM br))", "displacement_bin_summary.csv": "(SELECT 5 * count(*) FROM (SELECT DISTINCT sample_id % 3 = 0, region FROM br))",
    "coordinate_metrics_summary": "(SELECT count(*) FROM (SELECT DISTINCT method, region FROM nr))", "coordinate_sample_metrics.csv": "(SELECT count(*) FROM ns)",
    "neural_ablation_summary": "(SELECT count(*) FROM (SELECT DISTINCT method, region FROM nr WHERE method < 'm3'))",
    "primary_model_paired_delta_summary": "(SELECT count(*) FROM (SELECT DISTINCT sample_id % 5, region FROM br UNION ALL SELECT DISTINCT -1, region FROM br))",
    "primary_model_paired_delta_samples": "(SELECT count(*) FROM (SELECT DISTINCT sample_id, region FROM br UNION ALL SELECT DISTINCT -1 - sample_id // 5, region FROM br))",
    "classification_metrics_summary": "(SELECT count(DISTINCT lang) FROM scored)", "selector_sensitivity_summary": "(SELECT count(*) FROM (SELECT DISTINCT event_type, user_id % 3 FROM events))",
    "dataset_summary.json": "1", "strict_input_checks.json": "(SELECT count(DISTINCT l_linestatus) FROM lineitem)", "graph_summary.json": "(SELECT count(DISTINCT sample_id % 3 = 0) FROM br)", "template_selection_summary.json": "1",
    "quality_flags.json": "(SELECT count(*) FROM (SELECT l_linestatus FROM lineitem WHERE l_quantity > 49 GROUP BY 1)) + (SELECT count(*) FROM (SELECT lang FROM scored GROUP BY lang HAVING count(DISTINCT y) < 2)) + (SELECT (count(*) > 0)::INT FROM part WHERE p_size % 4 = 0)",
    "reproducibility_manifest.json": "(SELECT count(*) FROM benchmark)",
}


@query("publication_report", f"WITH {_NESTED}, {SQL_MANIFEST}, {SQL_SCORED} " + " UNION ALL ".join(f"SELECT '{n}' AS name, '{n.rpartition('.')[2]}' AS format, ({sql})::BIGINT AS n_rows" for k, sql in _COUNTS.items() for n in ([k] if "." in k else [f"{k}.csv", f"{k}.json"])))
def publication_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a report of 22 tables and returns its list of tables."""
    folder = f"{shared_folder(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    tables = publication.publication_tables(_report_inputs(spark, sf_dir), _KNOWN, fields=("family", "state_label"), neural=("neural",), iterations=200)
    return builds.write_report(tables, folder).select("name", "format", "n_rows")


_EXT = SQL_BRIDGE + f""", x AS (SELECT sample_id, count(*) AS n, avg({_T}) AS t, avg({_E}) AS e, avg((px*tx+py*ty+pz*tz) / (greatest(sqrt(px*px+py*py+pz*pz), 1e-8) * greatest(sqrt({_T}), 1e-8))) AS c FROM both_rows WHERE idx BETWEEN 8 AND 9 AND sample_id % 2 = 0 GROUP BY ALL)"""


@query("state_extensions", f"WITH {_EXT} SELECT s.sample_id, n AS extension_n_residues, {r('sqrt(t)', 'extension_target_rms')}, {r('sqrt(e)', 'extension_error_rms')}, {r('1 - e / nullif(t, 0)', 'extension_mse_improvement_fraction')}, {r('c', 'extension_direction_cosine')} FROM (SELECT DISTINCT sample_id FROM both_rows) s LEFT JOIN x USING (sample_id)")
def state_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the plug's extension, which every other sample has."""
    rows = predicted(spark, sf_dir).withColumns({c: F.col(f"t{c}") for c in "xyz"})
    more = rows.where("idx between 8 and 9 and sample_id % 2 = 0").withColumn("region", F.lit("plug_extension_nt"))
    out = metrics.state_metrics(bridge(rows).unionByName(more), 0.02)
    return tidy(out.select("sample_id", "extension_n_residues", "extension_target_rms", "extension_error_rms", "extension_mse_improvement_fraction", "extension_direction_cosine"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge(predicted(spark, sf_dir)).groupBy("sample_id", "idx").agg(F.array_sort(F.collect_list("region")).alias("regions"), *(F.first(f"{p}{c}").alias(f"{p}{c}") for p in "tp" for c in "xyz"))
    return rows.select("sample_id", "idx", F.when(F.col("idx") % 7 == 6, F.concat(F.lit("B_"), "idx", F.lit("x"))).otherwise(F.concat(F.lit("A_"), "idx")).alias("residue_id"), "regions", *(F.round(F.col(f"t{c}"), 3).alias(c) for c in "xyz"), *(F.round(F.col(f"p{c}"), 3).alias(f"p{c}") for c in "xyz"))


_STRUCTURES = {"start": "", "prediction": "p"}
_CASE = SQL_ROWS + ", cs AS (SELECT sample_id, idx, " + ", ".join(f"round({p}{c}, 3) AS {p}{c}" for p in "tp" for c in "xyz") + f", {SQL_REGION} AS main FROM both_rows), st AS (SELECT sample_id, idx, main, 'start' AS structure, tx AS x, ty AS y, tz AS z FROM cs UNION ALL SELECT sample_id, idx, main, 'prediction', tx + px, ty + py, tz + pz FROM cs)"


@query("case_lines", f"""WITH {_CASE} SELECT sample_id, structure, (idx + 1)::BIGINT AS line_no, CASE main WHEN 'tonb_box' THEN 'TON' WHEN 'plug' THEN 'PLG' WHEN 'barrel_core' THEN 'BAR' ELSE 'EVL' END AS code, CASE WHEN idx % 7 = 6 THEN 'B' ELSE 'A' END AS chain, idx::BIGINT AS resseq, {r('x', 'x', 3)}, {r('z', 'z', 3)} FROM st""")
def case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure lines of every sample, told apart again by their columns."""
    rows = cases.case_lines(_cases(spark, sf_dir), _STRUCTURES).where("line <> 'END'")
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    return tidy(rows.select("sample_id", "structure", F.col("line_no").cast("bigint").alias("line_no"), cut(18, 3).alias("code"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("bigint").alias("resseq"), cut(31, 8).try_cast("double").alias("x"), cut(47, 8).try_cast("double").alias("z")), 3)


@query("case_centroids", f"""WITH {_CASE}, rg AS (SELECT *, main AS region FROM st UNION ALL SELECT *, 'eval' FROM st WHERE idx >= 8), c AS (SELECT sample_id, region, structure, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM rg GROUP BY ALL)
 SELECT a.sample_id, a.region, a.structure, {r('a.x', 'centroid_x')}, {r('a.y - b.y', 'delta_y')}, {r('sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))', 'displacement')}, a.n AS n_residues FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.region = b.region AND b.structure = 'start'""")
def case_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cases.case_centroids(_cases(spark, sf_dir), _STRUCTURES)
    return tidy(out.select("sample_id", "region", "structure", "centroid_x", "delta_y", "displacement", "n_residues"))


@query("figure_audit", """WITH f AS (SELECT p_partkey, p_partkey % 3 = 0 AS no_source, p_partkey % 4 = 0 AS no_png FROM part)
 SELECT 'f' || p_partkey AS figure_id, CASE WHEN no_source OR no_png THEN 'needs_attention' ELSE 'pass' END AS technical_status, 'fit_for_stated_claim' || CASE WHEN p_partkey = 1 THEN '_with_caveat' ELSE '' END AS scientific_status,
 CASE WHEN no_source THEN 'b' || p_partkey ELSE '' END AS missing_sources, CASE WHEN no_png THEN 'out' || p_partkey || '.png' ELSE '' END AS missing_outputs FROM f""")
def figure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure for each part, some without a source or a rendering."""
    p = read(spark, sf_dir, "part").select("p_partkey")
    name = lambda prefix, end="": F.concat(F.lit(prefix), F.col("p_partkey").cast("string"), F.lit(end))
    figures = p.select(name("f").alias("figure_id"), F.array(name("a"), name("b")).alias("sources"), name("out").alias("output"))
    listing = p.select(name("a").alias("path")).unionByName(p.where("p_partkey % 3 <> 0").select(name("b").alias("path"))).unionByName(p.select(name("out", ".pdf").alias("path"))).unionByName(p.where("p_partkey % 4 <> 0").select(name("out", ".png").alias("path")))
    return cases.audit(figures, listing, ["png", "pdf"], ["f1"])


@query("loaded_samples", f"""WITH {SQL_RES} SELECT sample_id, idx, {r('tx', 'tx')}, {r('ty * 2', 'y')}, CASE WHEN sample_id % 4 = 0 THEN 0.5 WHEN sample_id % 4 = 1 THEN 0 ELSE idx END::DOUBLE AS plddt, CASE WHEN sample_id % 3 = 0 THEN 'fep_a' ELSE 'id_' || family END AS family, CASE WHEN sample_id % 5 = 0 THEN 'from_metadata' WHEN sample_id % 2 = 0 THEN 'holo' ELSE 'unknown' END AS state, 'unknown' AS substrate FROM residue""")
def loaded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with labels in several places and one value for all residues, as one typed table."""
    k = F.col("sample_id")
    at = lambda factor: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.get("embedding", i * 3 + j).cast("double") * factor))
    records = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", "embedding").select(
        "sample_id", at(1).alias("y_delta"), F.lit(None).cast("array<array<double>>").alias("pos"), at(2).alias("af2_pos"),
        F.when(k % 4 == 0, F.array(F.lit(0.5))).when(k % 4 == 1, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i.cast("double"))).alias("plddt"),
        F.create_map(F.lit("family"), F.when(k % 3 == 0, "Fep-A").otherwise("")).alias("manifest_row"), F.create_map(F.lit("state"), F.when(k % 5 == 0, " From metadata ")).alias("metadata"),
        F.col("label").alias("family_id"), F.when(k % 2 == 0, "HOLO").alias("state"),
    )
    return tidy(loaders.load_samples(records).select("sample_id", "idx", "tx", "y", "plddt", "family", "state", "substrate"))


@query("mechanistic_summary", f"""WITH {_NESTED}, a AS (SELECT method, region, sqrt(avg({_E})) AS err, sqrt(avg({_T})) AS zero FROM nr WHERE region <> 'plug' GROUP BY ALL), p AS (SELECT method, region, count(*) AS n, count(*) FILTER (err < zero) AS better FROM ns WHERE region <> 'eval' GROUP BY ALL)
 SELECT coalesce(a.method, p.method) AS method, coalesce(a.region, p.region) AS region, {r('err', 'prediction_error_rms')}, {r('zero', 'raw_rmsd')}, n::DOUBLE AS n_targets, better::DOUBLE AS n_improved, CASE WHEN p.method IS NOT NULL THEN CASE WHEN p.region = 'tonb_box' THEN 0.25 ELSE 0.5 END END::DOUBLE AS effect FROM a FULL JOIN p ON a.method = p.method AND a.region = p.region""")
def mechanistic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of reports whose metrics lack one region, whose paired differences another, and whose effects lie in a map of their own."""
    rows = bridge(predicted(spark, sf_dir)).withColumn("method", F.concat(F.lit("m"), F.col("family").cast("string"), F.lit("_"), F.floor(F.col("sample_id") / 64).cast("string")))
    mapped = lambda df, *cols: df.groupBy("method").agg(F.map_from_entries(F.collect_list(F.struct("region", F.struct(*cols)))).alias("m"))
    own = mapped(metrics.region_metrics(rows.where("region <> 'plug'"), ["method", "region"]), F.col("error_rms").alias("prediction_error_rms"), F.col("zero_rms").alias("zero_error_rms"))
    each = metrics.region_metrics(rows.where("region <> 'eval'"), ["method", "sample_id", "region"])
    pairs = each.groupBy("method", "region").agg(F.count("*").alias("n_targets"), F.count_if(F.col("error_rms") < F.col("zero_rms")).alias("n_improved"))
    effect = F.when(F.col("region") == "tonb_box", 0.25).alias("signed_rank_biserial_effect_method_lt_raw")
    effects = pairs.groupBy("method").agg(F.map_from_entries(F.collect_list(F.struct("region", F.lit(0.5)))).alias("e"))
    body = F.to_json(F.struct(F.col("o.m").alias("aggregate_by_region"), F.col("p.m").alias("paired_delta_by_region"), F.col("e").alias("paired_effect_by_region")))
    reports = own.alias("o").join(mapped(pairs, "n_targets", "n_improved", effect).alias("p"), "method").join(effects, "method").select("method", F.col("method").alias("label"), F.lit("x").alias("category"), F.col("method").alias("source"), body.alias("body"))
    out = nested.summary_rows(reports, _KNOWN)
    return tidy(out.select("method", "region", "prediction_error_rms", "raw_rmsd", "n_targets", "n_improved", F.col("signed_rank_biserial_effect_method_lt_raw").alias("effect")))


_PREPARED = """t AS (SELECT o_orderkey AS position, (o_orderkey // 2 * 2)::BIGINT AS pair, o_custkey, o_orderpriority, o_orderstatus, o_orderkey % 2 = 0 AND (o_orderkey // 2) % 5 <> 0 AS plain FROM orders),
 d AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY position) > 1 AS again FROM t),
 q AS (SELECT *, CASE WHEN again THEN 'duplicate_pair_id' WHEN o_orderstatus = 'P' THEN 'uncertain_state' WHEN position % 7 = 0 THEN 'missing_local_files:af2_pdb' END AS early,
   CASE WHEN o_custkey % 6 = 0 THEN 'own' WHEN o_custkey % 6 = 1 THEN 'beside' WHEN o_custkey % 6 = 2 THEN 'core' WHEN o_custkey % 6 = 3 THEN 'no_core' ELSE 'none' END AS has, pair % 3 <> 1 AS found FROM d),
 m AS (SELECT o_custkey, min(position) AS maker FROM q WHERE early IS NULL AND has IN ('no_core', 'none') AND found GROUP BY 1),
 s AS (SELECT q.*, CASE WHEN early IS NULL THEN CASE WHEN has IN ('own', 'beside') THEN 'existing' WHEN has = 'core' OR position > maker THEN 'cached' WHEN position = maker THEN CASE has WHEN 'none' THEN 'generated' ELSE 'regenerated_missing_core' END END END AS source FROM q LEFT JOIN m USING (o_custkey))"""


@query("prepared_manifest", f"WITH {_PREPARED} SELECT position, source AS annotation_source, CASE has WHEN 'own' THEN 'x/own' || o_custkey WHEN 'beside' THEN 'ann/T-' || o_custkey || '.json' ELSE 'ann/auto/t_' || o_custkey || '.json' END AS region_annotation_json, o_orderpriority AS chain, 'A' AS af2_chain, CASE WHEN position % 3 = 0 THEN 'see: auto region annotation generated for supervised smoke training.; ' ELSE '' END || 'training_manifest_auto_annotation' AS notes FROM s WHERE early IS NULL AND source IS NOT NULL")
def prepared_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a training manifest, customers as targets, with annotations of every source."""
    kept, _ = _prepared(spark, sf_dir)
    return kept.select("position", "annotation_source", "region_annotation_json", "chain", "af2_chain", "notes")


@query("prepared_rejects", f"WITH {_PREPARED} SELECT position, coalesce(early, 'no_matching_entity') AS reason FROM s WHERE early IS NOT NULL OR source IS NULL")
def prepared_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir)[1].select("position", "reason")


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    pair = F.floor(k / 2) * 2
    rows = read(spark, sf_dir, "orders").select(
        k.alias("position"), pair.cast("string").alias("pair_id"), F.concat(F.lit("T-"), c).alias("target_id"), F.lit("f").alias("family"), c.alias("uniprot_id"), F.col("o_orderpriority").alias("pdb_chain"),
        F.when(F.col("o_orderstatus") == "P", "uncertain").otherwise("holo").alias("state_label"), F.when(F.col("o_custkey") % 6 == 0, F.concat(F.lit("x/own"), c)).otherwise(" ").alias("region_annotation_json"),
        F.when(k % 3 == 0, f"see: {training.NOTES[0]}").alias("notes"), F.lit("").alias("split"), F.concat(F.lit("m"), k.cast("string")).alias("af2_pdb"), F.lit("").alias("experimental_pdb"),
    )
    files = rows.where("position % 7 <> 0").select(F.col("af2_pdb").alias("path"))
    kind = F.col("o_custkey") % 6
    path = F.when(kind == 0, F.concat(F.lit("x/own"), c)).when(kind == 1, F.concat(F.lit("ann/T-"), c, F.lit(".json"))).when(kind < 4, F.concat(F.lit("ann/auto/t_"), c, F.lit(".json")))
    annotations = read(spark, sf_dir, "orders").select(path.alias("path"), (kind < 3).alias("has_core")).where("path is not null").distinct()
    found = rows.where("cast(pair_id as bigint) % 3 <> 1").select("pair_id")
    return training.prepared_manifest(rows, files, annotations, found, "ann/auto")
