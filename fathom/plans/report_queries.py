"""Queries for summaries, counts, seeds and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import clean
from fathom.operators import baselines, reports
from fathom.registry import query

from .virtual import SQL_MANIFEST, SQL_RUNS, manifest, r, read, runs, tidy


@query("value_counts", f"""WITH {SQL_MANIFEST}, u AS (SELECT 'family' AS field, coalesce(nullif(trim(family), ''), 'missing') AS value FROM manifest UNION ALL SELECT 'state_label', coalesce(nullif(trim(state_label), ''), 'missing') FROM manifest) SELECT field, value, count(*) AS n FROM u GROUP BY ALL""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.value_counts(manifest(spark, sf_dir), ["family", "state_label"])


@query("manifest_summary", f"WITH {SQL_MANIFEST} SELECT count(*) AS n_rows, count(DISTINCT accession) AS n_accessions, count(DISTINCT family) AS n_families, count(nullif(trim(state_label), '')) AS n_states, {r('avg(number)', 'mean')}, {r('median(number)', 'median')} FROM manifest")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    return tidy(m.agg(F.count("*").alias("n_rows"), F.count_distinct("accession").alias("n_accessions"), F.count_distinct("family").alias("n_families"), F.count(clean.blank_to_null("state_label")).alias("n_states"), F.avg("number").alias("mean"), F.median("number").alias("median")))


@query("describe_numbers", f"WITH {SQL_MANIFEST} SELECT family, count(number) AS n, {r('avg(number)', 'mean')}, {r('median(number)', 'median')}, {r('min(number)', 'min')}, {r('max(number)', 'max')}, {r('quantile_cont(number, 0.1)', 'p10')}, {r('quantile_cont(number, 0.9)', 'p90')} FROM manifest WHERE NOT bad GROUP BY family")
def describe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the cells that are numbers."""
    m = manifest(spark, sf_dir).withColumn("value", F.when(clean.number("resolution").isNotNull(), F.col("number"))).where("value is not null")
    return tidy(reports.describe(m, "value", ["family"]))


@query("label_encoding", f"""WITH {SQL_MANIFEST}, l AS (SELECT pair_id, coalesce(nullif(replace(replace(lower(trim(state_label)), '-', '_'), ' ', '_'), ''), 'unknown') AS label FROM manifest)
 SELECT pair_id, label, CASE label WHEN 'automobile' THEN 1 WHEN 'building' THEN 2 WHEN 'furniture' THEN 3 ELSE 0 END::BIGINT AS code FROM l""")
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).withColumn("label", clean.label("state_label"))
    return m.select("pair_id", "label", clean.encode("label", ["unknown", "automobile", "building", "furniture"]).cast("bigint").alias("code"))


@query("alias_coalesce", f"WITH {SQL_MANIFEST} SELECT pair_id, coalesce(nullif(trim(state_label), ''), nullif(trim(family), ''), 'none') AS label FROM manifest")
def alias_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    return m.select("pair_id", clean.first_present(m, ["target_state", "state_label", "family"], "none").alias("label"))


@query("class_rules", """SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_type), 'promo') THEN 'promo' ELSE 'other' END AS kind FROM part""")
def class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", clean.first_match(F.col("p_type"), [(("steel", "brass"), "metal"), (("promo",), "promo")], "other").alias("kind"))


@query("quality_filter", "SELECT p_partkey, CASE WHEN p_size NOT BETWEEN 5 AND 45 THEN 'size' WHEN p_retailprice < 950 THEN 'price' ELSE 'kept' END AS reason FROM part")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's first failing test."""
    rows = reports.reasons(read(spark, sf_dir, "part"), [("size", ~F.col("p_size").between(5, 45)), ("price", F.col("p_retailprice") < 950)])
    return rows.select("p_partkey", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("reject_counts", "SELECT CASE WHEN p_size NOT BETWEEN 5 AND 45 THEN 'size' WHEN p_retailprice < 950 THEN 'price' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1")
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query("truthy_cells", "SELECT o_orderkey, o_orderstatus = 'F' OR o_orderkey % 3 = 0 AS flag FROM orders")
def truthy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when((F.col("o_orderstatus") == "F"), " True").when(F.col("o_orderkey") % 3 == 0, "YES").otherwise("no")
    return read(spark, sf_dir, "orders").select("o_orderkey", clean.truthy(cell).alias("flag"))


@query("bin_grid", """WITH b AS (SELECT p_brand, CASE WHEN p_size < 10 THEN '1to10' WHEN p_size < 20 THEN '10to20' WHEN p_size < 60 THEN '20to60' ELSE 'gt60' END AS bin FROM part),
 g AS (SELECT p_brand, bin FROM (SELECT DISTINCT p_brand FROM part), (VALUES ('1to10'), ('10to20'), ('20to60'), ('gt60')) t(bin)), c AS (SELECT p_brand, bin, count(*) AS n FROM b GROUP BY ALL)
 SELECT p_brand, bin, coalesce(n, 0) AS n, (sum(coalesce(n, 0)) OVER (PARTITION BY p_brand))::BIGINT AS total, round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY p_brand), 0), 6) + 0.0 AS fraction FROM g LEFT JOIN c USING (p_brand, bin)""")
def bin_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(reports.bin_grid(read(spark, sf_dir, "part"), [], "p_brand", "p_size", [1, 10, 20, 60]))


@query("seed_aggregate", f"WITH {SQL_RUNS} SELECT method, target, count(value) AS n, {r('avg(value)', 'mean', 9)}, {r('coalesce(stddev_samp(value), 0)', 'sd', 9)}, {r('min(value)', 'min', 9)}, {r('max(value)', 'max', 9)} FROM runs GROUP BY ALL")
def seed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(reports.seed_aggregate(runs(spark, sf_dir), ["method", "target"]), 9)


@query("seed_family_deltas", f"""WITH {SQL_RUNS}, m AS (SELECT method, target, avg(value) AS v, count(DISTINCT seed) AS seeds FROM runs GROUP BY ALL), b AS (SELECT target, v AS raw FROM m WHERE method = 'view'), d AS (SELECT method, v - raw AS delta, seeds FROM m JOIN b USING (target) WHERE method <> 'view')
 SELECT method, count(*) AS n, max(seeds) AS seeds, count(*) FILTER (delta < 0) AS n_improved, {r('avg(delta)', 'mean_delta')}, {r('median(delta)', 'median_delta')} FROM d GROUP BY method""")
def seed_family_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over seeds first, then differences to one method."""
    m = runs(spark, sf_dir).groupBy("method", "target").agg(F.avg("value").alias("v"), F.count_distinct("seed").alias("seeds"))
    raw = m.where("method = 'view'").select("target", F.col("v").alias("raw"))
    d = m.where("method <> 'view'").join(raw, "target").withColumn("delta", F.col("v") - F.col("raw"))
    return tidy(d.groupBy("method").agg(F.count("*").alias("n"), F.max("seeds").alias("seeds"), F.count_if(F.col("delta") < 0).alias("n_improved"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta")))


@query("best_of_group", f"WITH {SQL_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(value, 6) DESC NULLS LAST, target, seed) AS k FROM runs) SELECT method, target, seed::BIGINT AS seed, {r('value', 'value')} FROM k WHERE k = 1")
def best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).withColumn("value", F.round("value", 6))
    return tidy(reports.best_of(rows, ["method"], "value", ["target", "seed"]))


@query("validated_selection", f"""WITH {SQL_RUNS}, m AS (SELECT method, target, avg(value) FILTER (seed = 0) AS val, avg(value) FILTER (seed = 1) AS test FROM runs GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(val, 6) DESC, target) AS k FROM m WHERE val IS NOT NULL AND test IS NOT NULL) SELECT method, target, {r('val', 'val')}, {r('test', 'test')} FROM k WHERE k = 1""")
def validated_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best target of each method on one seed, with its value on another."""
    w = runs(spark, sf_dir).groupBy("method", "target").agg(F.avg(F.when(F.col("seed") == 0, F.col("value"))).alias("val"), F.avg(F.when(F.col("seed") == 1, F.col("value"))).alias("test"))
    rows = w.where("val is not null and test is not null").withColumn("key", F.round("val", 6))
    return tidy(reports.best_of(rows, ["method"], "key", ["target"]).drop("key"))


@query("base_contrast", f"WITH {SQL_RUNS}, m AS (SELECT method, avg(value) AS a, max(value) AS b FROM runs GROUP BY method) SELECT m.method, {r('m.a - v.a', 'd_a')}, {r('m.b - v.b', 'd_b')} FROM m, m v WHERE v.method = 'view'")
def base_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = runs(spark, sf_dir).groupBy("method").agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    return tidy(reports.against(m, "method", "view", ["a", "b"]))


@query("selection_score", f"""WITH {SQL_RUNS}, m AS (SELECT target, avg(value) FILTER (method = 'view') AS a, avg(value) FILTER (method = 'click') AS b, avg(value) FILTER (method = 'purchase') AS c FROM runs GROUP BY target)
 SELECT target, {r('(coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0) - 0.25 * coalesce(greatest(0, c - 0.05), 0)', 'score', 9)} FROM m""")
def selection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = runs(spark, sf_dir).groupBy("target").agg(*(F.avg(F.when(F.col("method") == e, F.col("value"))).alias(c) for e, c in (("view", "a"), ("click", "b"), ("purchase", "c"))))
    return tidy(m.select("target", reports.selection_score(["a", "b"], "c").alias("score")), 9)


@query("quality_flags", """WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_discount) AS d, max(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_returnflag, 'warning' AS severity, 'high_discount' AS issue FROM s WHERE d > 0.01 UNION ALL SELECT l_returnflag, 'error', 'few_rows' FROM s WHERE n < 20000 UNION ALL SELECT l_returnflag, 'info', 'large_orders' FROM s WHERE q >= 50""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_discount").alias("d"), F.max("l_quantity").alias("q"))
    rules = [("warning", "high_discount", F.col("d") > 0.01), ("error", "few_rows", F.col("n") < 20000), ("info", "large_orders", F.col("q") >= 50)]
    return reports.flags(s, rules).select("l_returnflag", "severity", "issue")


@query("keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.keep_first(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("metric_matrix", f"""WITH {SQL_RUNS} SELECT target, {', '.join(r(f"avg(value) FILTER (method = '{m}')", m) for m in ('click', 'purchase', 'view'))} FROM runs GROUP BY target""")
def metric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by methods, side by side."""
    return tidy(runs(spark, sf_dir).groupBy("target").pivot("method", ["click", "purchase", "view"]).agg(F.avg("value")))


@query("unpivoted_metrics", "WITH s AS (SELECT l_returnflag, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1) SELECT l_returnflag, metric, round(value, 6) + 0.0 AS value FROM s UNPIVOT (value FOR metric IN (quantity, discount))")
def unpivoted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return tidy(s.unpivot("l_returnflag", ["quantity", "discount"], "metric", "value"))


@query("complete_seeds", f"WITH {SQL_RUNS} SELECT method, target, count(DISTINCT seed) AS seeds, count(DISTINCT seed) = 5 AS complete FROM runs GROUP BY ALL")
def complete_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("method", "target").agg(F.count_distinct("seed").alias("seeds"), (F.count_distinct("seed") == 5).alias("complete"))


@query("lowest_epoch", "WITH d AS (SELECT event_type, day(ts)::BIGINT AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY ALL) SELECT event_type, min_by(epoch, (loss, epoch)) AS epoch FROM d GROUP BY 1")
def lowest_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch of the least loss; ties go to the first."""
    d = read(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").cast("bigint").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return d.groupBy("event_type").agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"))


@query("feature_ablation", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN i IN (1, 4) THEN 0 ELSE x::DOUBLE END)), 4) + 0.0 AS total FROM embeddings")
def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    zeroed = F.transform("embedding", lambda x, i: F.when(i.isin(0, 3), 0.0).otherwise(x.cast("double")))
    return read(spark, sf_dir, "embeddings").select("vec_id", (F.round(F.aggregate(zeroed, F.lit(0.0), lambda a, b: a + b), 4) + F.lit(0.0)).alias("total"))


@query("ridge_fit")
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices predicted from quantity, discount and tax; the mean error by flag."""
    li = read(spark, sf_dir, "lineitem")
    w = baselines.ridge(li, ["l_quantity", "l_discount", "l_tax"], ["l_extendedprice"])
    rows = li.withColumn("p", baselines.linear(w, "l_extendedprice"))
    return tidy(rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("p") - F.col("l_extendedprice"), F.lit(2.0)))).alias("rmse")), 2)


@query("strict_checks", """WITH f AS (SELECT l_orderkey, l_linenumber, 'quantity' AS kind FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT l_orderkey, l_linenumber, 'discount' FROM lineitem WHERE l_discount > 0.09), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY l_orderkey, l_linenumber) AS k FROM f)
 SELECT kind, count(*) AS n, min(l_orderkey) FILTER (k = 8) AS eighth FROM k GROUP BY kind""")
def strict_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks by kind with the order of the eighth example."""
    li = read(spark, sf_dir, "lineitem")
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("l_quantity") > 49, "quantity"), F.when(F.col("l_discount") > 0.09, "discount"))))
    rows = li.select("l_orderkey", "l_linenumber", kinds.alias("kind")).withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("l_orderkey", "l_linenumber")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min(F.when(F.col("k") == 8, F.col("l_orderkey"))).alias("eighth"))


@query("report_order", f"WITH {SQL_RUNS}, m AS (SELECT method, count(*) AS n FROM runs GROUP BY method) SELECT method, n, CASE method WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 99 END::BIGINT AS place FROM m ORDER BY place, method")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.operators.regions import ordered_case

    m = runs(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"))
    return m.withColumn("place", ordered_case(F.col("method"), ["view", "click"]).cast("bigint")).orderBy("place", "method")
