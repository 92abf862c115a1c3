"""Queries over nested records and strict lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import records
from fathom.registry import query

from .virtual import SQL_RES, r, read, residues, tidy


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


@query("marked_records", "SELECT conv_id, bool_or(role IN ('system', 'tool')) AS marked, count(*) AS n, min(length(text))::BIGINT AS shortest, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY 1")
def marked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers, sizes and sorted distinct fields of nested records."""
    t = _turns(spark, sf_dir)
    return t.select("conv_id", records.marked("turns", "role", ["system", "tool"]).alias("marked"), F.size("turns").cast("bigint").alias("n"), F.array_min(F.transform("turns.text", lambda x: F.length(x))).cast("bigint").alias("shortest"), F.array_join(F.array_sort(F.array_distinct("turns.role")), ",").alias("roles"))


@query("flat_record_text", "SELECT conv_id, length(array_to_string(list(role || ' ' || text ORDER BY turn, role, text), ' '))::BIGINT AS n FROM conversations GROUP BY 1")
def flat_record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", F.length(records.flat_text("turns", "role", "text")).cast("bigint").alias("n"))


@query("excluded_mentions", "SELECT p_partkey, (contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin')) AND NOT regexp_matches(lower(p_type), 'small|promo') AS hit FROM part")
def excluded_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", records.mentions(F.col("p_type"), ["steel", "tin"], "small|promo").alias("hit"))


@query("record_keys", "SELECT p_partkey, regexp_replace(lower(p_brand || '_' || p_type || '_' || p_size), '[^a-z0-9_.\\-]+', '_', 'g') AS key FROM part")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", records.slug("p_brand", "p_type", F.col("p_size").cast("string")).alias("key"))


@query("short_labels", "SELECT s_suppkey, CASE WHEN k = 1 THEN n_name ELSE n_name || ' #' || k END AS short FROM (SELECT s_suppkey, n_name, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return records.short_labels(s, "n_name", ["s_suppkey"]).select("s_suppkey", "short")


@query("first_complete_box", f"SELECT p_partkey, {r('CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE p_retailprice END', 'x')}, {r('CASE WHEN p_partkey % 3 <> 0 THEN p_partkey ELSE p_size END', 'y')} FROM part")
def first_complete_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from the first group of columns that is complete."""
    s = lambda c: F.col(c).cast("string")
    p = read(spark, sf_dir, "part").select("p_partkey", s("p_size").alias("a"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(s("p_partkey")).alias("b"), s("p_retailprice").alias("c"), s("p_size").alias("d"))
    box = records.first_complete(p, [("a", "b"), ("c", "d")], ("x", "y"))
    return tidy(p.select("p_partkey", box["x"].alias("x"), box["y"].alias("y")))


@query("strict_lookup", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return records.strict_lookup(n, read(spark, sf_dir, "region"), ["r_regionkey"]).select("n_nationkey", "r_name")


@query("gathered_scores", f"WITH {SQL_RES} SELECT a.sample_id, a.idx, {r('coalesce(b.tx, 0)', 'score')} FROM residue a LEFT JOIN residue b ON a.sample_id = b.sample_id AND b.idx = a.idx + 5 AND a.idx % 2 = 0")
def gathered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores through a place table; places out of range give 0."""
    rows = residues(spark, sf_dir)
    middle = rows.where("idx % 2 = 0").select("sample_id", "idx", (F.col("idx") + 5).alias("place"))
    return tidy(records.gathered(rows.select("sample_id", "idx"), middle, rows.select("sample_id", F.col("idx").alias("place"), F.col("tx").alias("score"))))


@query("ligand_choice", """WITH g AS (SELECT l_orderkey, l_returnflag, l_suppkey, count(*) AS n, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag <> 'N' THEN 2 END AS k FROM lineitem GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k, n DESC, l_returnflag DESC, l_suppkey DESC) AS p FROM g WHERE k IS NOT NULL)
 SELECT l_orderkey, l_returnflag, l_suppkey, n FROM w WHERE p = 1""")
def ligand_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ligand_choice(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_suppkey"], "l_returnflag", ["R"], ["N"])


@query("sequence_scores", "SELECT item_id AS key, (i - 1)::BIGINT AS idx, ((i + 4) * 2)::BIGINT AS score FROM (SELECT *, unnest(range(1, length(text) - 4)) AS i FROM benchmark WHERE length(text) >= 20) WHERE strpos(text, substr(text, 6)) = 6")
def sequence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each whole text at the places where what lies behind its first five letters stands in it."""
    b = read(spark, sf_dir, "benchmark").where("length(text) >= 20").select(F.col("item_id").alias("key"), F.col("text").alias("whole"), F.expr("substring(text, 6)").alias("part"), F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda i: i * 2).alias("scores"))
    return tidy(records.sequence_scores(b.where(F.instr("whole", F.col("part")) == 6)))
