"""The driver's tables in the shapes that the operators take, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.clean import rounded

PLACES = 21
REGIONS = ("barrel_core", "plug", "tonb_box", "extracellular_loop")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def primary(i: Column) -> Column:
    return F.when(i < 8, "barrel_core").when(i < 15, "plug").when(i < 18, "tonb_box").otherwise("extracellular_loop")


def residues(spark: SparkSession, sf_dir: str, x: str = "t", shift: int = 0) -> DataFrame:
    """sample_id, idx, family, state and three doubles: 21 points of each vector."""
    e = read(spark, sf_dir, "embeddings").select((F.col("vec_id") + shift).alias("sample_id"), F.col("label").alias("family"), "embedding")
    rows = e.select("sample_id", "family", "embedding", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("idx"))
    at = lambda k: F.get("embedding", F.col("idx") * 3 + k).cast("double")
    return rows.select("sample_id", F.col("idx").cast("bigint").alias("idx"), "family", (F.col("sample_id") % 3).alias("state"), *(at(k).alias(f"{x}{c}") for k, c in enumerate("xyz")))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, family, embedding, and the vector of the sample ten before; samples that have one."""
    e = read(spark, sf_dir, "embeddings")
    earlier = e.select((F.col("vec_id") + 10).alias("sample_id"), F.col("embedding").alias("earlier"))
    return e.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("family"), "embedding").join(earlier, "sample_id")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """residues with the vector of the sample ten before as prediction; samples that have one. Vectors meet whole, before they are cut into points."""
    return points(vector_pairs(spark, sf_dir))


def points(pairs: DataFrame) -> DataFrame:
    """21 points of each pair of vectors."""
    rows = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("idx"))
    at = lambda c, k: F.get(c, F.col("idx") * 3 + k).cast("double")
    return rows.select("sample_id", F.col("idx").cast("bigint").alias("idx"), "family", (F.col("sample_id") % 3).alias("state"), *(at(c, k).alias(f"{p}{x}") for p, c in (("t", "embedding"), ("p", "earlier")) for k, x in enumerate("xyz")))


def bridge(rows: DataFrame) -> DataFrame:
    """Rows once for their region, and once more for eval."""
    main = primary(F.col("idx"))
    names = F.when(main == "barrel_core", F.array(main)).otherwise(F.array(main, F.lit("eval")))
    return rows.select("*", F.explode(names).alias("region"))


SQL_REGION = "CASE WHEN idx < 8 THEN 'barrel_core' WHEN idx < 15 THEN 'plug' WHEN idx < 18 THEN 'tonb_box' ELSE 'extracellular_loop' END"
SQL_RES = """residue AS (SELECT vec_id AS sample_id, i AS idx, label AS family, vec_id % 3 AS state, embedding[3*i+1]::DOUBLE AS tx,
  embedding[3*i+2]::DOUBLE AS ty, embedding[3*i+3]::DOUBLE AS tz FROM embeddings, range(21) r(i))"""
SQL_ROWS = SQL_RES + """, pred AS (SELECT sample_id + 10 AS sample_id, idx, tx AS px, ty AS py, tz AS pz FROM residue),
both_rows AS (SELECT * FROM residue JOIN pred USING (sample_id, idx))"""
SQL_BRIDGE = SQL_ROWS + f""", br AS (SELECT *, {SQL_REGION} AS region FROM both_rows UNION ALL SELECT *, 'eval' AS region FROM both_rows WHERE idx >= 8)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, structure, score, rmsd, valid of order lines, and what breaks ties."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("target"), F.col("l_returnflag").alias("structure"), (-F.col("l_extendedprice")).alias("score"), (F.col("l_quantity") / 10).alias("rmsd"), (F.col("l_linestatus") == "F").alias("valid"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate")


TIES = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate")
SQL_POSES = f"""poses AS (SELECT l_orderkey AS target, l_returnflag AS structure, -l_extendedprice AS score, l_quantity / 10 AS rmsd, l_linestatus = 'F' AS valid,
  {', '.join(TIES)} FROM lineitem),
rk AS (SELECT *, row_number() OVER (PARTITION BY target, structure ORDER BY score ASC NULLS LAST, {', '.join(TIES)}) AS position FROM poses)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, y, score: labelled documents, scored by a cut of their length."""
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("quality").alias("y"), F.col("doc_id"), (F.floor(F.col("n_chars") / 50) / 10).cast("double").alias("score"))


SQL_SCORED = "scored AS (SELECT lang, quality AS y, doc_id, (floor(n_chars / 50.0) / 10)::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, target, seed, value: means of events by type, user and day."""
    e = read(spark, sf_dir, "events").withColumn("seed", F.dayofmonth("ts") % 5)
    return e.groupBy(F.col("event_type").alias("method"), F.col("user_id").alias("target"), "seed").agg(F.avg("value").alias("value"))


SQL_RUNS = "runs AS (SELECT event_type AS method, user_id AS target, day(ts) % 5 AS seed, avg(value) AS value FROM events GROUP BY ALL)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of strings with blanks."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    blank = lambda k, x: F.when(F.col("c_custkey") % k == 0, "  ").otherwise(x)
    return rows.select(F.col("c_custkey").alias("pair_id"), F.col("n_name").alias("accession"), F.col("r_name").alias("family"), blank(7, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("state_label"), F.when(F.col("c_custkey") % 11 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("resolution"), F.col("c_acctbal").alias("number"))


SQL_MANIFEST = """manifest AS (SELECT c_custkey AS pair_id, n_name AS accession, r_name AS family,
  CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE ' ' || c_mktsegment || ' ' END AS state_label, c_custkey % 11 = 0 AS bad, c_acctbal AS number
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as bigint: what two engines agree on."""
    kinds = {"double": lambda c: rounded(c, digits), "int": lambda c: F.col(c).cast("bigint"), "decimal(20,0)": lambda c: F.col(c).cast("bigint")}
    return df.select(*((kinds[t](c).alias(c) if t in kinds else F.col(c)) for c, t in df.dtypes))


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(({expression})::DOUBLE, {digits}) + 0.0 AS {name}"
