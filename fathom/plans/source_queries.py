"""Queries over text, JSON and nested columns, set operations, and incremental reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import clean
from fathom.operators import intervals, regions
from fathom.registry import query
from fathom.sources import readers, sinks
from fathom.streaming import incremental

from .virtual import r, read, tidy

_ANNOTATION = '{"default_chain":"A","regions":{"barrel_core":[{"ranges":[[1,%d]]}],"plug":[{"ranges":[[9,5]],"residues":[12]},{"chain":"B","residues":[3]}],"tonb_box":[{"residue_ids":["A_5"]}]},"eval_regions":["plug","tonb_box"],"loss_weights":{"default":0.3,"barrel_core":0.1,"plug":2.0,"tonb_box":3.0}}'


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    return regions.parsed(keys.withColumn("annotation", F.format_string(_ANNOTATION.replace("%d", "%d"), F.col("key") % 4 + 1)))


_MEMBERS = """m AS (SELECT n_nationkey AS key, 'barrel_core' AS region, 'A_' || i AS residue_id FROM nation, range(1, 6) t(i) WHERE i <= n_nationkey % 4 + 1
 UNION ALL SELECT n_nationkey, 'plug', x FROM nation, (VALUES ('A_5'), ('A_6'), ('A_7'), ('A_8'), ('A_9'), ('A_12'), ('B_3')) t(x) UNION ALL SELECT n_nationkey, 'tonb_box', 'A_5' FROM nation)"""


@query("annotation_members", f"WITH {_MEMBERS} SELECT key, region, residue_id FROM m")
def annotation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.members(_annotations(spark, sf_dir), "key")


@query("annotation_features", f"""WITH {_MEMBERS}, p AS (SELECT n_nationkey AS key, 'A_' || i AS residue_id FROM nation, range(1, 13) t(i)), j AS (SELECT p.*, region, list_position(['barrel_core', 'plug', 'tonb_box'], region) AS o FROM p LEFT JOIN m USING (key, residue_id))
 SELECT key, residue_id, max_by(region, o) AS region, round(coalesce(max_by(CASE region WHEN 'barrel_core' THEN 0.1 WHEN 'plug' THEN 2.0 WHEN 'tonb_box' THEN 3.0 END, o), 0.3)::DOUBLE, 6) + 0.0 AS weight, bool_or(coalesce(region IN ('plug', 'tonb_box'), false)) AS is_eval FROM j GROUP BY ALL""")
def annotation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _annotations(spark, sf_dir)
    residues = a.select("key", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i")).select("key", F.concat(F.lit("A_"), F.col("i").cast("string")).alias("residue_id"))
    order = ["barrel_core", "plug", "tonb_box"]
    return tidy(regions.region_features(residues, regions.members(a, "key"), a, "key", order, order))


@query("range_overlap", """WITH f AS (SELECT p_partkey, p_size AS lo, p_size + p_partkey % 7 AS hi FROM part), g AS (SELECT * FROM (VALUES (1, 10, 100), (15, 30, 200), (35, 60, 300)) t(a, b, base))
 SELECT p_partkey, (greatest(lo, a) - a + base)::BIGINT AS first, (least(hi, b) - a + base)::BIGINT AS last FROM f JOIN g ON lo <= b AND hi >= a""")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature ranges cut to aligned stretches and shifted."""
    f = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 7).alias("hi"))
    g = spark.createDataFrame([(1, 10, 100), (15, 30, 200), (35, 60, 300)], "start int, end int, base int")
    rows = intervals.overlaps(f, g, 16).withColumnsRenamed({"start": "a", "end": "b"})
    return rows.select("p_partkey", (F.greatest("lo", "a") - F.col("a") + F.col("base")).cast("bigint").alias("first"), (F.least("hi", "b") - F.col("a") + F.col("base")).cast("bigint").alias("last"))


@query("donor_candidates", """WITH c AS (SELECT s.s_suppkey, n.n_nationkey, (s.s_nationkey % 5 = n.n_regionkey)::BIGINT AS same, (s.s_suppkey * 7 + n.n_nationkey * 3) % 100 AS identity FROM supplier s JOIN nation n ON s.s_nationkey <> n.n_nationkey),
 k AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY same DESC, identity DESC, s_suppkey) AS rank FROM c WHERE identity >= 30) SELECT n_nationkey, s_suppkey, same, identity, rank FROM k WHERE rank <= 3""")
def donor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best donors of each target that aren't its own; the targets are few, and that is checked."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    rows = intervals.with_few(s, n, F.col("s_nationkey") != F.col("n_nationkey")).select("s_suppkey", "n_nationkey", (F.col("s_nationkey") % 5 == F.col("n_regionkey")).cast("bigint").alias("same"), ((F.col("s_suppkey") * 7 + F.col("n_nationkey") * 3) % 100).alias("identity"))
    w = Window.partitionBy("n_nationkey").orderBy(F.desc("same"), F.desc("identity"), "s_suppkey")
    return rows.where("identity >= 30").withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3").select("n_nationkey", "s_suppkey", "same", "identity", "rank")


@query("anti_tiers", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1")
def anti_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(gold, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("partner_exists", "SELECT DISTINCT l_orderkey FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_returnflag = 'R')")
def partner_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a returned line of another supplier: by the least and greatest supplier of those lines."""
    li = read(spark, sf_dir, "lineitem")
    returned = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"))
    return li.join(returned, "l_orderkey").where("l_suppkey <> lo or l_suppkey <> hi").select("l_orderkey").distinct()


@query("left_with_reason", "SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'no_orders' ELSE 'included' END AS status, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_with_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = read(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n"])
    return rows.select("c_custkey", F.when(F.col("n") == 0, "no_orders").otherwise("included").alias("status"), "n")


@query("case_fallback_lookup", """SELECT c_custkey, coalesce(e.n_nationkey, l.n_nationkey)::BIGINT AS nation FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey) c
 LEFT JOIN nation e ON c.name = e.n_name LEFT JOIN nation l ON lower(c.name) = lower(l.n_name)""")
def case_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    c = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("name"))
    exact = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("a"))
    low = n.select(F.lower("n_name").alias("low"), F.col("n_nationkey").alias("b"))
    rows = c.join(exact, "name", "left").withColumn("low", F.lower("name")).join(low, "low", "left")
    return rows.select("c_custkey", F.coalesce("a", "b").cast("bigint").alias("nation"))


@query("ordered_union", "SELECT id, min(pos) AS pos FROM (SELECT s_nationkey AS id, s_suppkey AS pos FROM supplier UNION ALL SELECT c_nationkey, 1000000 + c_custkey FROM customer) GROUP BY id")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_suppkey").alias("pos"))
    b = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), (F.col("c_custkey") + 1000000).alias("pos"))
    return a.unionByName(b).groupBy("id").agg(F.min("pos").alias("pos"))


@query("id_set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def id_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(read(spark, sf_dir, "orders").select("o_custkey"))


@query("id_set_intersection", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def id_set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).intersect(read(spark, sf_dir, "orders").select("o_custkey"))


@query("matrix_cells", """WITH m AS (SELECT vec_id AS key, embedding FROM embeddings) SELECT key, i::BIGINT AS i, j::BIGINT AS j, round(embedding[i*8 + j + 1]::DOUBLE, 6) + 0.0 AS value FROM m, range(8) a(i), range(8) b(j)""")
def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 JSON matrices in the usual shapes, read back to cells."""
    e = read(spark, sf_dir, "embeddings").withColumn("rows", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double"))))
    body = F.to_json("rows")
    text = F.when(F.col("vec_id") % 3 == 0, body).when(F.col("vec_id") % 3 == 1, F.concat(F.lit('{"pae":'), body, F.lit("}"))).otherwise(F.concat(F.lit('[{"predicted_aligned_error":'), body, F.lit("}]")))
    return tidy(readers.matrix_cells(e.select(F.col("vec_id").alias("key"), text.alias("m")), "key", "m"))


@query("carried_sections", """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS value FROM documents),
 s AS (SELECT *, last_value(CASE WHEN regexp_matches(value, '^(\\w+)\\.$') THEN regexp_extract(value, '^(\\w+)\\.$', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l)
 SELECT doc_id, line_no::BIGINT AS line_no, section, regexp_extract(value, '^(The|Die|La) ', 1) AS value FROM s WHERE regexp_matches(value, '^(The|Die|La) ')""")
def carried_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-word lines carried down to the lines that follow."""
    rows = readers.numbered(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return readers.carried(rows, "doc_id", r"^([A-Za-z0-9_]+)\.$", r"^(The|Die|La) ").withColumn("line_no", F.col("line_no").cast("bigint"))


@query("props_fields", "SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS field FROM events, (SELECT unnest(json_keys(props)) AS k, event_id AS e FROM events) WHERE e = event_id")
def props_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the JSON cells, one a row."""
    e = read(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return e.select("event_id", F.explode("m").alias("field", "value"))


@query("turns_as_arrays", "SELECT conv_id, count(*) AS n_turns, array_to_string(list(role ORDER BY turn, role, text), '>') AS roles, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1")
def turns_as_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("conv_id", F.size("t").cast("bigint").alias("n_turns"), F.array_join("t.role", ">").alias("roles"), F.aggregate("t.text", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("n_chars"))


@query("daily_windows", f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, {r('avg(value)', 'mean', 9)} FROM events GROUP BY ALL")
def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(incremental.windowed_counts(read(spark, sf_dir, "events"), "ts", "event_type"), 9)


@query("incremental_events", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1")
def incremental_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events merged by id from a stream of files."""
    folder = f"{incremental.shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    rows = incremental.merge_new(spark, sf_dir, read(spark, sf_dir, "events").schema, ["event_id"], f"{folder}/rows", f"{folder}/state", "events.parquet")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("atom_lines", "SELECT p_partkey, format('ATOM  {:5d}  {:<3s} {:3s} {:1s}{:4d}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}', p_partkey, 'CA', 'ALA', 'A', p_size, p_retailprice / 100, p_size::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE) AS line FROM part")
def atom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    line = sinks.atom_line(F.col("p_partkey"), F.lit("CA"), F.lit("ALA"), F.lit("A"), F.col("p_size"), F.col("p_retailprice") / 100, F.col("p_size").cast("double"), F.lit(0.5))
    return p.select("p_partkey", line.alias("line"))


@query("parsed_atoms", "SELECT p_partkey, p_size::BIGINT AS resseq, round(round(p_retailprice / 100, 3), 6) + 0.0 AS x FROM part")
def parsed_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines above read back by their columns."""
    rows = atom_lines(spark, sf_dir).withColumnRenamed("line", "value").withColumn("line_no", F.lit(1))
    return tidy(readers.atoms(rows, "p_partkey").select("p_partkey", "resseq", "x"))


@query("place_ids", "SELECT c_custkey, 'A_' || c_mktsegment AS chain, c_custkey - 700 AS number, chr((65 + c_custkey % 3)::INT) AS code FROM customer")
def place_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("A_"), "c_mktsegment", F.lit("_"), (F.col("c_custkey") - 700).cast("string"), F.char(65 + F.col("c_custkey") % 3))
    chain, number, code = clean.place_id(text)
    return read(spark, sf_dir, "customer").select("c_custkey", chain.alias("chain"), number.cast("bigint").alias("number"), code.alias("code"))


@query("listed_cells", "SELECT n_nationkey, unnest(['x' || n_nationkey, 'y']) AS item FROM nation")
def listed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.lit(" x"), F.col("n_nationkey").cast("string"), F.lit(" ;y, ;"))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.explode(clean.listed(cell)).alias("item"))


@query("pose_zip", """WITH a AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey) AS p, l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey) AS p, l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'A')
 SELECT coalesce(a.k, b.k) AS target, coalesce(a.p, b.p) AS pos, a.v AS first, b.v AS second FROM a FULL JOIN b ON a.k = b.k AND a.p = b.p""")
def pose_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists zipped by position up to the longer one."""
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey", "l_suppkey")
    side = lambda f, n: read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("target"), F.row_number().over(w).cast("bigint").alias("pos"), F.col("l_extendedprice").alias(n))
    return side("R", "first").join(side("A", "second"), ["target", "pos"], "full")
