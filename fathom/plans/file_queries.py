"""Queries that write files from the tables and read them back, and lookups, splits and chains around them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import baselines, entities, features, geometry, manifest, records, splits
from fathom.registry import query
from fathom.sources import formats, readers, sinks
from fathom.streaming.incremental import shared_folder

from .virtual import SQL_BRIDGE, SQL_RES, SQL_RUNS, bridge, predicted, r, read, residues, runs, tidy


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("delimited_table", "SELECT c_custkey::VARCHAR AS id, c_name AS name, 'a, \"' || c_mktsegment || '\"' AS note, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal::VARCHAR END AS phone FROM customer")
def delimited_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with commas, quotes and blanks through a delimited file in a fixed order of columns."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit('a, "'), "c_mktsegment", F.lit('"')).alias("note"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal").cast("string")).alias("phone"), F.col("c_name").alias("name"))
    path = _folder(spark, "csv")
    sinks.in_order(rows, ["id", "name", "note", "phone"]).write.csv(path, header=True, escape='"')
    return readers.table(spark, path, required=["id", "name"]).select("id", "name", "note", "phone")


@query("delimited_union", "SELECT s_suppkey::VARCHAR AS id, s_name AS name, NULL::VARCHAR AS size FROM supplier UNION ALL SELECT p_partkey::VARCHAR, NULL, p_size::VARCHAR FROM part")
def delimited_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of other columns and one that isn't there."""
    path = _folder(spark, "csv")
    sinks.write_csv(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), f"{path}/a.csv")
    sinks.write_csv(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), f"{path}/b.csv")
    return readers.table(spark, [f"{path}/a.csv", f"{path}/b.csv", f"{path}/none.csv"], missing_ok=True).select("id", "name", "size")


@query("listed_names", "SELECT 'k' || p_partkey AS id FROM part WHERE p_partkey % 4 <> 0")
def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of listed files: every fourth line is a comment or blank."""
    k = F.col("p_partkey")
    path = _folder(spark, "list")
    line = F.when(k % 8 == 0, "  ").when(k % 4 == 0, F.concat(F.lit("# k"), k.cast("string"))).otherwise(F.concat(F.lit("a/b.c/k"), k.cast("string"), F.lit(".pt  # x")))
    read(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return readers.listed_ids(readers.lines(spark, path))


@query("parsed_props", "SELECT event_id, props IS NOT NULL AS parsed, json_extract_string(props, '$.k') AS k FROM events")
def parsed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.json_objects(read(spark, sf_dir, "events"), "props", "k string")
    return rows.select("event_id", F.col("object").isNotNull().alias("parsed"), F.col("object.k").alias("k"))


@query("files_by_key", f"SELECT o_orderstatus, count(*) AS n, {r('sum(o_totalprice)', 'total', 2)} FROM orders GROUP BY 1")
def files_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each status, read back as one table."""
    path = _folder(spark, "keys")
    sinks.write_by_key(read(spark, sf_dir, "orders"), path, "o_orderstatus")
    rows = spark.read.parquet(path)
    return tidy(rows.groupBy(F.col("o_orderstatus").cast("string").alias("o_orderstatus")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("sample_files", "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids FROM embeddings")
def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sample files below nested folders."""
    path = _folder(spark, "samples")
    e = read(spark, sf_dir, "embeddings")
    e.where("vec_id % 2 = 0").write.parquet(f"{path}/a")
    e.where("vec_id % 2 = 1").write.parquet(f"{path}/b/c")
    return readers.samples(spark, path).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"))


@query("written_json", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN {r('o_totalprice', 'x').rpartition(' AS ')[0]} END AS price FROM orders")
def written_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that aren't finite are null in JSON."""
    path = _folder(spark, "json")
    price = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice").cast("double")).when(F.col("o_orderkey") % 2 == 0, float("nan")).otherwise(float("inf"))
    sinks.write_json(read(spark, sf_dir, "orders").select("o_orderkey", price.alias("price")), path)
    return tidy(spark.read.schema("o_orderkey bigint, price double").json(path))


@query("structure_models", f"WITH {SQL_RES} SELECT sample_id AS model, idx::BIGINT AS serial, round(tx, 3) + 0.0 AS x, round(tz, 3) + 0.0 AS z FROM residue WHERE idx % 3 = 1")
def structure_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of many models, each in its own lines, read for one chain."""
    rows = residues(spark, sf_dir, "").withColumn("chain", F.element_at(F.array(*map(F.lit, "ABC")), (F.col("idx") % 3 + 1).cast("int")))
    line = sinks.atom_line(F.col("idx").cast("int"), F.lit("CA"), F.lit("ALA"), F.col("chain"), F.col("idx").cast("int"), *(F.round(c, 3) for c in "xyz"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda a: a["line"]), "\n")
    models = rows.groupBy("sample_id").agg(body.alias("body"))
    path = _folder(spark, "models")
    models.select(F.concat(F.lit("MODEL     "), F.col("sample_id").cast("string"), F.lit("\n"), "body", F.lit("\nENDMDL")).alias("value")).write.text(path)
    found = formats.register(spark).read.format("structures").option("blockBytes", 1 << 16).load(f"{path}/*.txt")
    return tidy(found.where("chain = 'B'").select(F.col("model").cast("bigint").alias("model"), F.col("serial").cast("bigint").alias("serial"), "x", "z"), 3)


@query("structure_chains", f"WITH {SQL_RES} SELECT sample_id, 'A_' || idx AS residue_id, row_number() OVER (PARTITION BY sample_id ORDER BY idx) - 1 AS idx, 18::BIGINT AS n FROM residue WHERE idx < 18")
def structure_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues of chains that are long enough; chain B has three."""
    rows = residues(spark, sf_dir, "")
    chain = F.when(F.col("idx") < 18, "A").otherwise("B")
    line = sinks.atom_line(F.col("idx").cast("int"), F.lit("CA"), F.lit("GLY"), chain, F.col("idx").cast("int"), *(F.round(c, 3) for c in "xyz"))
    atoms = readers.atoms(rows.select("sample_id", F.col("idx").alias("line_no"), line.alias("value")), "sample_id")
    return readers.chains(atoms, "sample_id").select("sample_id", "residue_id", F.col("idx").cast("bigint").alias("idx"), "n")


@query("kept_bonds", "SELECT o_orderstatus AS file, o_orderkey AS src, d AS dst FROM (SELECT *, unnest([o_orderkey + 1, o_orderkey + 2]) AS d FROM orders) a WHERE o_totalprice > 90000 AND EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = a.o_orderstatus AND b.o_orderkey = d AND b.o_totalprice > 90000)")
def kept_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of atoms to the two behind, both ends kept."""
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "file")
    n = F.col("o_orderkey")
    bonds = o.select("file", n.alias("src"), F.array(n + 1, n + 2).alias("dsts"))
    return records.bonds_of(bonds, o.where("o_totalprice > 90000").select("file", n.alias("serial")), ["file"])


@query("result_scores", f"SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, {r('-((o_orderkey % 97) / 10.0)', 'score')} FROM orders WHERE o_orderkey % 3 <> 1")
def result_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of result remarks among other lines."""
    k = F.col("o_orderkey")
    text = F.when(k % 3 != 1, F.concat(F.lit("REMARK VINA RESULT:   "), F.format_string("%.1f", -(k % 97) / 10.0), F.lit("  0.0  0.0"))).otherwise("REMARK other -1.0")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), k.alias("line_no"), text.alias("value"))
    return tidy(readers.docking_scores(rows, "key").select("key", "position", "score"))


@query("tool_hits", """WITH h AS (SELECT l_suppkey % 7 AS file, 'q' || l_partkey AS query, 't' || l_orderkey AS target, l_orderkey * 8 + l_linenumber AS line_no, CASE WHEN l_linenumber = 2 THEN l_tax ELSE l_discount END::DOUBLE AS score FROM lineitem WHERE l_linenumber <> 3)
 SELECT file, query, target, round(score, 6) + 0.0 AS score, row_number() OVER (PARTITION BY file, query ORDER BY score DESC, line_no) AS rank FROM h""")
def tool_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a tool's tables: the first score that is finite counts, comments and short lines don't."""
    li = read(spark, sf_dir, "lineitem")
    first = F.when(F.col("l_linenumber") == 2, "inf").otherwise(F.col("l_discount").cast("string"))
    text = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("# q"), F.col("l_partkey").cast("string"), F.lit("\tx\t1\t1"))).otherwise(F.concat_ws("\t", F.concat(F.lit("q"), "l_partkey"), F.concat(F.lit("t"), "l_orderkey"), first, F.col("l_tax").cast("string")))
    rows = li.select((F.col("l_suppkey") % 7).alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), text.alias("value"))
    return tidy(readers.hits(rows, "file", 4, [2, 3]).select("file", "query", "target", "score", "rank"))


@query("first_existing", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a' || p_partkey ELSE 'b' || p_partkey END AS path FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")
def first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two candidate paths that a listing has."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a"), "p_partkey").alias("first"), F.concat(F.lit("b"), "p_partkey").alias("second"))
    listing = p.where("p_partkey % 3 = 0").select(F.col("first").alias("path")).unionByName(p.where("p_partkey % 2 = 0").select(F.col("second").alias("path")))
    return readers.first_existing(p, "p_partkey", ["first", "second"], listing)


@query("inferred_columns", f"WITH {SQL_RUNS} SELECT target, method AS structure, {r('avg(value)', 'score', 9)} FROM runs GROUP BY ALL")
def inferred_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures told from the names of score columns, then stood on end."""
    wide = runs(spark, sf_dir).groupBy("target").pivot("method").agg(F.avg("value"))
    wide = wide.select("target", *(F.col(f"`{c}`").alias(f"score_{c}") for c in wide.columns if c != "target"), F.lit(0.0).alias("other"))
    found = records.infer_columns(wide.columns, ["score_"])
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("structure"), F.col(f"`{c}`").alias("score")) for n, c in found.items())))
    return tidy(wide.select("target", cells.alias("c")).select("target", "c.*").where("score is not null"), 9)


@query("range_slices", """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('5:' || o_orderkey), o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)
 SELECT o_orderkey, CASE WHEN p < floor(n * 0.6::DOUBLE) THEN 'train' ELSE 'val' END AS part FROM k WHERE p < floor(n * 0.8::DOUBLE)""")
def range_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of a seeded order; the last fifth is in none."""
    return features.range_slices(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", {"train": (0.0, 0.6), "val": (0.6, 0.8)}, 5)


@query("content_keys", "SELECT p_partkey, substr(sha256('{\"brand\": \"' || p_brand || '\", \"size\": ' || p_size || '}'), 1, 12) AS cache_key FROM part")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of caches by their parameters."""
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", features.cache_keys({"size": F.col("p_size").cast("string"), "brand": F.concat(F.lit('"'), "p_brand", F.lit('"'))}).alias("cache_key"))


@query("feature_ranges", "WITH f AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'TonB Plug ' || l_linenumber ELSE 'other' END AS name, l_quantity::INT AS s, l_quantity::INT + l_linenumber - 2 AS e FROM lineitem) SELECT l_orderkey, s AS lo, e AS hi FROM f WHERE contains(lower(name), 'plug') AND s <= e")
def feature_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of the features whose name has a mark; ends before starts are left out."""
    q = F.col("l_quantity").cast("int")
    feature = F.struct(F.when(F.col("l_returnflag") == "A", F.concat(F.lit("TonB Plug "), "l_linenumber")).otherwise("other").alias("name"), q.alias("start"), (q + F.col("l_linenumber").cast("int") - 2).alias("end"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(feature).alias("features"))
    return rows.select("l_orderkey", F.explode(manifest.feature_ranges("features", ["plug"])).alias("x")).select("l_orderkey", F.col("x")[0].alias("lo"), F.col("x")[1].alias("hi"))


@query("ordered_ids", "SELECT o_custkey AS file, o_orderpriority AS residue_id, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) - 1 AS idx FROM orders GROUP BY 1, 2")
def ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("residue_id"), F.col("o_orderkey").alias("line_no"))
    return records.ordered_ids(rows, ["file"]).select("file", "residue_id", F.col("idx").cast("bigint").alias("idx"))


@query("averaged_transfers", f"""WITH {SQL_RES}, c AS (SELECT sample_id // 4 AS sample_id, idx, CASE WHEN sample_id % 4 = 0 THEN 0 ELSE tx END AS x, CASE WHEN sample_id % 4 = 0 THEN 0 ELSE ty END AS y, CASE WHEN sample_id % 4 = 0 THEN 0 ELSE tz END AS z FROM residue)
 SELECT sample_id, idx, {', '.join(r(f'sum({c}) / greatest(1, count(*) FILTER (x*x + y*y + z*z > 0))', 'p' + c) for c in 'xyz')} FROM c GROUP BY ALL""")
def averaged_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of four candidates' vectors, of which one is zero."""
    rows = residues(spark, sf_dir).select(F.floor(F.col("sample_id") / 4).alias("sample_id"), "idx", *(F.when(F.col("sample_id") % 4 == 0, 0.0).otherwise(F.col(f"t{c}")).alias(f"p{c}") for c in "xyz"))
    return tidy(geometry.averaged_transfers(rows))


@query("pair_samples", f"""WITH {SQL_RES} SELECT a.sample_id, 'r' || a.idx AS residue_id, {r('a.tx', 'dx')}, CASE WHEN a.idx % 2 = 0 THEN a.idx END AS region_id, a.family AS family_id
 FROM residue a WHERE a.sample_id % 5 <> 0 AND a.sample_id % 7 <> 0""")
def pair_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training residues: targets that are ok, with features where there are some, of samples in a manifest."""
    rows = residues(spark, sf_dir).withColumn("residue_id", F.concat(F.lit("r"), "idx"))
    targets = rows.select("sample_id", "residue_id", F.when(F.col("sample_id") % 5 == 0, "no_fit").otherwise("ok").alias("status"), F.col("tx").alias("dx"))
    found = rows.where("idx % 2 = 0").select("sample_id", "residue_id", F.col("idx").alias("region_id"))
    samples = rows.where("sample_id % 7 <> 0").select("sample_id", F.col("family").alias("family_id")).distinct()
    return tidy(geometry.pair_samples(targets, found, samples).select("sample_id", "residue_id", "dx", "region_id", "family_id"))


@query("selected_chain", """WITH c AS (SELECT o_custkey AS sample_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey::VARCHAR AS chain, o_orderpriority AS sequence FROM orders)
 SELECT sample_id, pos, chain, sequence FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN sample_id % 3 = 0 THEN pos - 1 ELSE -length(sequence) END, pos) AS k FROM c) WHERE k = 1""")
def selected_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain that is asked for (in every third sample its first), else the longest, of equal ones the first."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.row_number().over(w).cast("bigint").alias("pos"), F.col("o_orderkey").cast("string").alias("chain"), F.col("o_orderpriority").alias("sequence"), F.first(F.col("o_orderkey").cast("string")).over(w).alias("head"))
    rows = rows.withColumn("wish", F.when(F.col("sample_id") % 3 == 0, F.col("head"))).drop("head")
    return geometry.select_chain(rows, "wish").select("sample_id", "pos", "chain", "sequence")


@query("run_log", "SELECT o_orderstatus AS run, count(*) AS n, CASE WHEN o_orderstatus = 'O' THEN max(o_orderkey) END AS last FROM orders GROUP BY 1")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose later rows have a column more."""
    path = _folder(spark, "log")
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("run")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    manifest.append_log(o.where("run <> 'O'").drop("last"), path)
    manifest.append_log(o.where("run = 'O'"), path)
    return manifest.read_log(spark, path).select("run", "n", "last")


@query("matched_entities", """WITH e AS (SELECT ps AS entry, ln AS entity, pos, acc, ch FROM (SELECT l_suppkey AS ps, l_orderkey * 8 + l_linenumber AS ln, l_orderkey * 8 + l_linenumber AS pos, l_partkey AS acc, l_returnflag AS ch FROM lineitem))
 SELECT entry, acc AS accession, ch AS chain, min_by(entity, pos) AS entity FROM e WHERE ch <> 'N' GROUP BY ALL""")
def matched_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entity that lists a row's accession and chain."""
    li = read(spark, sf_dir, "lineitem")
    own = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("entity")
    found = li.select(F.col("l_suppkey").alias("entry"), own, own.alias("pos"), F.array("l_partkey").alias("accessions"), F.array("l_returnflag").alias("chains"))
    wanted = li.where("l_returnflag <> 'N'").select(F.col("l_suppkey").alias("entry"), F.col("l_partkey").alias("accession"), F.col("l_returnflag").alias("chain")).distinct()
    return records.matched_entities(wanted, found)


@query("chosen_splits", "WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS split FROM customer) SELECT c_custkey, split, CASE WHEN split = 'test' THEN 'target' ELSE 'donor' END AS role FROM s")
def chosen_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, "test").when(k == 1, "train").otherwise("val").alias("split"))
    targets, donors = splits.chosen_splits(rows, "test")
    return targets.withColumn("role", F.lit("target")).unionByName(donors.withColumn("role", F.lit("donor")))


@query("rows_with_score", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0")
def rows_with_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose cell isn't blank."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k, F.when(k % 8 == 0, "  ").when(k % 4 != 0, k.cast("string")).alias("rmsd"))
    return records.present(rows, "rmsd").select("o_orderkey")


@query("localisation_rows", f"WITH {SQL_RUNS} SELECT method, target, seed::BIGINT AS seed, {r('value', 'value')}, CASE method WHEN 'view' THEN 1 ELSE 2 END::BIGINT AS method_order, (target % 2 + 1)::BIGINT AS region_order FROM runs WHERE method IN ('view', 'click') AND target % 3 < 2 AND seed IN (1, 2)")
def localisation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the methods, regions and seeds asked for, with their places in those lists."""
    rows = runs(spark, sf_dir).where("target % 3 < 2").withColumn("region", F.when(F.col("target") % 2 == 0, "plug").otherwise("loop"))
    return tidy(entities.localisation(rows, ["view", "click"], ["plug", "loop"], [1, 2]).drop("region"))


_DOT, _PP = "(px*tx + py*ty + pz*tz)", "(px*px + py*py + pz*pz)"


@query("calibrated_scales", f"WITH {SQL_BRIDGE} SELECT region, {r(f'CASE WHEN region = {chr(39)}plug{chr(39)} THEN 0.5 ELSE greatest(0, least(2, sum({_DOT}) / nullif(sum({_PP}), 0))) END', 'scale')} FROM br WHERE region IN ('plug', 'eval', 'tonb_box') GROUP BY region")
def calibrated_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales of three regions, one of them given, put on their rows."""
    rows = bridge(predicted(spark, sf_dir))
    scales = baselines.calibrated_scales(rows, ["plug", "eval", "tonb_box"], {"plug": 0.5})
    known = F.create_map(*(x for k, v in scales.items() for x in (F.lit(k), F.lit(v))))
    return tidy(rows.groupBy("region").agg(F.max(known[F.col("region")]).alias("scale")).where("scale is not null"))
