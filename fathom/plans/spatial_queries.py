"""Queries over points: neighbours, chains, frames, fits, alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import geometry, spatial
from fathom.registry import query

from .virtual import SQL_RES, predicted, r, read, residues, tidy


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residues(spark, sf_dir, "").select("sample_id", "idx", "x", "y", "z")


_PTS = SQL_RES + ", pt AS (SELECT sample_id, idx, tx AS x, ty AS y, tz AS z FROM residue)"
_D = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"
_PAIRS = f"{_PTS}, pr AS (SELECT a.sample_id, a.idx AS src, b.idx AS dst, {_D} AS dist FROM pt a JOIN pt b ON a.sample_id = b.sample_id AND a.idx <> b.idx)"


@query("knn_edges", f"WITH {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, src ORDER BY dist, dst) AS rank FROM pr) SELECT sample_id, src, dst, rank, {r('dist', 'dist')} FROM k WHERE rank <= 3")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(spatial.nearest(points(spark, sf_dir), 3))


@query("contact_pairs", f"WITH {_PAIRS} SELECT sample_id, src, dst, {r('dist', 'dist')} FROM pr WHERE dist > 1e-9 AND dist <= 0.15")
def contact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(spatial.contacts(points(spark, sf_dir), 0.15))


@query("coordination_numbers", f"WITH {_PAIRS} SELECT p.sample_id, p.idx, count(pr.dst) AS cn FROM pt p LEFT JOIN pr ON pr.sample_id = p.sample_id AND pr.src = p.idx AND dist > 1e-9 AND dist <= 0.15 GROUP BY ALL")
def coordination_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.coordination(points(spark, sf_dir), 0.15)


@query("residue_depth", f"WITH {_PTS} SELECT a.sample_id, a.idx, {r(f'min({_D})', 'depth')} FROM pt a JOIN pt b ON a.sample_id = b.sample_id AND b.x > 0.1 GROUP BY ALL")
def residue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return tidy(spatial.depth(p, p.where("x > 0.1")))


_STEP = ", ".join(r(f"coalesce(d{n}{c} / nullif(sqrt(d{n}x*d{n}x + d{n}y*d{n}y + d{n}z*d{n}z), 0), 0)", f"{m}_{c}") for n, m in (("p", "prev"), ("n", "next"), ("m", "mid")) for c in "xyz")
_CHAIN = f"{_PTS}, s AS (SELECT *, " + ", ".join(f"{c} - lag({c}) OVER w AS dp{c}, lead({c}) OVER w - {c} AS dn{c}, lead({c}) OVER w - lag({c}) OVER w AS dm{c}" for c in "xyz") + " FROM pt WINDOW w AS (PARTITION BY sample_id ORDER BY idx))"


@query("chain_steps", f"WITH {_CHAIN} SELECT sample_id, idx, {_STEP} FROM s")
def chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(spatial.chain_steps(points(spark, sf_dir)))


@query("half_sphere", f"""WITH {_PTS}, s AS (SELECT *, {', '.join(f'coalesce(lead({c}) OVER w, {c}) - coalesce(lag({c}) OVER w, {c}) AS a{c}' for c in 'xyz')} FROM pt WINDOW w AS (PARTITION BY sample_id ORDER BY idx)),
 e AS (SELECT a.sample_id, a.idx, (b.x-a.x)*a.ax + (b.y-a.y)*a.ay + (b.z-a.z)*a.az AS side FROM s a JOIN pt b ON a.sample_id = b.sample_id AND a.idx <> b.idx AND {_D} <= 0.2)
 SELECT pt.sample_id, pt.idx, count(*) FILTER (side >= 0) AS up, count(*) FILTER (side < 0) AS down FROM pt LEFT JOIN e USING (sample_id, idx) GROUP BY ALL""")
def half_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.half_sphere(points(spark, sf_dir), 0.2)


@query("message_means", f"WITH {_PAIRS}, e AS (SELECT * FROM pr WHERE dist <= 0.15 AND dist > 1e-9), g AS (SELECT e.sample_id, e.dst AS idx, avg(p.x) AS m FROM e JOIN pt p ON p.sample_id = e.sample_id AND p.idx = e.src GROUP BY ALL) SELECT p.sample_id, p.idx, {r('coalesce(m, 0)', 'message')} FROM pt p LEFT JOIN g USING (sample_id, idx)")
def message_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return tidy(spatial.messages(spatial.contacts(p, 0.15), p, "x"))


@query("edge_features", f"""WITH {_PAIRS} SELECT sample_id, src, dst, (abs(dst-src) >= 1)::BIGINT + (abs(dst-src) >= 2)::BIGINT + (abs(dst-src) >= 4)::BIGINT + (abs(dst-src) >= 8)::BIGINT + (abs(dst-src) >= 16)::BIGINT AS bucket, {r('exp(-pow((dist - 20.0/15) / (20.0/15), 2))', 'rbf1')} FROM pr WHERE dist <= 0.15 AND dist > 1e-9""")
def edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spatial.contacts(points(spark, sf_dir), 0.15)
    return tidy(e.select("sample_id", "src", "dst", spatial.separation_bucket("src", "dst").cast("bigint").alias("bucket"), spatial.radial_basis("dist")[1].alias("rbf1")))


@query("submatrix", f"""WITH {_PAIRS}, m AS (SELECT sample_id, src AS i, dst AS j, dist AS value FROM pr WHERE dist <= 0.2 AND dist > 1e-9), w AS (SELECT sample_id, idx AS place, idx // 5 AS pos FROM pt WHERE idx % 5 = 0)
 SELECT a.sample_id, a.pos AS i, b.pos AS j, {r('coalesce(value, 0)', 'value')} FROM w a JOIN w b ON a.sample_id = b.sample_id LEFT JOIN m ON m.sample_id = a.sample_id AND m.i = a.place AND m.j = b.place""")
def submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    m = spatial.contacts(p, 0.2).select("sample_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("dist").alias("value"))
    w = p.where("idx % 5 = 0").select("sample_id", F.col("idx").alias("place"), F.floor(F.col("idx") / 5).cast("bigint").alias("pos"))
    return tidy(spatial.submatrix(m, w))


@query("centred_points", f"WITH {_PTS} SELECT sample_id, idx, {', '.join(r(f'{c} - avg({c}) OVER (PARTITION BY sample_id)', c) for c in 'xyz')} FROM pt")
def centred_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id")
    return tidy(points(spark, sf_dir).select("sample_id", "idx", *((F.col(c) - F.avg(c).over(w)).alias(c) for c in "xyz")))


@query("point_moments", f"WITH {_PTS} SELECT sample_id, count(*) AS n, {', '.join(r(f'avg({c})', 'c' + c) for c in 'xyz')}, {', '.join(r(f'covar_pop({a}, {b})', f'v{a}{b}') for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM pt GROUP BY sample_id")
def point_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(geometry.moments(points(spark, sf_dir)))


@query("principal_frames")
def principal_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(geometry.frames(points(spark, sf_dir)))


@query("aligned_displacements")
def aligned_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rigid fits of each sample onto the one ten before, by its core."""
    rows = predicted(spark, sf_dir).select("sample_id", "idx", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), F.col("tx").alias("u"), F.col("ty").alias("v"), F.col("tz").alias("w"), (F.col("idx") < 8).alias("core"))
    return tidy(geometry.aligned(rows, "core"))


@query("network_mobility")
def network_mobility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(geometry.mobility(points(spark, sf_dir), 0.5), 4)


@query("benchmark_alignments")
def benchmark_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched places of neighbouring items' whole texts."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id").withColumnRenamed("item_id", "key")
    return geometry.alignment_pairs(pairs)


@query("gapped_pairs", """WITH s AS (SELECT item_id AS key, replace(substr(text, 1, length(text) - 1), ' ', '-') AS a, replace(substr(text, 2), ' ', '-') AS b, length(text) AS n FROM benchmark WHERE length(text) >= 2),
 c AS (SELECT key, i, substr(a, i, 1) AS ca, substr(b, i, 1) AS cb FROM (SELECT *, unnest(range(1, n)) AS i FROM s)), n AS (SELECT *, sum((ca <> '-')::INT) OVER w - 1 AS a_idx, sum((cb <> '-')::INT) OVER w - 1 AS b_idx FROM c WINDOW w AS (PARTITION BY key ORDER BY i))
 SELECT key, a_idx::BIGINT AS a_idx, b_idx::BIGINT AS b_idx FROM n WHERE ca <> '-' AND cb <> '-'""")
def gapped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of each item's whole text over itself moved by one, blanks as gaps."""
    b = read(spark, sf_dir, "benchmark").where(F.length("text") >= 2)
    rows = b.select(F.col("item_id").alias("key"), F.translate(F.expr("left(text, length(text) - 1)"), " ", "-").alias("a"), F.translate(F.expr("substring(text, 2)"), " ", "-").alias("b"))
    return geometry.gapped_pairs(rows)
