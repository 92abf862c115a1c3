"""Feature builds that redo only what changed, and reports that are there whole or not at all.

A build keeps a table of states beside its features: for every key the hash of its inputs, and the run that
built it. A run compares the hashes of all inputs with the states by an anti-join, builds what is new or
changed, and writes its features, then its states. Readers take a key's features from the run of its newest
state, so a run that dies before its states are written changes nothing, and the next one builds its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def content_hash(columns: Sequence[str]) -> Column:
    """sha256 of the columns' values, nulls told from empty texts."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Names of the runs below a folder that were written to the end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return sorted(n for n in names if n.startswith("run=") and done(n))


def runs(spark: SparkSession, folder: str) -> list[int]:
    return [int(n.removeprefix("run=")) for n in _files(spark, f"{folder}/states")]


def states(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """key, hash, gone and run of every key's newest state; None before the first run."""
    known = runs(spark, folder)
    if not known:
        return None
    rows = spark.read.option("basePath", f"{folder}/states").parquet(*(f"{folder}/states/run={n}" for n in known))
    return rows.groupBy(key).agg(F.max_by(F.struct("hash", "gone", "run"), "run").alias("s")).select(key, "s.*")


@dataclass(frozen=True)
class Built:
    """What a run did: its number, and how many keys it built, left alone, dropped and rejected."""

    run: int
    built: int
    unchanged: int
    removed: int
    rejected: int


def build_features(inputs: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], folder: str, tests: Sequence[tuple[str, Column]] = (), fatal: Sequence[str] = ()) -> Built:
    """Build features of new and changed inputs into folder, and forget keys that are gone.

    inputs: one row for each key. tests: reasons and conditions under which an input is rejected, the first
    that holds counts; a reason in `fatal` is an error instead. A rejected key keeps no features, and is tried
    again when its input changes. build gets the changed rows and returns rows with the key.
    """
    spark = inputs.sparkSession
    known = runs(spark, folder)
    run = known[-1] + 1 if known else 0
    columns = [c for c in inputs.columns if c != key]
    reason = F.lit(None).cast("string")
    for name, test in reversed(tests):
        lost = F.raise_error(F.concat(F.lit(f"{name}: "), F.col(key).cast("string"))).cast("string") if name in fatal else F.lit(name)
        reason = F.when(test, lost).otherwise(reason)
    now = inputs.withColumn("hash", content_hash(columns)).withColumn("reason", reason)
    had = states(spark, folder, key)
    if had is None:
        changed, kept_before, removed = now, 0, None
    else:
        live = had.where("not gone")
        changed = now.join(had.where("not gone").select(key, "hash"), [key, "hash"], "left_anti")
        removed = live.join(inputs.select(key), key, "left_anti").select(key, "hash", F.lit(True).alias("gone"), F.lit(None).cast("string").alias("reason"))
        kept_before = live.count()
    fresh = changed.select(key, "hash", F.lit(False).alias("gone"), "reason")
    news = fresh if removed is None else fresh.unionByName(removed)
    seen = Observation()
    news = news.observe(seen, F.count_if(~F.col("gone") & F.col("reason").isNull()).alias("built"), F.count_if(~F.col("gone") & F.col("reason").isNotNull()).alias("rejected"), F.count_if("gone").alias("removed"), F.count_if(~F.col("gone")).alias("changed"))
    # features first: without their states nobody reads them
    build(changed.where("reason is null").drop("hash", "reason")).write.mode("overwrite").parquet(f"{folder}/features/run={run}")
    news.write.mode("overwrite").parquet(f"{folder}/states/run={run}")
    got = seen.get
    total = 0 if had is None else kept_before - got["removed"]
    replaced = 0 if had is None else had.where(f"not gone and run < {run}").join(spark.read.parquet(f"{folder}/states/run={run}").where("not gone").select(key), key, "left_semi").count()
    return Built(run, got["built"], total - replaced, got["removed"], got["rejected"])


def features(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The features of all keys that have some, each from the run of its newest state."""
    current = states(spark, folder, key).where("not gone").select(key, "run")
    known = runs(spark, folder)
    rows = spark.read.option("basePath", f"{folder}/features").option("mergeSchema", "true").parquet(*(f"{folder}/features/run={n}" for n in known))
    return rows.join(current, [key, "run"], "left_semi")


def build_from_stream(stream: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> None:
    """The same for a stream of changed inputs: each batch's newest row of a key is built, none is forgotten."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        had = states(spark, folder, key)
        columns = [c for c in rows.columns if c != key]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*columns)).alias("r")).select(key, "r.*")
        now = rows.withColumn("hash", content_hash(columns))
        changed = now if had is None else now.join(had.where("not gone").select(key, "hash"), [key, "hash"], "left_anti")
        known = runs(spark, folder)
        run = known[-1] + 1 if known else 0
        build(changed.drop("hash")).write.mode("overwrite").parquet(f"{folder}/features/run={run}")
        changed.select(key, "hash", F.lit(False).alias("gone"), F.lit(None).cast("string").alias("reason")).write.mode("overwrite").parquet(f"{folder}/states/run={run}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# -- reports

def write_report(tables: Mapping[str, tuple[DataFrame, str]], folder: str) -> DataFrame:
    """Write named tables (frame, format: csv, json or parquet) as one report, and return its list of tables.

    Every table goes to the run's own folder; its rows and columns are counted while it is written, not by
    reading it again. The list of tables is written last: a report without it isn't there. Returns run, name,
    format, path, n_rows, n_columns.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    known = [int(n.removeprefix("run=")) for n in _files(spark, f"{folder}/reports")]
    run = known[-1] + 1 if known else 0
    rows = []
    for name, (df, kind) in tables.items():
        seen = Observation()
        path = f"{folder}/tables/run={run}/{name}.{kind}"
        writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
        (writer.option("header", True).csv if kind == "csv" else writer.json if kind == "json" else writer.parquet)(path)
        rows.append((run, name, kind, path, seen.get["n"], len(df.columns)))
    listed = spark.createDataFrame(rows, "run int, name string, format string, path string, n_rows bigint, n_columns int")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/reports/run={run}")
    return spark.read.parquet(f"{folder}/reports/run={run}")


def report_tables(spark: SparkSession, folder: str) -> DataFrame | None:
    """The list of tables of the newest whole report; None if there is none."""
    known = _files(spark, f"{folder}/reports")
    return spark.read.parquet(f"{folder}/reports/{known[-1]}") if known else None


def report_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of the newest whole report."""
    listed = report_tables(spark, folder)
    row = None if listed is None else listed.where(F.col("name") == name).first()
    if row is None:
        raise LookupError(f"no table {name} in a whole report of {folder}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(row.path) if row.format == "csv" else reader.json(row.path) if row.format == "json" else reader.parquet(row.path)
