"""The tables of a publication report, all from inputs that are stored once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.streaming.incremental import stored

from . import metrics, reports
from .coordinate_tables import coordinate_tables

#: The fields that are counted, the edges of displacement bins in angstroms, the categories of neural models.
FIELDS = ("evidence_level", "family", "state_label", "substrate_class", "split", "method", "af_version")
EDGES = (0.0, 0.5, 1.0, 2.0, 5.0)
NEURAL = ("cooper", "ablation", "neural")
#: Inputs that are read once: their sums are stored, or they are written as they are.
ONCE = ("checks", "selectors", "files")


def manifest_tables(manifests: DataFrame, fields: Sequence[str], group: str) -> tuple[DataFrame, DataFrame]:
    """Counts of each field's values by manifest, and one summary row for each manifest with its leaking groups."""
    counts = None
    blank = [F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.lit("missing")).alias(f) for f in fields]
    long = manifests.select("manifest", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), b.alias("value")) for f, b in zip(fields, blank, strict=True)))).alias("c"))
    counts = long.groupBy("manifest", "c.field", "c.value").agg(F.count("*").alias("n"))
    leaking = manifests.groupBy("manifest", group).agg(F.count_distinct("split").alias("s")).groupBy("manifest").agg(F.count_if(F.col("s") > 1).alias("n_overlapping_groups"))
    summary = manifests.groupBy("manifest").agg(F.count("*").alias("rows"), F.count_distinct("uniprot_id").alias("unique_uniprot"), F.count_distinct("pdb_id").alias("unique_pdb"))
    summary = summary.join(leaking, "manifest").withColumn("status", F.when(F.col("n_overlapping_groups") == 0, "pass").otherwise("fail"))
    return counts, summary


def graph_tables(residues: DataFrame, edges: Sequence[float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By scope, split and region: displacements, and bins of them; and one row for each scope and split."""
    d = F.col("displacement")
    by = ["scope", "split", "region"]
    table = residues.groupBy(*by).agg(F.count("*").alias("n_residues"), F.count_distinct("sample_id").alias("n_samples"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(d).alias("max"))
    bins = reports.bin_grid(residues, ["scope", "split"], "region", "displacement", edges)
    whole = residues.dropDuplicates(["scope", "split", "sample_id", "idx"]).groupBy("scope", "split").agg(F.count_distinct("sample_id").alias("n_samples"), F.count("*").alias("n_residues"), F.avg(d).alias("mean"))
    return table, bins, whole


def paired_tables(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries of model less raw errors by seed, and of each target's mean over seeds; and the rows behind them."""
    by_seed = deltas.select(F.concat(F.lit("seed_"), F.col("seed").cast("string")).alias("aggregation"), "target", "region", "delta")
    mean = deltas.groupBy("target", "region").agg(F.avg("delta").alias("delta")).select(F.lit("per_target_seed_mean").alias("aggregation"), "target", "region", "delta")
    rows = stored(by_seed.unionByName(mean))
    return metrics.delta_summary(rows, ["aggregation", "region"]), rows


def check_table(checks: DataFrame) -> DataFrame:
    """scope, pair_count, failed_pair_checks, status; checks has a row for each pair with its reason or null."""
    out = checks.groupBy("scope").agg(F.count("*").alias("pair_count"), F.count("reason").alias("failed_pair_checks"))
    return out.withColumn("status", F.when(F.col("failed_pair_checks") == 0, "pass").otherwise("fail"))


def quality_flags(summary: DataFrame, checks: DataFrame, classification: DataFrame, templates: DataFrame) -> DataFrame:
    """severity, scope, issue of what a reader should know before the numbers."""
    found = reports.flags(summary, [("error", "split_leakage", F.col("status") == "fail")]).select("severity", F.col("manifest").alias("scope"), "issue")
    found = found.unionByName(reports.flags(checks, [("error", "failed_pair_checks", F.col("status") == "fail")]).select("severity", "scope", "issue"))
    one_class = F.coalesce((F.col("positives") == 0) | (F.col("negatives") == 0), F.lit(True))
    found = found.unionByName(reports.flags(classification, [("warning", "one_class_only", one_class)]).select("severity", F.col("label").alias("scope"), "issue"))
    return found.unionByName(reports.flags(templates, [("warning", "targets_without_template", F.col("targets_with_no_candidate") > 0)]).select("severity", F.lit("templates").alias("scope"), "issue"))


def publication_tables(inputs: Mapping[str, DataFrame], regions: Sequence[str], *, fields: Sequence[str] = FIELDS, edges: Sequence[float] = EDGES, group: str = "split_group_id", neural: Sequence[str] = NEURAL, iterations: int = 5000, seed: int = 42) -> dict[str, tuple[DataFrame, str]]:
    """The report's 10 CSV and 12 JSON tables by name, for `builds.write_report`.

    inputs: manifests (manifest, uniprot_id, pdb_id, split, the group, fields), residues (scope, split, sample_id,
    idx, region, displacement), checks (scope, pair_id, reason), reports (method, label, category, source, body),
    deltas (seed, target, region, delta), classification (label, region, positives, negatives, areas), selectors
    (selector, endpoint, seed, value), templates (candidate_count, nearest_identity, nearest_coverage), files
    (path, bytes, sha256). What feeds several tables is stored before them; of an input that is only added up, or
    that is a table itself, the rows aren't.
    """
    have = {n: df if n in ONCE else stored(df) for n, df in inputs.items()}
    counts, summary = manifest_tables(have["manifests"], fields, group)
    graph, bins, whole = graph_tables(have["residues"], edges)
    coordinates, samples = (stored(df) for df in coordinate_tables(have["reports"], regions, iterations, seed))
    ablations = coordinates.where(F.col("category").isin(*neural))
    deltas, delta_rows = paired_tables(have["deltas"])
    checks, templates = (stored(df) for df in (check_table(have["checks"]), reports.template_selection(have["templates"])))
    selectors = reports.seed_aggregate(have["selectors"], ["selector", "endpoint"])
    summary, bins, deltas, selectors = (stored(df) for df in (summary, bins, deltas, selectors))
    csv = {
        "manifest_field_counts": counts, "graph_region_summary": graph, "displacement_bin_summary": bins, "coordinate_metrics_summary": coordinates, "coordinate_sample_metrics": samples,
        "neural_ablation_summary": ablations, "primary_model_paired_delta_summary": deltas, "primary_model_paired_delta_samples": delta_rows, "classification_metrics_summary": have["classification"], "selector_sensitivity_summary": selectors,
    }
    both = ("coordinate_metrics_summary", "neural_ablation_summary", "primary_model_paired_delta_summary", "primary_model_paired_delta_samples", "classification_metrics_summary", "selector_sensitivity_summary")
    json = {
        "dataset_summary": summary, "strict_input_checks": checks, "graph_summary": whole, **{n: csv[n] for n in both}, "template_selection_summary": templates,
        "quality_flags": quality_flags(summary, checks, have["classification"], templates), "reproducibility_manifest": have["files"],
    }
    return {f"{n}.csv": (df, "csv") for n, df in csv.items()} | {f"{n}.json": (df, "json") for n, df in json.items()}
