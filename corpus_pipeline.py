"""A training-data pipeline over documents: quality, line dedup, near dedup, decontamination, tokens.

Every stage takes what its predecessor kept, with the columns of documents, and returns the same columns;
the last one returns tokens. Cases: null and empty texts have no words, so the quality stage rejects them;
an empty table gives an empty table; columns beyond those of documents are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, decontaminate, line_dedup, near_dedup, quality_classifier
from fathom.llm.common import ready, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects. It is fitted on labelled rows of documents."""
    ready(spark)
    labels = quality_classifier.training_labels(table(spark, sf_dir, "labels"))
    model = quality_classifier.train(table(spark, sf_dir, "documents"), labels)
    scored = quality_classifier.score_quality(docs, model, "lang", "source", "n_chars", text=True)
    return scored.where(F.col("score") >= quality_classifier.THRESHOLD).withColumnRenamed("raw_text", "text").select(*COLUMNS)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks that an earlier document has; a document that loses all its words goes."""
    ready(spark)
    out = line_dedup.line_dedup(docs, "lang", "source", "n_chars")
    gone = (F.size("removed") > 0) & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chars = F.when(F.size("removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars").cast("bigint"))
    return out.where(~gone).withColumn("n_chars", chars).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    ready(spark)
    return near_dedup.keep_one(docs.select(*COLUMNS))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left."""
    ready(spark)
    out = bpe.bpe(docs, bpe.vocabulary(), "lang", "source", outputs=("ids",))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("line_dedup", unique_lines),
    ("near_dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("bpe", tokens),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again, as the next reads it twice."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs)
    return docs
