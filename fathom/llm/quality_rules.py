"""Quality rules: a table of thresholds compiled into one projection, with no user function.

Cases: a null text counts as the empty text; a text without words has ratios of 0 and fails the
length rule; equal lines and repeated rows are judged row by row; columns of the input may have any name,
those asked for in keep any but a measure's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPLIT, table

#: Common short words of the four languages.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "aber als auch auf aus bei das dem den der des die ein eine einer er es für ich im in ist mit nicht sich sie und von zu "
    "au avec ce dans de des du elle en est et il je la le les ne pas par pour que qui se son sur un une "
    "al como con de del el en es la las lo los más no o para pero por que se su sus un una y"
).split()

#: measure, least, most. A measure outside its bounds rejects the text; None leaves a side open.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 10, None),
    ("mean_word_chars", 1.5, 20),
    ("symbol_ratio", None, 0.4),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.2),
)

def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts and ratios of each text; n_repeat_words counts words in 5-word runs found twice or more.

    Runs are compared by a 64-bit hash of their five words. Hashes are sorted together with their
    positions inside each text's own array, so nothing is shuffled, and a run that occurs again has
    an equal neighbour, however long the text.
    """
    df = docs.select(*(F.col(c).alias(f"keep {k}") for k, c in enumerate(keep)), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    kept = [f"keep {k}" for k in range(len(keep))]
    df = df.select(
        *kept,
        F.array_remove(F.split("_t", WORD_SPLIT), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    run = lambda i: F.struct(F.xxhash64(*(F.get("_w", i + k) for k in range(5))).alias("h"), i.alias("i"))
    df = df.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(F.size("_w") >= 5, F.array_sort(F.transform(F.sequence(F.lit(0), F.size("_w") - 5), run))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_s"),
    )
    again = F.filter("_s", lambda x, j: (x["h"] == F.get("_s", j + 1)["h"]) | (x["h"] == F.get("_s", j - 1)["h"]))
    df = df.select("*", F.sort_array(F.transform(again, lambda x: x["i"])).alias("_p")).drop("_s")
    steps = F.transform("_p", lambda x, j: F.least(F.lit(5), F.coalesce(F.get("_p", j + 1) - x, F.lit(5))).cast("long"))
    df = df.select("*", F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_repeat_words")).drop("_p")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return df.select(
        *(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), *(c for c in df.columns if c not in kept),
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbol_ratio"),
        share("n_stop_words", "n_words").alias("stop_word_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        share("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )


def verdict(rules=RULES) -> Column:
    """True where every measure lies in its bounds."""
    tests = [F.col(m) >= F.lit(lo) for m, lo, _ in rules if lo is not None] + [F.col(m) <= F.lit(hi) for m, _, hi in rules if hi is not None]
    return reduce(Column.__and__, tests, F.lit(True))


def quality_rules(docs: DataFrame, rules=RULES, *keep: str) -> DataFrame:
    """The measures of every text, base_failed, and kept: false if base_failed, else the table's verdict."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, *keep).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), RULES, "doc_id")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
OP4_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
         row_number() OVER () AS rid
  FROM documents),
g AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
d AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM d GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_filter(ws, lambda x: lower(x) IN ({_SQL_STOPS})))::BIGINT AS n_stop_words,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND word_chars / nullif(n_words, 0) BETWEEN 1.5 AND 20 AND n_symbols / nullif(n_words, 0) <= 0.4
        AND n_stop_words / nullif(n_words, 0) >= 0.01 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5
        AND n_repeat_words / nullif(n_words, 0) <= 0.2) AS kept
FROM b
"""
