"""Importance resampling towards a target: hashed word n-grams weigh documents, Gumbel keys draw them.

A text is scanned once. A ring holds the zlib states of the runs that began at the last n words; each new
word extends every state by a space and its bytes, and opens a state of its own, so a run of any length costs
one call and no run is put together. The states are the features' hashes; their buckets are stored with the
row, and counts and weights come from what is stored. A task adds up its buckets before it ships them: one
number for each bucket and task. What is broadcast is one gain for each bucket (`buckets` numbers, whatever
the input). The draw is a global rank by ranges of the score, not a sort in one task.

Cases: null and empty texts have no words, no features and weight 0, and are never drawn (fewer than
min_words words); a null doc_id counts as the empty text in its key and comes first among ties; ties in score
go to the smaller doc_id, and equal rows (repeats) take the ranks that they share in any order; an empty
table gives an empty table, an empty target leaves gains that only the documents decide; other columns are
ignored and may have any name. A text of any length is scanned in pieces.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, texts
from .places import positions

BUCKETS = 10000
LONGEST_RUN = 2
PERCENT = 25
SEED = 7
MIN_WORDS = 20
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text with A-Z lower-cased, a piece of it at a time; no word is cut."""
    at = 0
    while at < len(text):
        to = len(text)
        if to - at > PIECE:
            gap = _GAP.search(text, at + PIECE)
            to = gap.start() if gap else to
        yield _WORDS.findall(text, at, to)
        at = to


def feature_buckets(text: bytes, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of 1 to `longest` words, from one scan."""
    found, ring, n = array("I"), [], 0
    for words in words_of(text.lower()):
        n += len(words)
        for word in words:
            spaced = b" " + word
            ring = [crc32(spaced, state) for state in (ring[1:] if len(ring) == longest else ring)]
            ring.append(crc32(word))
            found.extend(ring)
    return n, np.frombuffer(found, dtype=np.uint32) % np.uint32(buckets) if found else np.zeros(0, np.uint32)


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def features(docs: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and found (the sorted buckets as little-endian integers) of every row."""
    source = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scans = [feature_buckets(t.as_buffer().to_pybytes(), longest, buckets) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array([n for n, _ in scans], pa.int64()), "n_features": pa.array([len(x) for _, x in scans], pa.int64()),
                "found": pa.array([np.sort(x).astype(_kind(buckets)).tobytes() for _, x in scans], pa.binary()),
            })

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, found binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows: at most `buckets` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for x in batch.column("found"):
                n += np.bincount(np.frombuffer(x.as_buffer(), dtype=_kind(buckets)), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(n[at])})

    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in found.select("found").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) for each bucket, of smoothed shares in the target and in the documents."""
    t_all, s_all, buckets = int(target.sum()), int(source.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], dtype=np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain of a row's features."""
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            sums = [int(gain[np.frombuffer(x.as_buffer(), dtype=_kind(len(gain)))].sum()) for x in batch.column("found")]
            weight = [s // n if n else 0 for s, n in zip(sums, batch.column("n_features").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("doc_id", "n_words", "n_features")} | {"weight": pa.array(weight, pa.int64())})

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, *, longest: int = LONGEST_RUN, buckets: int = BUCKETS, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null where it isn't drawn.

    score adds Gumbel noise (in thousandths, from a hash of seed and doc_id) to the weight, so that the
    highest scores are a draw without replacement in proportion to the importance weights.
    target: rows with the column text.
    """
    found = stored(features(docs, longest, buckets))
    wanted = target.select(F.lit(0).cast("bigint").alias("doc_id"), "text")
    gain = gains(bucket_counts(features(wanted, longest, buckets), buckets), bucket_counts(found, buckets))
    drawn = found.where(F.col("n_words") >= min_words).count() * percent // 100
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((key + 0.5) / 4294967296)))
    scored = weighed(found, gain).withColumn("score", (F.col("weight") + noise).cast("bigint")).withColumn("may", F.col("n_words") >= min_words)
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_words"), F.asc("n_features"), F.asc("weight")]
    placed = positions(scored, [], order)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _crc_step(nibble: int) -> int:
    for _ in range(4):
        nibble = nibble >> 1 ^ (0xEDB88320 if nibble & 1 else 0)
    return nibble


def crc32_sql(column: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes, half a byte at a time."""
    halves = f"list_transform(range(0, length(hex(encode({column})))::BIGINT), lambda i: strpos('123456789ABCDEF', substr(hex(encode({column})), (xor(i, 1) + 1)::BIGINT, 1))::BIGINT)"
    steps = [_crc_step(k) for k in range(16)]
    return f"xor(4294967295::BIGINT, list_reduce({halves}, lambda c, x: xor(c >> 4, {steps}[(xor(c, x) & 15) + 1]::BIGINT), 4294967295::BIGINT))::BIGINT"


_ADDED = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"


def _features_sql(rows: str) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"SELECT row, doc_id, len(w) AS n_words, list_concat(w, {_ADDED}) AS f FROM (SELECT row, doc_id, {words} AS w FROM ({rows}))"


OP11_SQL = f"""
WITH d AS MATERIALIZED ({_features_sql("SELECT row_number() OVER () AS row, doc_id, text FROM documents")}),
b AS MATERIALIZED ({_features_sql("SELECT 0 AS row, 0 AS doc_id, text FROM benchmark")}),
df AS MATERIALIZED (SELECT row, unnest(f) AS feature FROM d), bf AS MATERIALIZED (SELECT unnest(f) AS feature FROM b),
known AS MATERIALIZED (SELECT feature, {crc32_sql("feature")} % {BUCKETS} AS bucket FROM (SELECT feature FROM df UNION SELECT feature FROM bf)),
s AS (SELECT bucket, count(*) AS n FROM df JOIN known USING (feature) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bf JOIN known USING (feature) GROUP BY bucket),
gain AS MATERIALIZED (SELECT r.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {BUCKETS}) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {BUCKETS}))))::BIGINT AS gain
  FROM range({BUCKETS}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN known USING (feature) JOIN gain USING (bucket) GROUP BY row),
scored AS (SELECT d.doc_id, n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (row)),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_words >= {MIN_WORDS} DESC, score DESC, doc_id NULLS FIRST) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * {PERCENT} // 100 FROM scored WHERE n_words >= {MIN_WORDS}) THEN place END AS rank FROM ranked
"""
