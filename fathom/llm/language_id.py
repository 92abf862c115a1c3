"""Language identification as mixture inference: EM finds each text's language proportions.

Features are byte trigrams of the letters, hashed to BUCKETS. Counts by language come from all training
texts; a text's proportions maximise its likelihood under a mixture of the languages' trigram
distributions, and the set of languages is the one with the best penalised likelihood.

Cases: a null text, or one without letters, is `und` with score 0; one with letters but no trigram gets the
language with the most training trigrams, and its share of them; rows with a null lang teach nothing; with
no training rows every text is `und`; more than MOST languages are an error, as the model is broadcast; repeated
rows are predicted row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, cut_lineage, table, texts

BUCKETS, SMOOTHING = 1 << 14, 0.5
#: Languages that a model may have: 64 KB each.
MOST = 1000
#: EM steps; languages below LEAST of the text aren't tried; cost of a language in units of log(trigrams).
STEPS, LEAST, PENALTY = 12, 0.03, 2.0

_FOLD = np.zeros(256, dtype=np.uint32)
_FOLD[97:123] = _FOLD[65:91] = np.arange(1, 27)
_FOLD[128:256] = np.arange(27, 155)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and bucket of every run of three bytes in a text with a letter among them."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    c = _FOLD[data]
    key = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = (key != 0) & (rows[:-2] == rows[2:])
    bucket = (key[good] * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return rows[:-2][good], bucket.astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows that have a lang; each task counts before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for part, data, offsets in chunks(batches):
            rows, bucket = trigrams(data, offsets)
            codes, names = pd.factorize(np.array(part.column("lang").to_pylist(), dtype=object))
            if len(names) == 0:
                continue
            n = np.bincount(codes[rows] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, row in zip(names, n, strict=True):
                found[name] = found.get(name, 0) + row
        for name, row in found.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(row[at], pa.int64())})

    rows = texts(docs, "lang").where("lang is not null").mapInArrow(run, "lang string, bucket int, n bigint")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Languages:
    """Names and trigram probabilities; its size is the number of languages times BUCKETS."""

    def __init__(self, counts: pd.DataFrame):
        self.names = sorted(counts["lang"].unique())
        n = np.full((len(self.names), BUCKETS), SMOOTHING)
        n[np.searchsorted(self.names, counts["lang"]) if len(counts) else [], counts["bucket"].astype(int)] += counts["n"]
        self.p = (n / n.sum(axis=1, keepdims=True)).astype(np.float32) if len(self.names) else n
        total = n.sum(axis=1)
        self.common = int(total.argmax()) if len(total) else -1
        self.share = float(total.max() / total.sum()) if len(total) else 0.0

    def mixture(self, p: np.ndarray, c: np.ndarray, size: np.ndarray, first: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EM over texts of `size` entries each: proportions (languages x texts) and log likelihoods.

        p: probability by language and entry; c: counts; start: first proportions, 0 shuts a language out.
        """
        pi = start / start.sum(axis=0)
        total = np.add.reduceat(c, first)
        for step in range(STEPS + 1):
            wide = [np.repeat(x, size) * q if x.any() else None for x, q in zip(pi.astype(np.float32), p, strict=True)]
            s = sum(w for w in wide if w is not None)
            if step == STEPS:
                return pi, np.add.reduceat(c * np.log(s), first, dtype=np.float64)
            part = c / s
            pi = np.array([np.zeros(len(size)) if w is None else np.add.reduceat(w * part, first, dtype=np.float64) for w in wide]) / total
        raise AssertionError

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's main language (-1 for none) and its share in the selected mixture."""
        docs = len(offsets) - 1
        best, score = np.full(docs, -1), np.zeros(docs)
        rows, bucket = trigrams(data, offsets)
        if not len(rows) or not self.names:
            return best, score
        keys, c = np.unique((rows * BUCKETS + bucket).astype(np.int64), return_counts=True)
        rows, bucket, c = keys // BUCKETS, keys % BUCKETS, c.astype(np.float32)
        who, first, size = np.unique(rows, return_index=True, return_counts=True)
        p = self.p[:, bucket]
        k = len(self.names)
        pi, _ = self.mixture(p, c, size, first, np.ones((k, len(who))))
        order = np.argsort(-pi, axis=0, kind="stable")
        ranked = np.take_along_axis(pi, order, axis=0)
        cost = PENALTY * np.log(np.add.reduceat(c, first) + 1)
        chosen, value = np.zeros((k, len(who))), np.full(len(who), -np.inf)
        for m in range(1, k + 1):
            sel = np.flatnonzero((ranked[m - 1] >= LEAST) | (m == 1))
            if not len(sel):
                break
            start = np.zeros((k, len(sel)))
            np.put_along_axis(start, order[:m, sel], np.maximum(ranked[:m, sel], 1e-3), axis=0)
            entry = np.isin(rows, who[sel])
            own_size = size[sel]
            got, like = self.mixture(p[:, entry], c[entry], own_size, np.r_[0, np.cumsum(own_size)[:-1]], start)
            like = like - m * cost[sel]
            better = like > value[sel]
            chosen[:, sel[better]], value[sel[better]] = got[:, better], like[better]
        best[who], score[who] = chosen.argmax(axis=0), chosen.max(axis=0)
        return best, np.clip(score, 0, 1)


def train(docs: DataFrame) -> Languages:
    """Fit on all rows of docs that have a lang. The driver gets MOST x BUCKETS counts at most."""
    counted = cut_lineage(count_trigrams(docs))
    n = counted.select("lang").distinct().count()
    if n > MOST:
        raise ValueError(f"{n} languages to learn, {MOST} at most: clean the lang column")
    return Languages(counted.toPandas())


def language_id(docs: DataFrame, model: Languages, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, lang_pred and score of every text."""
    source = texts(docs, *keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.names, "und"], dtype=object)
        for part, data, offsets in chunks(batches):
            best, score = model.predict(data, offsets)
            bare = best < 0
            best[bare], score[bare] = model.common, model.share
            plain = (data >= 65) & ((data <= 90) | ((data >= 97) & (data <= 122)))
            n = np.r_[0, np.cumsum(plain)]
            for k in np.flatnonzero(n[offsets[1:]] == n[offsets[:-1]]):
                if not has_letter(part.column("text")[int(k)].as_py()):
                    best[k], score[k] = -1, 0.0
            out = {n: part.column(n) for n in part.schema.names if n != "text"}
            out["lang_pred"] = pa.array(names[best], pa.string())
            out["score"] = pa.array(np.where(best < 0, 0.0, score), pa.float64())
            yield pa.RecordBatch.from_pydict(out)

    return source.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = train(docs.where(~held))
    return language_id(docs.withColumn("held_out", held), model, "held_out").select("doc_id", "held_out", "lang_pred", "score")
