"""The language model against a model of plain dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import lm_score
from fathom.llm.queries import QUERIES

from oracle import SF

END = None


def tokens(text):
    fold = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    return [*(text or "").encode().translate(fold).split(), END]


class Dictionaries:
    """The same model without filters and shards."""

    def __init__(self, texts, prior=lm_score.PRIOR):
        self.c, pairs = Counter(), defaultdict(Counter)
        for t in texts:
            ws = tokens(t)
            self.c.update(ws)
            for v, w in zip([END, *ws], ws):
                pairs[v][w] += 1
        self.q, self.pairs = self.c, pairs
        self.once = max(1, sum(n == 1 for n in self.c.values()))
        self.all, self.prior = sum(self.q.values()) + self.once, prior

    def p(self, v, w):
        after = self.pairs.get(v, {})
        return (after.get(w, 0) + self.prior * self.q.get(w, self.once) / self.all) / (sum(after.values()) + self.prior)

    def score(self, text):
        ws = tokens(text)
        return sum(math.log10(self.p(v, w)) for v, w in zip([END, *ws], ws))


def whole():
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("hot,task", [(100_000, 2_500_000), (50, 9_000)])
def test_scores_of_documents(spark, monkeypatch, hot, task):
    monkeypatch.setattr(lm_score, "HOT", hot)
    monkeypatch.setattr(lm_score, "TASK_TOKENS", task)
    rows = QUERIES["op5_lm_score"](spark, SF).collect()
    docs = dict(whole())
    model = Dictionaries([t for i, t in docs.items() if not held(i)])
    n, v = sum(model.c.values()), len(model.c)
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(model.c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((model.c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, model.score(docs[r.doc_id]), rel_tol=1e-6)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_every_context_sums_to_one(spark):
    model = Dictionaries([t for i, t in whole() if i < 25])
    events = [*model.c, "never seen"]
    for v in [*list(model.c)[:300], "never seen"]:
        assert math.isclose(sum(model.p(v, w) for w in events), 1, abs_tol=1e-6)
    # the operator's own probabilities of all events after a token: those of "v w" without "w"'s successors
    texts = ["a b a b a c", "a b", "b c c", "A d " * 40, "d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = lm_score.train(docs, prior=3.0)
    fresh = lambda asked: lm_score.lm_score(docs.withColumn("fitted", F.lit(True)).unionByName(asked.withColumn("fitted", F.lit(False))).withColumn("raw", F.col("text")), fitted, F.col("fitted"), "raw", "fitted")
    brute = Dictionaries(texts, prior=3.0)
    words = ["a", "b", "c", "d", "e", "zz"]
    ask = spark.createDataFrame([(k, f"{v} {w}") for k, (v, w) in enumerate((v, w) for v in words for w in words)] + [(100 + k, v) for k, v in enumerate(words)] + [(200, "")], "doc_id long, text string")
    got = {r.raw: r.score for r in fresh(ask).collect() if not r.fitted}
    assert all(math.isclose(x, brute.score(t), rel_tol=1e-6) for t, x in got.items())
    p = lambda v, w: brute.p(v and v.encode(), w and w.encode())
    for v in words:
        followed = sum(10 ** got[f"{v} {w}"] / p(None, v) / p(w, None) for w in words)
        assert math.isclose(followed + 10 ** got[v] / p(None, v), 1, abs_tol=1e-6)


def test_odd_texts(spark):
    rows = list(enumerate([None, "", "a a b", "A a", "new words", "a " * 3000]))
    docs = spark.createDataFrame([*rows, (None, "a a b")], "doc_id long, text string").withColumn("uid", F.lit(1)).withColumn("score", F.lit("x"))
    model = lm_score.train(docs.where("doc_id < 4"))
    got = {r.doc_id: r for r in lm_score.lm_score(docs, model, F.col("doc_id") < 4).collect()}
    brute = Dictionaries([None, "", "a a b", "A a"])
    assert model.tokens == 9 and model.distinct == 3
    assert (got[0].n_tokens, got[2].n_known, got[4].n_known, got[5].n_tokens) == (1, 4, 1, 3001)
    assert all(math.isclose(got[i].score, brute.score(t), rel_tol=1e-6) for i, t in rows)
    assert got[None].score == got[2].score
    empty = lm_score.train(docs.limit(0))
    assert [(r.n_known, r.score) for r in lm_score.lm_score(docs, empty, F.lit(False)).collect()] == [(0, 0)] * 7
    assert lm_score.lm_score(docs.limit(0), model, F.lit(True)).count() == 0
    twice = docs.unionByName(docs).repartition(3).withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id")))
    model = lm_score.train(twice)
    got = lm_score.lm_score(twice, model, F.lit(True)).collect()
    brute = Dictionaries(2 * [t for _, t in [*rows, (None, "a a b")]])
    assert sorted((str(r.doc_id), round(r.score, 3)) for r in got) == sorted(2 * [(str(i and f"id{i}" if i != 0 else "id0"), round(brute.score(t), 3)) for i, t in [*rows, (None, "a a b")]])


def test_repeated_rows_teach_twice(spark):
    one = spark.createDataFrame([(1, "x y z"), (1, "x y z")], "doc_id long, text string")
    model = lm_score.train(one)
    assert (model.tokens, model.distinct, model.once) == (8, 4, 1)
    assert len({r.score for r in lm_score.lm_score(one, model, F.lit(True)).collect()}) == 1


def test_filter_levels():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    counts = np.floor(np.exp(rng.uniform(0, 12, 5000)))
    f = lm_score.Filter(keys, counts.astype(np.int64))
    assert np.array_equal(f.count(keys), counts)
    assert not f.count(rng.integers(0, 2**63, 5000).astype(np.uint64)).any()
