"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages, each a line or part of one of at most PASSAGE_WORDS words. Every passage is
encoded from its words and word pairs, hashed to WORD_DIMS signed sums, and from shares of kinds of letters,
repeats and lengths; gated attention weighs the encodings; the weighted sum gives the text's score. Only texts have
labels: the weights of the passages are learned from them.

Cases: a null text, or one without words, has no passage and scores 0; null labels teach nothing; where no
text is labelled every text with words scores 0.5; repeated rows are scored row by row and teach once; a doc_id
labelled twice counts twice; other columns of the input are ignored unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, crc_mod, table, texts

#: Fitted on at most this many labelled texts, those of the least hash of doc_id, of at most BAG passages each.
SAMPLE, BAG = 2000, 256
PASSAGE_WORDS = 48
THRESHOLD = 0.3
HIDDEN, GATE, STEPS, RATE, DECAY = 16, 8, 150, 0.03, 1e-4

_CLASS = np.full(256, 9, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[32, *range(9, 14)]] = 4
for _c, _k in (("!", 5), ("|", 6), ("#*$%&<>", 7), (".,;:'\"?-", 8)):
    _CLASS[[ord(x) for x in _c]] = _k
_CLASSES, _LAGS = 10, (1, 2, 3, 4)
WORD_DIMS = 64
_SHAPE = _CLASSES + len(_LAGS) + 7
N_FEATURES = _SHAPE + WORD_DIMS


def passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the text of each passage."""
    n = len(words)
    rows = words.rows()
    newline = np.r_[0, np.cumsum(words.data == 10)]
    line = newline[words.starts]
    opens = np.r_[True, (rows[1:] != rows[:-1]) | (line[1:] != line[:-1])] if n else np.zeros(0, dtype=bool)
    first = np.flatnonzero(opens)
    inside = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    at = np.flatnonzero(inside % PASSAGE_WORDS == 0)
    return at, rows[at]


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage (float32), and its text."""
    words = Words(data, offsets)
    n = len(words)
    at, rows = passages(words)
    if not n:
        return np.zeros((0, N_FEATURES), dtype=np.float32), rows
    size = np.diff(np.r_[at, n])
    of = np.repeat(np.arange(len(at)), size)
    bounds = np.r_[words.starts[at], words.ends[-1]]
    length = np.diff(bounds)
    byte_of = np.repeat(np.arange(len(at), dtype=np.int32), length)
    kinds = np.bincount(byte_of * _CLASSES + _CLASS[data[bounds[0] : bounds[-1]]], minlength=len(at) * _CLASSES).reshape(len(at), _CLASSES)
    out = np.zeros((len(at), N_FEATURES), dtype=np.float32)
    out[:, :_CLASSES] = kinds / np.maximum(length, 1)[:, None]
    doc = words.rows()
    for k, lag in enumerate(_LAGS):
        same = np.zeros(n, dtype=bool)
        same[lag:] = (words.hash[lag:] == words.hash[:-lag]) & (doc[lag:] == doc[:-lag])
        out[:, _CLASSES + k] = np.bincount(of, same, len(at)) / size
    pos, gram = words.runs(5)
    again = np.zeros(n, dtype=bool)
    if len(pos):
        order = np.lexsort((pos, gram, doc[pos]))
        g, d, p = gram[order], doc[pos][order], pos[order]
        again[p[1:][(g[1:] == g[:-1]) & (d[1:] == d[:-1])]] = True
    wide = (words.ends - words.starts).astype(np.float64)
    mean = np.bincount(of, wide, len(at)) / size
    var = np.bincount(of, wide * wide, len(at)) / size - mean * mean
    pair, pair_hash = words.runs(2)
    owner, h = np.r_[of, of[pair]], np.r_[words.hash, pair_hash]
    sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
    hashed = np.bincount(owner * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64), sign, len(at) * WORD_DIMS).reshape(len(at), WORD_DIMS)
    out[:, _SHAPE:] = hashed / np.sqrt(2.0 * size)[:, None]
    out[:, _CLASSES + len(_LAGS) : _SHAPE] = np.stack(
        [np.bincount(of, again, len(at)) / size, mean / 10, np.sqrt(np.maximum(var, 0)) / 10, np.log1p(size) / 4, np.bincount(of, wide <= 3, len(at)) / size, np.bincount(of, wide >= 20, len(at)) / size, np.log1p(np.bincount(rows, minlength=len(offsets) - 1))[rows] / 5],
        axis=1,
    )
    return out, rows


class AttentionModel:
    """Encoder, gated attention and output weights."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.w = mean, scale, weights

    def forward(self, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages, those of one bag together."""
        w = self.w
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * s) @ w["att"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        a = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ w["out"] + w["out_b"])))}

    def score(self, x: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Score of each of n texts; 0 for those without a passage."""
        out = np.zeros(n)
        if len(rows):
            who, first, size = np.unique(rows, return_index=True, return_counts=True)
            out[who] = self.forward((x - self.mean) / self.scale, first, size)["p"] if self.w else 0.5
        return out


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> AttentionModel:
    """Adam on the cross-entropy of bag labels, over all bags in each step."""
    bags, labels = [b for b in bags if len(b)], np.array([y for b, y in zip(bags, labels, strict=True) if len(b)], dtype=np.float32)
    if not bags or labels.min() == labels.max():
        return AttentionModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), {})
    x = np.concatenate(bags)
    size = np.array([len(b) for b in bags])
    first = np.r_[0, np.cumsum(size)[:-1]]
    mean, scale = x.mean(axis=0, dtype=np.float64).astype(np.float32), x.std(axis=0, dtype=np.float64).astype(np.float32) + np.float32(1e-3)
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    shape = {"enc": (x.shape[1], HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "att": (GATE,), "out": (HIDDEN,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) for k, s in shape.items()} | {"enc_b": np.zeros(HIDDEN, np.float32), "out_b": np.zeros((), np.float32)}
    model = AttentionModel(mean, scale, w)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        f = model.forward(x, first, size)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        d = (f["p"] - labels) / len(labels)
        dz = np.repeat(d[:, None] * w["out"], size, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), size))
        dt, ds = de[:, None] * w["att"] * s * (1 - t * t), de[:, None] * w["att"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ w["v"].T + ds @ w["u"].T) * (1 - h * h)
        grad = {"enc": x.T @ dh, "enc_b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "att": (t * s).T @ de, "out": f["z"].T @ d, "out_b": d.sum()}
        for k in w:
            g = grad[k] + DECAY * w[k]
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
            w[k] = (w[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel:
    """Fit on a bounded sample of the labelled texts. The driver gets their passages' features only."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "label").limit(sample)
    source = texts(docs).join(F.broadcast(known), "doc_id").select(F.xxhash64("doc_id").alias("id"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            x, rows = encode(data, offsets)
            cut = np.searchsorted(rows, np.arange(part.num_rows + 1))
            out = pa.RecordBatch.from_pydict({"id": part.column("id"), "label": part.column("label"), "x": pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})
            yield out.filter(pa.array(np.diff(cut) <= BAG))

    bags = source.mapInArrow(run, "id bigint, label double, x binary").distinct().orderBy("id", "label", "x").limit(sample)
    got = bags.collect()
    return fit([np.frombuffer(r.x, dtype=np.float32).reshape(-1, N_FEATURES) for r in got], np.array([r.label for r in got]))


def score_quality(docs: DataFrame, model: AttentionModel, *keep: str, text: bool = False) -> DataFrame:
    """doc_id, the columns in keep, and score of every text; with its text if asked for."""
    source = texts(docs, *keep, *([F.col("text").alias("raw_text")] if text else []))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            x, rows = encode(data, offsets)
            out = {n: part.column(n) for n in part.schema.names if n != "text"}
            out["score"] = pa.array(shared.value.score(x, rows, part.num_rows), pa.float64())
            yield pa.RecordBatch.from_pydict(out)

    return source.mapInArrow(run, ", ".join([*fields, "score double"]))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod("doc_id", 5) != 0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    out = score_quality(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
