"""LM scoring with log-frequency Bloom filters of n-gram counts.

The n-grams are tokens and pairs of neighbouring tokens, all of them. A count of d binary digits enters a Bloom
filter as (n-gram, 1) to (n-gram, d) and as (n-gram, place) for each further digit that is 1: the number of
entries grows with the logarithm of the count. It is read back by probing 1, 2, 3 ... until a probe fails,
then the places below. Counts are kept to the last digit, as coarser steps can't be summed up to 1 after a
token without a second shuffle of all pairs.

With c() for these counts, N for their sum over tokens, and U for the number of tokens seen once (1 at least):

    P(w)     = c(w) / (N + U), and U / (N + U) for the one event of any unknown token
    P(w | v) = (c(v, w) + PRIOR * P(w)) / (c(v) + PRIOR)

so that the known tokens and the unknown one sum to 1 after every v. A text begins after an end.

The filter grows with the corpus, so only a part with a proven bound is broadcast: tokens that are 1 / HOT of
all tokens or more, and pairs that are so by what single tasks saw of them, HOT of each at most. Every other
token of a text is dealt to the task that owns its shard, by a hash of w (of a token with a large share of all,
also of v), with the number of the text and 40 bits of the hash of v. That task enters its shard's n-grams
of training texts in a filter, and scores all tokens dealt to it by probing that. P(w | v)'s numerator needs
w and (v, w), which are in one shard, and the denominators of a text are those of its own tokens. No n-gram
is left out, and results don't depend on HOT or TASK_TOKENS but for false positives, about 2**-24 an entry.

The base score is exact: it takes the counts of tokens themselves.

Cases: a null or empty text is one end token; with no training text every token is unknown, N and V are 0
and the scores are 0; repeated rows are scored row by row and each counts in training; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, chunks, crc_mod, cut_lineage, mix, steady, table, texts, unused

#: Bits of a filter for each entry; they make false positives about as rare as 24 independent bits do.
ENTRY_BITS, PRIOR = 64, 100.0
#: Bounds of the tokens, and of the pairs, that are broadcast; tokens of a shard.
HOT, TASK_TOKENS = 100_000, 2_500_000
#: Tokens that a task gathers before it deals them out.
FLUSH = 700_000
_U = np.uint64
_END = 0x0E0D0C0B0A090807
_CONTEXT = 24  # a context is known by the upper 40 bits of its token's hash, a shard by the lower 24
_MULTIPLIERS = mix(np.arange(1, 9, dtype=np.uint64)) | _U(1)
_SUM = np.dtype([("uid", "i8"), ("known", "u4"), ("base", "f8"), ("score", "f4")])


class Filter:
    """Counts of keys, as memberships of (key, number of digits so far) and (key, place of a digit).

    An entry has 24 bits in one block of 512 bits, three in each of eight words.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        digits = np.frexp(counts.astype(np.float64))[1].astype(np.int64)
        found = [np.zeros(0, dtype=np.uint64)]
        for j in range(1, int(digits.max(initial=0)) + 1):
            found.append(self._hash(keys[digits >= j], j))
            found.append(self._hash(keys[(digits > j) & (counts >> (j - 1) & 1 == 1)], -j))
        h = np.concatenate(found)
        self.blocks = -(-max(1, len(h)) * ENTRY_BITS // 512)
        self.data = np.zeros((8, self.blocks), dtype=np.uint64)
        if len(h):
            block = self._block(h)
            order = np.argsort(block)
            h, block = h[order], block[order]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for k in range(8):
                self.data[k, block[first]] = np.bitwise_or.reduceat(_mask(h, k), first)

    @staticmethod
    def _hash(keys: np.ndarray, entry: int) -> np.ndarray:
        return mix(keys ^ _U(entry * 0x9E3779B97F4A7C15 % 2**64))

    def _block(self, h: np.ndarray) -> np.ndarray:
        return ((h >> _U(32)) * _U(self.blocks) >> _U(32)).astype(np.int64)

    def has(self, keys: np.ndarray, entry: int) -> np.ndarray:
        h, live = self._hash(keys, entry), np.arange(len(keys))
        block = self._block(h)
        for k in range(8):
            want = _mask(h, k)
            hit = self.data[k, block] & want == want
            if not hit.all():
                live, h, block = live[hit], h[hit], block[hit]
        out = np.zeros(len(keys), dtype=bool)
        out[live] = True
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key, found by probing."""
        out = np.zeros(len(keys), dtype=np.int64)
        live = np.flatnonzero(self.has(keys, 1))
        if len(live):
            own, back = np.unique(keys[live], return_inverse=True)
            digits, left, j = np.ones(len(own), dtype=np.int64), np.arange(len(own)), 2
            while len(left) and j < 63:
                left = left[self.has(own[left], j)]
                digits[left] = j
                j += 1
            n = np.left_shift(1, digits - 1)
            for j in range(1, int(digits.max())):
                more = np.flatnonzero(digits > j)
                n[more[self.has(own[more], -j)]] += 1 << (j - 1)
            out[live] = n[back]
        return out


def _mask(h: np.ndarray, k: int) -> np.ndarray:
    """Three bits of a word, from the hash and the word's place in its block."""
    g = h * _MULTIPLIERS[k] >> _U(46)
    one = _U(1)
    return one << (g & _U(63)) | one << (g >> _U(6) & _U(63)) | one << (g >> _U(12))


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, token and the token before it (an end at a text's beginning) of all texts, with their ends."""
    n, docs = len(words), len(words.first) - 1
    size = words.counts() + 1
    last = np.cumsum(size) - 1
    token = np.full(n + docs, _END, dtype=np.int64)
    inner = np.ones(n + docs, dtype=bool)
    inner[last] = False
    token[inner] = words.hash.view(np.int64)
    before = np.r_[np.int64(_END), token[:-1]] if docs else token
    return np.repeat(np.arange(docs), size), token, before


def context(token: np.ndarray) -> np.ndarray:
    return (token.view(_U) >> _U(_CONTEXT)).view(np.int64)


def pair_key(token: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return mix(token.view(_U) * _U(0x9E3779B97F4A7C15) ^ ctx.view(_U))


def _index(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in sorted_keys, -1 for those that aren't there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Dealer:
    """The shard of a token after a context: tokens with a large share of all are split by context."""

    def __init__(self, shards: int, tokens: int, keys: np.ndarray, counts: np.ndarray):
        split = np.ceil(counts * shards * 4 / max(tokens, 1)).astype(np.int64)
        self.shards, self.keys, self.split = shards, keys[split > 1], split[split > 1]

    def shard(self, token: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        out = (token & 0xFFFFFF) % self.shards
        at = _index(self.keys, token)
        big = np.flatnonzero(at >= 0)
        out[big] = (out[big] + 7919 * (ctx[big] % self.split[at[big]])) % self.shards
        return out


def _packed(head: int, key: np.ndarray, ctx: np.ndarray, extra: np.ndarray) -> bytes:
    """Entries sorted by key: each key once with its number of entries, the contexts in five bytes."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)]).astype(np.int32)
    wide = extra.max(initial=0) >= 2**16
    return b"".join([
        np.array([head, len(first), len(key), wide], dtype=np.int64).tobytes(), key[first].tobytes(), size.tobytes(),
        (ctx & 0xFFFFFFFF).astype(np.uint32).tobytes(), (ctx >> 32).astype(np.uint8).tobytes(), extra.astype(np.int64 if wide else np.uint16).tobytes(),
    ])


def _unpacked(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    head, m, n, wide = np.frombuffer(data, dtype=np.int64, count=4)
    at, out = 32, []
    for kind, k in ((np.int64, m), (np.int32, m), (np.uint32, n), (np.uint8, n), (np.int64 if wide else np.uint16, n)):
        out.append(np.frombuffer(data, dtype=kind, count=k, offset=at))
        at += int(k) * np.dtype(kind).itemsize
    key, size, low, high, extra = out
    return int(head), np.repeat(key, size), low.astype(np.int64) | high.astype(np.int64) << 32, extra.astype(np.int64)


def _slices(part: np.ndarray, parts: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Arrays in order, cut by part."""
    order = np.lexsort((arrays[0], part))
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    arrays = [a[order] for a in arrays]
    for k in np.flatnonzero(np.diff(cut)):
        yield int(k), [a[cut[k] : cut[k + 1]] for a in arrays]


def count_tokens(docs: DataFrame) -> DataFrame:
    """key, pair, n: counts over all texts of each token (in lower case, or the end), pair = false; and of pairs,
    as far as tasks found them to be 1 / HOT of what they had read. Tasks count before a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, pairs, held, read = [], [], 0, 0

        def rows(key: np.ndarray, n: np.ndarray, pair: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array(key), "pair": pa.array(np.full(len(key), pair)), "n": pa.array(n)})

        def counted() -> tuple[np.ndarray, np.ndarray]:
            key, n = (np.concatenate(x) for x in zip(*kept, strict=True))
            own, back = np.unique(key, return_inverse=True)
            return own, np.bincount(back, n, len(own)).astype(np.int64)

        def likely() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(pairs), return_counts=True)
            often = n * HOT >= read
            return rows(key[often].view(np.int64), n[often].astype(np.int64), True)

        for _, data, offsets in chunks(batches):
            _, token, before = tokens_of(Words(data, offsets, folded=True))
            kept.append(np.unique(token, return_counts=True))
            pairs.append(pair_key(token, context(before)))
            held, read = held + len(kept[-1][0]), read + len(token)
            if read > FLUSH:
                yield likely()
                pairs, read = [], 0
            if held > 2 * FLUSH:
                kept, held = [counted()], 0
                if len(kept[0][0]) > FLUSH:
                    yield rows(*kept[0], False)
                    kept = []
        if read:
            yield likely()
        if kept:
            yield rows(*counted(), False)

    return texts(docs).mapInArrow(run, "key bigint, pair boolean, n bigint").groupBy("key", "pair").agg(F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """key, n over all texts of the pairs in keys (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(keys), dtype=np.int64)
        for _, data, offsets in chunks(batches):
            _, token, before = tokens_of(Words(data, offsets, folded=True))
            at = _index(keys, pair_key(token, context(before)).view(np.int64))
            n += np.bincount(at[at >= 0], minlength=len(keys))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys[some]), "n": pa.array(n[some])})

    return texts(docs).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Model:
    """N, V, and the filter and exact counts of the n-grams that are broadcast."""

    def __init__(self, tokens: int, distinct: int, once: int, hot: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], prior: float):
        self.tokens, self.distinct, self.once, self.prior = tokens, distinct, max(1, once), prior
        self.keys, self.counts = hot
        self.filter = Filter(np.r_[hot[0], pairs[0]].view(_U), np.r_[hot[1], pairs[1]])
        self.dealer = Dealer(tokens // TASK_TOKENS + 1, tokens, *hot)

    def log(self, pair: np.ndarray, single: np.ndarray) -> np.ndarray:
        """log10 of P(w | v)'s numerator and of the denominator that w has where it comes before another token."""
        p = np.where(single > 0, single, self.once) / (self.tokens + self.once)
        return np.log10(pair + self.prior * p) - np.log10(single + self.prior)


def train(docs: DataFrame, prior: float = PRIOR) -> Model:
    """Fit on all rows of docs. The driver gets N, V and at most HOT tokens and HOT pairs with their counts."""
    counted = cut_lineage(count_tokens(docs))
    few = counted.where("not pair").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct"), F.count_if(F.col("n") == 1).alias("once")).first()
    hot = counted.where(F.col("n") * HOT >= few.tokens)
    column = lambda rows, k: np.array([r[k] for r in rows], dtype=np.int64)
    tokens = sorted((r.key, r.n) for r in hot.where("not pair").collect())
    keys = np.sort(column(hot.where("pair").select("key").collect(), 0))
    pairs = sorted((r.key, r.n) for r in count_pairs(docs, keys).collect()) if len(keys) else []
    return Model(int(few.tokens), int(few.distinct), int(few.once), (column(tokens, 0), column(tokens, 1)), (column(pairs, 0), column(pairs, 1)), prior)


def lm_score(docs: DataFrame, model: Model, trained: Column, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, n_tokens, n_known, base_sum and score of every text.

    trained says which rows of docs the model was fitted on: all of those must be there, as the shards learn
    from them. base_sum is the sum of log10(count + 1); the base score follows from it, N and V.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = texts(steady(docs), *keep, trained.alias(unused(docs, "trained")))
    own = [f for f in source.schema if f.name != "text"]
    kinds = {f"x{k}": (to_arrow_type(f.dataType), f.dataType.simpleString()) for k, f in enumerate(own)}
    kinds |= {"part": (pa.int32(), "int"), "data": (pa.binary(), "binary")}
    kinds |= {c: (pa.int64(), "bigint") for c in ("uid", "n_tokens", "n_known")} | {c: (pa.float64(), "double") for c in ("base_sum", "score")}
    fields = ", ".join(f"{c} {k[1]}" for c, k in kinds.items())
    parts = model.dealer.shards

    def row(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_pydict({c: columns[c] if isinstance(columns.get(c), (pa.Array, pa.ChunkedArray)) else pa.array(columns[c], k[0]) if c in columns else pa.nulls(n, k[0]) for c, k in kinds.items()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, uid = shared.value, TaskContext.get().partitionId() << 33
        base, kept, held = uid, [], 0

        def send() -> pa.RecordBatch:
            token, ctx, doc = (np.concatenate(x) for x in zip(*kept, strict=True))
            rows = [(k, _packed(base, *a)) for k, a in _slices(model.dealer.shard(token, ctx), parts, token, ctx, doc)]
            return row(part=[k for k, _ in rows], data=[x for _, x in rows])

        for part, data, offsets in chunks(batches):
            words = Words(data, offsets, folded=True)
            of, token, before = tokens_of(words)
            n, ctx = part.num_rows, context(before)
            fitted = part.column(own[-1].name).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
            # pairs in the broadcast filter are scored here: their tokens are in it too
            pair = model.filter.count(pair_key(token, ctx))
            at = np.full(len(token), -1)
            at[pair > 0] = _index(model.keys, token[pair > 0])
            here, rest = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            hot, back = np.unique(token[here], return_inverse=True)
            single = model.filter.count(hot.view(_U))[back]
            own_sum = lambda x: np.bincount(of[here], x, n)
            kept.append((token[rest], ctx[rest], (of[rest] + (uid - base)) * 2 + fitted[of[rest]]))
            held += len(rest)
            ids = uid + np.arange(n)
            yield row(
                part=(ids % parts).astype(np.int32), uid=ids, n_tokens=words.counts() + 1, n_known=own_sum(None).astype(np.int64), base_sum=own_sum(np.log10(model.counts[at[here]] + 1.0)),
                score=own_sum(model.log(pair[here], single)), **{f"x{k}": part.column(f.name) for k, f in enumerate(own)},
            )
            uid += n
            if held >= FLUSH:
                yield send()
                base, kept, held = uid, [], 0
        if held:
            yield send()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = shared.value, []
        for batch in batches:
            blob = batch.column("data")
            if blob.null_count:
                yield batch.filter(blob.is_null())
            kept += blob.drop_null().to_pylist()
        if not kept:
            return
        # the shard's n-grams of training texts: pairs, and tokens that aren't broadcast
        keys, singles = [], []
        for x in kept:
            _, token, ctx, doc = _unpacked(x)
            fitted = np.flatnonzero(doc & 1)
            keys.append(pair_key(token[fitted], ctx[fitted]))
            singles.append(token[fitted])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        known, c = np.unique(np.concatenate(singles), return_counts=True)
        rare = _index(model.keys, known) < 0
        known, c = known[rare], c[rare]
        del keys, singles
        grams = Filter(np.r_[key, known.view(_U)], np.r_[n, c])
        del key, n
        found, some, held = [], [], 0
        for k, blob in enumerate(kept, 1):
            head, token, ctx, doc = _unpacked(blob)
            some.append((token, ctx, (doc >> 1) + head))
            held += len(token)
            if held < FLUSH // 2 and k < len(kept):
                continue
            token, ctx, uid = (np.concatenate(x) for x in zip(*some, strict=True))
            some, held = [], 0
            one, back = np.unique(token, return_inverse=True)
            exact, single = np.zeros(len(one), dtype=np.int64), grams.count(one.view(_U))
            for own_keys, counts in ((model.keys, model.counts), (known, c)):
                at = _index(own_keys, one)
                exact[at >= 0] = counts[at[at >= 0]]
                if own_keys is model.keys:
                    single[at >= 0] = model.filter.count(one[at >= 0].view(_U))
            score = model.log(grams.count(pair_key(token, ctx)), single[back])
            who, at = np.unique(uid, return_inverse=True)
            sums = np.zeros(len(who), dtype=_SUM)
            sums["uid"], sums["known"], sums["score"] = who, np.bincount(at, (exact > 0)[back], len(who)), np.bincount(at, score, len(who))
            sums["base"] = np.bincount(at, np.log10(exact + 1.0)[back], len(who))
            found.append(sums)
        x = np.concatenate(found)
        rows = list(_slices(x["uid"] % parts, parts, np.arange(len(x))))
        yield row(part=[k for k, _ in rows], data=[x[a].tobytes() for _, (a,) in rows])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, found = [], [np.zeros(0, dtype=_SUM)]
        for batch in batches:
            blob = batch.column("data")
            found += [np.frombuffer(b, dtype=_SUM) for b in blob.drop_null().to_pylist()]
            whole.append(batch.filter(blob.is_null()))
        rows = pa.Table.from_batches(whole).combine_chunks() if whole else None
        if not rows:
            return
        uid, add = rows.column("uid").to_numpy(), np.concatenate(found)
        order = np.argsort(uid)
        at = order[np.searchsorted(uid[order], add["uid"])] if len(add) else np.zeros(0, dtype=np.int64)
        for name, part in (("n_known", "known"), ("base_sum", "base"), ("score", "score")):
            x = rows.column(name).to_numpy() + np.bincount(at, add[part], len(uid))
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(x.astype(np.int64) if part == "known" else x))
        yield from rows.to_batches()

    out = source.mapInArrow(read, fields).repartitionById(parts, "part").mapInArrow(probe, fields).repartitionById(parts, "part").mapInArrow(total, fields)
    return out.select(*(F.col(f"x{k}").alias(f.name) for k, f in enumerate(own[:-1])), "n_tokens", "n_known", "base_sum", "score")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 7) == 2)
    model = train(docs.where(~F.col("held_out")))
    out = lm_score(docs, model, ~F.col("held_out"), "held_out")
    base = F.col("base_sum") - F.col("n_tokens") * float(np.log10(model.tokens + model.distinct + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
