"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item has two 64-bit SimHashes of its words: of its head and of its tail of as many words as the
largest size of a grid that is at most SIMILARITY of the item's. Every window of a text of a size that an item
has is fingerprinted, from running sums of the words' votes. Fingerprints within RADIUS bits of an item's are
all found by a multi-index: of BLOCKS blocks of 16 bits one differs in RADIUS // BLOCKS bits at most, and the index lists
each item under all such values. The item's window around it is then verified by the weighted Jaccard
similarity of five-word shingles. That a similar window lies within RADIUS is likely, not sure; so windows
that share as many shingles with an item as SIMILARITY needs are verified too, and none is lost to its fingerprint.

Words are compared in lower case.

Cases: null or empty texts, and items of no word, match nothing; an item of fewer than five words is one
shingle, all its words; a text shorter than an item is one window; equal items are reported each; repeated rows
of documents are searched row by row; an empty benchmark gives no rows; other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, chunks, mix, table, texts, unused

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 11, 4
#: The benchmark is sent to all workers up to this many bytes of text; beyond, it is searched in parts of this size.
PART_BYTES = 8 << 20
#: Words whose votes are held at once.
RUN = 1 << 16
_BITS = np.arange(64, dtype=np.uint64)
#: All 16-bit values with at most RADIUS // BLOCKS bits set.
_NEAR = np.array([x for x in range(1 << 16) if x.bit_count() <= RADIUS // BLOCKS], dtype=np.uint64)
_GRID = np.unique(np.round(2.0 ** (np.arange(61) / 2)).astype(np.int64))


def votes(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the words' votes, +1 or -1 for each bit; they may wrap around, their differences don't."""
    signs = np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int16) * np.int16(2) - np.int16(1)
    out = np.zeros((len(hashes) + 1, 64), dtype=np.int16)
    np.cumsum(signs, axis=0, out=out[1:])
    return out


def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of `size` words."""
    return np.packbits(sums[size:] - sums[:-size] > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(hashes: np.ndarray) -> int:
    return int(windows(votes(hashes), len(hashes))[0])


class Index:
    """Fingerprints of one size, listed by every value near each of their blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.blocks = prints, []
        for k in range(BLOCKS):
            key = (((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF))[:, None] ^ _NEAR).ravel().astype(np.int64)
            order = np.argsort(key, kind="stable")
            self.blocks.append((np.r_[0, np.cumsum(np.bincount(key, minlength=1 << 16))], (order // len(_NEAR)).astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, fingerprint) pairs within RADIUS bits."""
        found = []
        for k, (start, listed) in enumerate(self.blocks):
            key = ((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            n = start[key + 1] - start[key]
            who = np.flatnonzero(n)
            n = n[who]
            at = np.repeat(start[key[who]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            who, which = np.repeat(who, n), listed[at]
            close = np.bitwise_count(prints[who] ^ self.prints[which]) <= RADIUS
            found.append(who[close] * len(self.prints) + which[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


class Benchmark:
    """Items by their fingerprints and by their shingles."""

    def __init__(self, ids: list, item_texts: list[str]):
        raw = [t.encode() for t in item_texts]
        offsets = np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64)
        words = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
        self.ids, self.size = ids, words.counts()
        self.shingles: list[dict[int, int]] = []
        grams, owners, parts = [], [], {}
        for k in range(len(ids)):
            h = words.hash[words.first[k] : words.first[k + 1]]
            g = shingle_hashes(h)
            u, c = np.unique(g, return_counts=True)
            self.shingles.append(dict(zip(u.tolist(), c.tolist(), strict=True)))
            if len(h):
                size = int(_GRID[_GRID <= max(1, SIMILARITY * len(h))][-1])
                for shift in {0, len(h) - size}:
                    parts.setdefault(size, []).append((simhash(h[shift : shift + size]), k, shift))
            grams.append(u)
            owners.append(np.full(len(u), k))
        #: By size: fingerprints, their items, and where in the item each begins.
        self.parts = {size: (np.array([x[0] for x in rows], dtype=np.uint64), *(np.array([x[j] for x in rows]) for j in (1, 2))) for size, rows in sorted(parts.items())}
        self.indexes: dict[int, Index] = {}
        grams = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owners = grams[order], (np.concatenate(owners) if owners else np.zeros(0, dtype=int))[order]
        #: A small table of 20 hash bits: most words of a text are dismissed by one look at it.
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        self.short = sorted({int(s) for s in self.size if 0 < s < SHINGLE})

    def __getstate__(self) -> dict:
        return self.__dict__ | {"indexes": {}}  # workers make them anew: they are larger than the fingerprints

    def anchors(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions at which an item's shingle begins, and the item; a row for each pair."""
        at, h = [], []
        for n in [SHINGLE, *self.short]:
            pos, g = words.runs(n)
            hit = np.flatnonzero(self.seen[(g >> np.uint64(44)).astype(np.int64)])
            at.append(pos[hit])
            h.append(g[hit])
        at, h = np.concatenate(at), np.concatenate(h)
        lo, hi = np.searchsorted(self.grams, h, "left"), np.searchsorted(self.grams, h, "right")
        n = hi - lo
        skip = np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owners[np.repeat(lo, n) + np.arange(n.sum()) - skip]

    def fingerprinted(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and item of the windows whose fingerprint is near an item's."""
        starts, items = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        last = np.repeat(words.first[1:], words.counts())
        for lo in range(0, len(words), RUN):
            sums = votes(words.hash[lo : lo + RUN + max(self.parts, default=0)])
            for size, (prints, owner, shift) in self.parts.items():
                if size not in self.indexes:
                    self.indexes[size] = Index(prints)
                if len(sums) <= size:
                    continue
                at = np.arange(lo, min(lo + RUN, lo + len(sums) - size))
                at = at[at + size <= last[at]]
                window, which = self.indexes[size].near(windows(sums, size)[at - lo])
                starts.append(at[window] - shift[which])
                items.append(owner[which])
                # the item's window may not leave the text that the fingerprint is in
                text = np.searchsorted(words.first, at[window], side="right") - 1
                m = np.minimum(self.size[owner[which]], words.first[text + 1] - words.first[text])
                starts[-1] = np.clip(starts[-1], words.first[text], words.first[text + 1] - m)
        return np.concatenate(starts), np.concatenate(items)

    def sharing(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and item of the windows that share as many shingles with an item as SIMILARITY needs."""
        at, item = self.anchors(words)
        text = np.searchsorted(words.first, at, side="right") - 1
        lo, hi = words.first[text], words.first[text + 1]
        # the windows of the item's size that hold the shingle; a text shorter than the item is one window
        size = np.minimum(self.size[item], hi - lo)
        room = np.minimum(SHINGLE, self.size[item])
        begin, end = np.maximum(at + room - size, lo), np.minimum(at, hi - size)
        n = np.maximum(end - begin + 1, 0)
        start = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs, common = np.unique(start * len(self.ids) + np.repeat(item, n), return_counts=True)
        s, k = pairs // len(self.ids), pairs % len(self.ids)
        owner = np.searchsorted(words.first, s, side="right") - 1
        m = np.minimum(self.size[k], words.first[owner + 1] - words.first[owner])
        # similarity x of windows of a and b shingles needs x / (1 + x) * (a + b) common ones
        total = np.maximum(m - SHINGLE + 1, 1) + np.maximum(self.size[k] - SHINGLE + 1, 1)
        enough = common * (1 + SIMILARITY) >= SIMILARITY * total - 1e-6
        return s[enough], k[enough]

    def search(self, words: Words) -> list[tuple[int, int, int, float]]:
        """(text, item, first word of the best window in the text, similarity), a row for each text and item."""
        if not len(words):
            return []
        found = [self.fingerprinted(words), self.sharing(words)]
        pairs = np.unique(np.concatenate([s * len(self.ids) + k for s, k in found]))
        s, k = pairs // len(self.ids), pairs % len(self.ids)
        owner = np.searchsorted(words.first, s, side="right") - 1
        m = np.minimum(self.size[k], words.first[owner + 1] - words.first[owner])
        # a window can't be similar with fewer of any item's shingles than its own item needs
        at, h = words.runs(SHINGLE)
        grams = np.zeros(len(words), dtype=np.uint64)
        grams[at] = h
        known = np.flatnonzero(self.seen[(grams >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.grams, grams[known]), max(0, len(self.grams) - 1))
        listed = np.zeros(len(words) + 1, dtype=np.int64)
        listed[known + 1] = self.grams[place] == grams[known] if len(self.grams) else 0
        listed = np.cumsum(listed)
        wide = (m >= SHINGLE) & (self.size[k] >= SHINGLE)
        most = np.where(wide, listed[s + np.maximum(m - SHINGLE + 1, 0)] - listed[s], m)
        total = np.maximum(m - SHINGLE + 1, 1) + np.maximum(self.size[k] - SHINGLE + 1, 1)
        keep = ~wide | (most * (1 + SIMILARITY) >= SIMILARITY * total - 1e-6)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for t, s, m, k, w in zip(*(x[keep].tolist() for x in (owner, s, m, k, wide)), strict=True):
            sim = self.similarity(grams[s : s + m - SHINGLE + 1] if w else shingle_hashes(words.hash[s : s + m]), k)
            if sim >= SIMILARITY and (-sim, s) < best.get((t, k), (1.0, 0)):
                best[t, k] = (-sim, s)
        return [(t, k, s - int(words.first[t]), -sim) for (t, k), (sim, s) in sorted(best.items())]

    def similarity(self, shingles: np.ndarray, item: int) -> float:
        own = self.shingles[item]
        count = Counter(x for x in shingles.tolist() if x in own)
        both = sum(min(n, own[g]) for g, n in count.items())
        return both / max(1, len(shingles) + sum(own.values()) - both)


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of one run of words; a shorter run is one shingle."""
    if not len(h):
        return h
    offsets = np.array([0, 0])
    one = Words(np.zeros(0, dtype=np.uint8), offsets)
    one.hash, one.starts, one.first = h, np.zeros(len(h)), np.array([0, len(h)])
    return one.runs(min(SHINGLE, len(h)))[1]


def loaded(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """The benchmark as broadcasts, each of PART_BYTES of text or so."""
    size = benchmark.selectExpr("coalesce(sum(length(text)), 0) as n").first().n
    parts = 1 + int(size) // PART_BYTES
    for k in range(parts):
        items = benchmark.where("text is not null").select("item_id", F.lower("text").alias("text"))
        if parts > 1:
            items = items.where(f"pmod(xxhash64(item_id, text), {parts}) = {k}")
        rows = items.orderBy("item_id", "text").collect()
        yield docs.sparkSession.sparkContext.broadcast(Benchmark([r.item_id for r in rows], [r.text for r in rows]))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no window similar to an item; nothing is shuffled."""
    for shared in loaded(docs, benchmark):
        lower = unused(docs, "lower")
        named = docs.withColumn(lower, F.lower(F.coalesce("text", F.lit(""))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, lower=lower) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for part, data, offsets in chunks(batches, lower):
                found = bench.search(Words(data, offsets)) if len(bench.ids) else []
                clean = np.ones(part.num_rows, dtype=bool)
                clean[[t for t, *_ in found]] = False
                yield part.drop_columns([lower]).filter(pa.array(clean))

        docs = named.mapInArrow(run, docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, item_id, first_word, n_words and similarity of every text's best window
    for each item that it holds."""
    source = texts(docs, *keep).withColumn("text", F.lower("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text"]
    kind = benchmark.schema["item_id"].dataType
    schema = ", ".join([*fields, f"item_id {kind.simpleString()}, first_word bigint, n_words bigint, similarity double"])
    out = None
    for shared in loaded(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for part, data, offsets in chunks(batches):
                found = bench.search(Words(data, offsets)) if len(bench.ids) else []
                if found:
                    text, item, first, sim = zip(*found, strict=True)
                    rows = part.take(pa.array(text, pa.int64()))
                    cols = {n: rows.column(n) for n in rows.schema.names if n != "text"}
                    cols |= {"item_id": pa.array([bench.ids[i] for i in item], to_arrow_type(kind)), "first_word": pa.array(first, pa.int64()), "n_words": pa.array([int(bench.size[i]) for i in item], pa.int64()), "similarity": pa.array(sim, pa.float64())}
                    yield pa.RecordBatch.from_pydict(cols)

        got = source.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_words", "similarity")
