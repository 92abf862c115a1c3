"""Near-duplicate classes by DartMinHash signatures, banded, with exact verification.

A text is the multiset of its five-word shingles; the weight of a shingle is its count. Darts are thrown at
the regions (shingle, unit of weight) as a Poisson process along the rank axis, hashed from the region alone,
so equal regions get equal darts in every text; of the darts within a text's weight the one of least rank
at each of SIGNATURE coordinates is kept. About k ln k + 2k darts fill a signature whatever the text's length,
and the share of equal coordinates estimates the weighted Jaccard similarity. Bands of ROWS coordinates
propose pairs, exact similarity of SIMILARITY or more links them, and linked texts form classes. At a
similarity of 0.8 a pair shares no band with probability 4e-4, at 0.85 with 5e-6.

Equal texts are one node from the start. A band that up to SMALL different texts share proposes their pairs.
In a larger one every text is compared with the band's pivot, its least text, and linked texts form classes.
Texts outside the pivot's class are then compared with all others of the band, in blocks of about BLOCK texts,
of which only a spanning forest of links is returned: no partner is left out, and a band of n near copies
takes n comparisons.

Cases: null or empty texts, and those without a word, are classes of their own; a text of fewer than five
words is one shingle, all its words; repeated rows and equal texts share a class; a null doc_id joins a class
like any other; an id that isn't an integer is ordered by a hash of it where one document is kept; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, cut_lineage, mix, order_id, table, texts, unused
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
SIGNATURE, ROWS = 156, 6
SMALL, BLOCK = 24, 512
#: Bytes of a block's bit sets; longer texts are compared pair by pair.
BIT_BYTES = 64 << 20
_U = np.uint64


def regions(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The text, and a hash of (shingle, occurrence), of every unit of weight; sorted by both."""
    at, h = words.runs(SHINGLE)
    rows = np.searchsorted(words.first, at, side="right") - 1
    count = words.counts()
    for n in range(1, SHINGLE):
        short = np.flatnonzero(count == n)
        if len(short):
            pos, g = words.runs(n)
            keep = np.isin(pos, words.first[short])
            keep &= count[np.searchsorted(words.first, pos, side="right") - 1] == n
            rows, h = np.r_[rows, np.searchsorted(words.first, pos[keep], side="right") - 1], np.r_[h, g[keep]]
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, dtype=bool)
    start = np.flatnonzero(new)
    occurrence = np.arange(len(h)) - np.repeat(start, np.diff(np.r_[start, len(h)]))
    h = mix(h + occurrence.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return rows, h


def signatures(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n x SIGNATURE dart hashes; rows without regions are 0."""
    out = np.zeros((n, SIGNATURE), dtype=np.uint64)
    weight = np.bincount(rows, minlength=n)
    want = SIGNATURE * np.log(SIGNATURE) + 2 * SIGNATURE
    lo, hi = np.zeros(n), want / np.maximum(weight, 1)
    todo = weight > 0
    best = np.full(n * SIGNATURE, np.inf)
    while todo.any():  # a second throw reaches further for the few signatures with a gap
        live = np.flatnonzero(todo[rows])
        doc, element = rows[live], h[live]
        rank, dart = np.zeros(len(live)), element
        keys, ranks, marks = [], [], []
        while len(doc):
            dart = mix(dart + _U(0x9E3779B97F4A7C15))
            rank = rank - np.log(((dart >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            near = rank <= hi[doc]
            doc, dart, rank = doc[near], dart[near], rank[near]
            fresh = rank > lo[doc]
            mark = mix(dart[fresh] ^ _U(0xA0761D6478BD642F))
            keys.append(doc[fresh] * SIGNATURE + ((mark >> _U(32)) % _U(SIGNATURE)).astype(np.int64))
            ranks.append(rank[fresh])
            marks.append(mark)
        key, rank, mark = np.concatenate(keys), np.concatenate(ranks), np.concatenate(marks)
        order = np.lexsort((mark, rank, key))
        key, rank, mark = key[order], rank[order], mark[order]
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, dtype=bool)
        key, rank, mark = key[first], rank[first], mark[first]
        gap = np.isinf(best[key])
        best[key[gap]], out.reshape(-1)[key[gap]] = rank[gap], mark[gap]
        todo &= np.isinf(best.reshape(n, SIGNATURE)).any(axis=1)
        lo, hi = np.where(todo, hi, lo), np.where(todo, hi * 2, hi)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature."""
    wide = signature.reshape(len(signature), SIGNATURE // ROWS, ROWS)
    h = np.broadcast_to(mix(np.arange(wide.shape[1], dtype=np.uint64)), wide.shape[:2])
    for k in range(ROWS):
        h = mix(h * _U(0x9E3779B97F4A7C15) + wide[:, :, k])
    return h.view(np.int64)


def _text_key():
    return F.unhex(F.md5("text")).alias("th")


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, th (a key of the text) and bands, null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            rows, h = regions(Words(data, offsets))
            n = part.num_rows
            b = bands(signatures(rows, h, n))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * b.shape[1]), pa.array(b.reshape(-1)))
            empty = np.bincount(rows, minlength=n) == 0
            got = pa.array([None if e else x for e, x in zip(empty, flat.to_pylist(), strict=True)], pa.list_(pa.int64())) if empty.any() else flat
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "th": part.column("th"), "bands": got})

    source = texts(docs).select("doc_id", "text", _text_key())
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, th binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """th, shingles (sorted 64-bit hashes) of the texts with a key in wanted, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            rows, h = regions(Words(data, offsets))
            h = h[np.lexsort((h, rows))]
            cut = np.searchsorted(rows, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_pydict({"th": part.column("th"), "shingles": pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})

    source = texts(docs).select("text", _text_key()).join(wanted.select("th").distinct(), "th", "left_semi")
    return source.mapInArrow(run, "th binary, shingles binary").dropDuplicates(["th"])


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def verify_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            good = [_similarity(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) >= similarity for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("u", "v")}).filter(pa.array(good, pa.bool_()))

    rows = pairs.join(sets.select(F.col("th").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("th").alias("v"), F.col("shingles").alias("b")), "v")
    return rows.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def forest(sets: list[np.ndarray], left: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; with both sides present, of links across them only.

    left marks one side; where all are on one side every pair counts.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    everything = np.concatenate(sets) if m else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(m), size)
    vocabulary, code, count = np.unique(everything, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[code]
    width = (int(shared.sum()) + 63) // 64
    packed = m * width * 8 <= BIT_BYTES
    if packed:
        bits = np.zeros((m, max(1, width)), dtype=np.uint64)
        col = column[code[keep]]
        np.bitwise_or.at(bits, (owner[keep], col >> 6), _U(1) << (col & 63).astype(np.uint64))
    root = np.arange(m)
    links = []
    one_side = left.all() or not left.any()
    for i in range(m):
        others = np.flatnonzero((root != root[i]) & ((np.arange(m) > i) if one_side else (left != left[i])))
        others = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i])]
        if len(others):
            both = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64) if packed else np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others])
            hit = others[both >= similarity * (size[others] + size[i] - both) - 1e-9]
            for j in hit:
                if root[j] != root[i]:
                    links.append((i, int(j)))
                    root[root == root[j]] = root[i]
    return links


def verify_blocks(hot: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between open texts of large bands, and between open and other ones.

    hot: key, th, open, n_open and n_other, where n_open > 0.
    """
    opens, others = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_open", "n_other"))
    b = F.pmod(F.xxhash64("th", "key"), F.when(F.col("open"), opens).otherwise(others)).cast("int")
    pair = lambda cross, lo, hi, left: F.struct(F.lit(cross).alias("cross"), lo.alias("lo"), hi.alias("hi"), left.alias("left"))
    every = lambda n, make: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast("array<struct<cross:boolean,lo:int,hi:int,left:boolean>>"))
    among = every(opens, lambda j: pair(False, F.least(b, j), F.greatest(b, j), b <= j))
    across = every(others, lambda j: pair(True, b, j, F.lit(True)))
    tasks = F.when(F.col("open"), F.concat(among, across)).otherwise(every(opens, lambda i: pair(True, i, b, F.lit(False))))
    rows = hot.select("key", "th", F.explode(tasks).alias("t")).select("key", "t.*", "th").join(sets, "th")

    def run(group: pa.Table) -> pa.Table:
        th, left = group.column("th").to_pylist(), np.array(group.column("left").to_pylist(), dtype=bool)
        links = forest([np.frombuffer(x, dtype=np.uint64) for x in group.column("shingles").to_pylist()], left, similarity)
        return pa.table({"u": pa.array([th[i] for i, _ in links], pa.binary()), "v": pa.array([th[j] for _, j in links], pa.binary())})

    return rows.groupBy("key", "cross", "lo", "hi").applyInArrow(run, "u binary, v binary")


def open_texts(large: DataFrame, roots: DataFrame) -> DataFrame:
    """key, th, open, n_open and n_other of the large bands that have texts outside their pivot's class."""
    root = lambda of, name: roots.select(F.col("node").alias(of), F.col("root").alias(name))
    pivots = large.select("key", "pivot").distinct().join(root("pivot", "pivot_root"), "pivot", "left")
    # joined by another key than it was grouped by, so that Spark may split a band of very many texts
    pivots = pivots.select(F.bitwise_not("key").alias("band"), F.coalesce("pivot_root", "pivot").alias("pivot_root"))
    rows = large.select("key", "th").join(root("th", "root"), "th", "left").withColumn("band", F.bitwise_not("key")).join(pivots, "band")
    rows = cut_lineage(rows.select("band", "key", "th", (F.coalesce("root", "th") != F.col("pivot_root")).alias("open")))
    count = rows.groupBy("key").agg(F.count_if("open").alias("n_open"), F.count_if(~F.col("open")).alias("n_other")).where("n_open > 0")
    return rows.join(count.select(F.bitwise_not("key").alias("band"), "n_open", "n_other"), "band").drop("band")


def near_roots(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th, root of every row: root is a key of its class, whatever the doc_ids."""
    signed = cut_lineage(sign(docs))
    nodes = signed.where("bands is not null").groupBy("th").agg(F.first("bands").alias("bands"))
    nodes = cut_lineage(nodes)
    members = nodes.select("th", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min("th").alias("pivot")).where("n > 1")
    members = cut_lineage(members.join(shared, "key"))
    small = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("th")).alias("ths"))
    pairs = small.select(F.posexplode("ths").alias("i", "u"), "ths").select("u", F.explode(F.slice("ths", F.col("i") + 2, SMALL)).alias("v"))
    large = members.where(F.col("n") > SMALL)
    pairs = cut_lineage(pairs.unionByName(large.where("th <> pivot").select(F.col("pivot").alias("u"), F.col("th").alias("v"))).distinct())
    sets = shingle_sets(docs, members)
    roots = components(verify_pairs(pairs, sets, similarity))
    hot = cut_lineage(open_texts(large, roots))
    if not hot.isEmpty():
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(verify_blocks(hot, sets, similarity))
        roots = components(links)
    named = nodes.select("th").join(roots.withColumnRenamed("node", "th"), "th", "left").withColumn("root", F.coalesce("root", "th"))
    # with a hash in the key both sides are dealt anew, and Spark may split a text of very many copies
    key = F.xxhash64("th").alias("h")
    worded = signed.where("bands is not null").select("doc_id", "th", key).join(named.select("*", key), ["h", "th"]).select("doc_id", "th", "root")
    # a text without words is in a class with its equals of the same doc_id only; 17 bytes, where a text key has 16
    alone = F.concat(F.unhex(F.md5(F.concat_ws(" ", F.hex("th"), F.col("doc_id").cast("string")))), F.lit(b"\0"))
    return worded.unionByName(signed.where("bands is null").select("doc_id", "th", alone.alias("root")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th, class_id of every row: class_id is the least doc_id of its class.

    Where that is null, or the least of another class too, class_id is made from the class: a negative number,
    or a text where doc_id is one.
    """
    rooted = cut_lineage(near_roots(docs, similarity))
    own = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    same = own.groupBy("least").agg(F.count("*").alias("n"))
    made = F.concat(F.lit("class-"), F.hex("root")) if dict(docs.dtypes)["doc_id"] == "string" else F.xxhash64("root").bitwiseOR(F.lit(-(2**63)))
    named = own.join(same.where("n = 1 and least is not null"), "least", "left").select("root", F.when(F.col("n").isNull(), made).otherwise(F.col("least")).alias("class_id"))
    return rooted.join(named, "root").select("doc_id", "th", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one document of each class, the one with the least doc_id and text key.

    Rows without words count as one class where their doc_id and text are equal.
    """
    i, t = unused(docs, "order"), unused(docs, "key")
    named = near_roots(docs)
    kept = named.select(order_id(docs).alias(i), F.col("th").alias(t), "root").groupBy("root").agg(F.min(F.struct(i, t)).alias("k")).select(f"k.{i}", f"k.{t}")
    rows = docs.withColumns({i: order_id(docs), t: F.unhex(F.md5(F.coalesce("text", F.lit(""))))})
    return rows.join(kept, [i, t], "left_semi").dropDuplicates([i, t]).drop(i, t)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
