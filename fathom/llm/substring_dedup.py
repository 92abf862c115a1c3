"""Substring dedup: prefix-partitioned sorted suffixes, whose deep shared nodes are the repeats.

Only suffixes cut at DEPTH words matter, as a repeat is a node of at least that depth. In every DEPTH words
the five-word run of least hash is the anchor; equal suffixes have equal anchors, so suffixes are dealt by
the words of their anchor, and neighbouring suffixes with one anchor travel as one stretch of words.

1. Anchors that occur once belong to no repeat and are dropped; the rest are counted.
2. Stretches with a repeated anchor are dealt by its five words. Where more than HEAVY stretches share those,
   the prefix is lengthened: each suffix travels alone, dealt by all its DEPTH words.
3. Each group's suffixes are sorted by their words. Neighbours that agree to DEPTH words meet in a node of
   the suffix tree at that depth or below; all its leaves but the earliest are repeats.
4. Repeats are joined back to their texts; the words they cover go.

Stretches travel as the bytes of their words, so that equality of words, not of hashes, decides. Stretches
that are equal within a chunk of texts are dealt once, with their earliest place; the later ones are repeats
already. So a passage that a third of all documents share makes a row for each chunk.

Cases: null or empty texts have no words; texts shorter than DEPTH words keep all; rows equal in doc_id and
text are one document and keep the same words; a null doc_id comes before all others; ids that aren't
integers are ordered by a hash; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, mix, order_id, table, text_bytes, texts

DEPTH, ANCHOR = 20, 5
#: Stretches that share an anchor before its prefix is lengthened.
HEAVY = 50_000
#: Rows of arrays that a task gathers before it deals them out; bytes of text for each task.
FLUSH, TASK_BYTES = 1_000_000, 24 << 20
_SPAN = DEPTH - ANCHOR + 1
_U = np.uint64
_CAND = np.dtype([("hash", "u8"), ("doc", "i8"), ("start", "i4"), ("many", "i4")])
_PLACE = np.dtype([("doc", "i8"), ("place", "i4")])
_HEAD = np.dtype([("key", "u8"), ("id", "i8"), ("doc", "i8"), ("start", "i4"), ("n", "i4")])


def stretches(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, first word in it, number of suffixes, and hash of the anchor, of each stretch."""
    n, total = words.counts(), len(words)
    none = np.zeros(0, dtype=np.int64)
    if total < DEPTH:
        return none, none, none, np.zeros(0, dtype=np.uint64)
    h = mix(words.hash + _U(1))
    gram = h[: total - ANCHOR + 1].copy()
    for k in range(1, ANCHOR):
        gram = mix(gram * _U(0x9E3779B97F4A7C15) + h[k : total - ANCHOR + 1 + k])
    value, place = gram, np.arange(len(gram))
    step = 1
    while step < _SPAN:  # least of 2, 4, 8, 16 runs
        take = value[step:] < value[:-step]
        value = np.where(take, value[step:], value[:-step])
        place = np.where(take, place[step:], place[:-step])
        step *= 2
    last = np.repeat(words.first[1:], n)[: len(place)]
    at = np.flatnonzero(np.arange(len(place)) + DEPTH <= last)
    if not len(at):
        return none, none, none, np.zeros(0, dtype=np.uint64)
    anchor = place[at]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    start = at[first]
    rows = np.searchsorted(words.first, start, side="right") - 1
    return rows, start - words.first[rows], np.diff(np.r_[first, len(at)]), gram[anchor[first]]


def _deal(x: np.ndarray, key: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of a structured array by key modulo parts."""
    part = (key % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(cut)):
        yield int(k), x[order[cut[k] : cut[k + 1]]]


def _places(doc: np.ndarray, place: np.ndarray, parts: int) -> pa.RecordBatch:
    """Places dealt by document: a row for each part, not for each document."""
    x = np.zeros(len(doc), dtype=_PLACE)
    x["doc"], x["place"] = doc, place
    rows = list(_deal(x, mix(x["doc"].view(np.uint64)), parts))
    return pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in rows], pa.int32()), "data": pa.array([y.tobytes() for _, y in rows], pa.binary())})


def _by_document(dealt: DataFrame, parts: int) -> DataFrame:
    """dk, places (int32 array as bytes): one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.frombuffer(b, dtype=_PLACE) for batch in batches for b in batch.column("data").to_pylist()]
        if not kept:
            return
        x = np.concatenate(kept)
        x = x[np.argsort(x["doc"], kind="stable")]
        who, first = np.unique(x["doc"], return_index=True)
        bounds = np.r_[first, len(x)]
        for lo in range(0, len(who), 5000):
            hi = min(lo + 5000, len(who))
            yield pa.RecordBatch.from_pydict({"dk": pa.array(who[lo:hi], pa.int64()), "places": pa.array([x["place"][bounds[k] : bounds[k + 1]].tobytes() for k in range(lo, hi)], pa.binary())})

    return dealt.repartitionById(parts, "part").mapInArrow(run, "dk bigint, places binary")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, dk (a key of doc_id and text) and text."""
    return texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text")


def repeated_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """dk, places: 2 * start + heavy of each stretch whose anchor occurs again."""

    def send(kept: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(kept)
        x = x[np.argsort(x["hash"], kind="stable")]
        first = np.flatnonzero(np.r_[True, x["hash"][1:] != x["hash"][:-1]])
        n = np.diff(np.r_[first, len(x)])
        x["many"] = np.repeat(n, n)
        # of very many equal anchors in this task one row is counted; the others' places need no proof
        heavy, lead = x["many"] > HEAVY // 16, np.zeros(len(x), dtype=bool)
        lead[first] = True
        counted, sure = x[lead | ~heavy], x[heavy & ~lead]
        rows = [(b, 0, y) for b, y in _deal(counted, counted["hash"], parts)] + [(b, 1, y) for b, y in _deal(sure, sure["doc"].view(np.uint64), parts)]
        return pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "sure": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2].tobytes() for r in rows], pa.binary())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for part, data, offsets in chunks(batches):
            rows, start, _, anchor = stretches(Words(data, offsets))
            x = np.zeros(len(rows), dtype=_CAND)
            x["hash"], x["doc"], x["start"], x["many"] = anchor, np.asarray(part.column("dk"))[rows], start, 1
            kept.append(x)
            n += len(x)
            if n >= FLUSH:
                yield send(kept)
                kept, n = [], 0
        if n:
            yield send(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            for sure, data in zip(batch.column("sure").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(data, dtype=_CAND)
                if sure:
                    yield _places(x["doc"], x["start"] * 2 + 1, parts)
                else:
                    kept.append(x)
        if kept:
            x = np.concatenate(kept)
            x = x[np.argsort(x["hash"], kind="stable")]
            first = np.flatnonzero(np.r_[True, x["hash"][1:] != x["hash"][:-1]])
            n = np.diff(np.r_[first, len(x)])
            rows, most = np.repeat(n, n), np.repeat(np.maximum.reduceat(x["many"], first), n)
            again = (rows > 1) | (most > 1)
            heavy = (np.maximum(rows, most) > HEAVY) | (most > HEAVY // 16)
            yield _places(x["doc"][again], x["start"][again] * 2 + heavy[again], parts)

    dealt = docs.select("dk", "text").mapInArrow(read, "part int, sure int, data binary").repartitionById(parts, "part")
    return _by_document(dealt.mapInArrow(count, "part int, data binary"), parts)


def _spaced(words: Words) -> tuple[bytes, np.ndarray]:
    """All words, each with one space behind it, and where each begins; the end of the last comes last."""
    size = words.ends - words.starts + 1
    at = np.r_[0, np.cumsum(size)]
    data = np.append(words.data, np.uint8(32))
    out = data[np.repeat(words.starts - at[:-1], size) + np.arange(at[-1])]
    out[at[1:] - 1] = 32
    return out.tobytes(), at


def _pack(heads: np.ndarray, content: list[bytes], which: np.ndarray) -> bytes:
    """Heads and words of the chosen stretches as one run of bytes."""
    return np.int64(len(which)).tobytes() + heads[which].tobytes() + b"".join([content[k] for k in which.tolist()])


def repeats(keyed: DataFrame, anchors: DataFrame, parts: int) -> DataFrame:
    """dk, places: first words of all suffixes that begin earlier too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            words = Words(data, offsets)
            rows, start, n, anchor = stretches(words)
            listed = [np.frombuffer(x, dtype=np.int32) for x in part.column("places").to_pylist()]
            owner = np.repeat(np.arange(len(listed)), [len(x) for x in listed])
            marks = np.concatenate(listed).astype(np.int64)
            big = 1 << 40
            order = np.argsort(owner * big + (marks >> 1))
            want, heavy = (owner * big + (marks >> 1))[order], (marks & 1)[order].astype(bool)
            at = np.searchsorted(want, rows * big + start)
            at[at == len(want)] = 0
            use = np.flatnonzero(want[at] == rows * big + start)
            alone = heavy[at[use]]
            lone, rest = use[alone], use[~alone]
            row = np.concatenate([rows[rest], np.repeat(rows[lone], n[lone])])
            begin = np.concatenate([start[rest], np.repeat(start[lone], n[lone]) + np.arange(n[lone].sum()) - np.repeat(np.cumsum(n[lone]) - n[lone], n[lone])])
            many = np.concatenate([n[rest], np.ones(len(row) - len(rest), dtype=np.int64)])
            spaced, edge = _spaced(words)
            lo = words.first[row] + begin
            content = [spaced[i:j] for i, j in zip(edge[lo].tolist(), edge[lo + many + DEPTH - 1].tolist(), strict=True)]
            heads = np.zeros(len(row), dtype=_HEAD)
            lengthened = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in content[len(rest) :]], dtype=np.uint64)
            heads["key"] = np.concatenate([anchor[rest], lengthened])
            heads["id"], heads["doc"], heads["start"], heads["n"] = np.asarray(part.column("id"))[row], np.asarray(part.column("dk"))[row], begin, many
            # of equal stretches in this chunk the earliest is dealt, the others are repeats; rows equal in
            # doc_id and text are one document: their suffixes begin at the same places
            lead: dict[bytes, int] = {}
            firsts, later = [], []
            places = list(zip(heads["doc"].tolist(), begin.tolist(), strict=True))
            for k in np.lexsort((begin, heads["doc"], heads["id"])).tolist():
                j = lead.setdefault(content[k], k)
                if j == k:
                    firsts.append(k)
                elif places[j] != places[k]:
                    later.append(k)
            firsts = np.array(firsts, dtype=np.int64)
            group = (mix(heads["key"][firsts]) % _U(parts)).astype(np.int64)
            by = np.argsort(group, kind="stable")
            edges = np.searchsorted(group[by], np.arange(parts + 1))
            out = [(int(k), 0, _pack(heads, content, firsts[by[edges[k] : edges[k + 1]]])) for k in np.flatnonzero(np.diff(edges))]
            if later:
                out.append((later[0] % parts, 1, heads[later].tobytes()))
            yield pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in out], pa.int32()), "sure": pa.array([r[1] for r in out], pa.int32()), "data": pa.array([r[2] for r in out], pa.binary())})

    def every(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = heads["n"].astype(np.int64)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(heads)), n), inside

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, content = [], []
        for batch in batches:
            for sure, data in zip(batch.column("sure").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if sure:
                    x = np.frombuffer(data, dtype=_HEAD)
                    of, inside = every(x)
                    yield _places(x["doc"][of], x["start"][of] + inside, parts)
                else:
                    n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
                    heads.append(np.frombuffer(data, dtype=_HEAD, count=n, offset=8))
                    content.append(data[8 + n * _HEAD.itemsize :])
        if not heads:
            return
        heads, data = np.concatenate(heads), np.frombuffer(b"".join(content), dtype=np.uint8)
        del content
        # a number for each different word
        bounds = np.r_[0, np.flatnonzero(data == 32) + 1]
        words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        content = words.dictionary_encode().indices.to_numpy().astype(">u4")
        size = heads["n"].astype(np.int64) + DEPTH - 1
        base = np.cumsum(size) - size
        order = np.argsort(heads["key"], kind="stable")
        # groups of whole prefixes, a bounded number of suffixes at a time
        ends = np.cumsum(heads["n"][order].astype(np.int64))
        new = np.flatnonzero(np.r_[True, heads["key"][order][1:] != heads["key"][order][:-1]])
        bounds, lo = [0], 0
        for k in new[1:]:
            if ends[k - 1] - lo > 200_000:
                bounds.append(int(k))
                lo = ends[k - 1]
        for a, b in zip(bounds, [*bounds[1:], len(order)], strict=True):
            yield leaves(heads[order[a:b]], base[order[a:b]], content)

    def leaves(heads: np.ndarray, base: np.ndarray, content: np.ndarray) -> pa.RecordBatch:
        of, inside = every(heads)
        flat = np.ascontiguousarray(content[(base[of] + inside)[:, None] + np.arange(DEPTH)]).view(f"V{4 * DEPTH}").ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        node = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])  # neighbours that agree to the full depth share a node
        start = heads["start"][of] + inside
        ids, docs = heads["id"][of], heads["doc"][of]
        by = order[np.lexsort((start[order], docs[order], ids[order], node))]
        rank = np.sort(node)
        lead = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        first = np.repeat(by[lead], np.diff(np.r_[lead, len(by)]))
        later = by[(docs[by] != docs[first]) | (start[by] != start[first])]
        return _places(docs[later], start[later], parts)

    # the same columns as the join that deletes the words, so that texts are dealt by dk once for both
    joined = keyed.join(anchors.hint("shuffle_hash"), "dk").select(order_id(keyed).alias("id"), "dk", "text", "places")
    dealt = joined.mapInArrow(cut, "part int, sure int, data binary").repartitionById(parts, "part")
    return _by_document(dealt.mapInArrow(tree, "part int, data binary"), parts)


def substring_dedup(docs: DataFrame, outputs: tuple[str, ...] = ("text", "spans")) -> DataFrame:
    """doc_id, n_words, n_removed and the outputs asked for, of every row.

    outputs: text (kept words joined by one space), spans (first word and length of each removed run,
    as arrays of two), kept_sha256 (of that text in UTF-8).
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes(docs) // TASK_BYTES + 1)
    keyed = _keyed(docs)
    found = repeats(keyed, repeated_anchors(keyed, parts), parts)
    joined = keyed.join(found.hint("shuffle_hash"), "dk", "left").select("doc_id", "text", "places")
    kinds = {"text": ("string", pa.string()), "spans": ("array<array<int>>", pa.list_(pa.list_(pa.int32()))), "kept_sha256": ("string", pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            n, gone, out = [], [], {o: [] for o in outputs}
            raw = data.tobytes()
            for k, x in enumerate(part.column("places").to_pylist()):
                words = raw[offsets[k] : offsets[k + 1]].split()
                n.append(len(words))
                runs: list[list[int]] = []
                if x:
                    at = np.frombuffer(x, dtype=np.int32)
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + DEPTH, -1)
                    keep = np.cumsum(step)[:-1] == 0
                    edge = np.flatnonzero(np.diff(np.r_[True, keep, True]))
                    runs = [[int(a), int(b - a)] for a, b in zip(edge[0::2], edge[1::2], strict=True)]
                    words = [words[i] for i in np.flatnonzero(keep)]
                gone.append(n[-1] - len(words))
                if "spans" in out:
                    out["spans"].append(runs)
                if "text" in out or "kept_sha256" in out:
                    kept = b" ".join(words)
                    if "text" in out:
                        out["text"].append(kept.decode())
                    if "kept_sha256" in out:
                        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64())} | {o: pa.array(v, kinds[o][1]) for o, v in out.items()})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, ", ".join([f"doc_id {kind}, n_words bigint, n_removed bigint", *(f"{o} {kinds[o][0]}" for o in outputs)]))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), ("kept_sha256",))
