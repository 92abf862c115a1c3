"""Line dedup by pairwise alignment of documents that share rare runs of lines.

A key is a run of lines with BLOCK_WORDS words, the shortest from its first line on or back from its last:
far rarer than a line. Each key points from every document that holds it to the first one that does, so a key
of a thousand documents makes a thousand pairs, not a million, and none is passed over as too common. Each
pair is aligned by patience diff over all its lines: lines that occur once in both are matched by a longest
increasing run, then extended over equal neighbours. Aligned common blocks of BLOCK_WORDS words or more are
deleted from the later document. So are common blocks that the alignment crosses, as they stand elsewhere in
the earlier one; the result therefore doesn't depend on which holder of a block is aligned: a line goes if a
run of lines of BLOCK_WORDS words around it stands in any earlier document.

Documents are ordered by doc_id, nulls first (ids that aren't integers by a hash), then by a key of the text.
A line is compared without the blanks at its ends.

Cases: null and empty texts have no lines; lines without words are kept and never matched; rows that are
equal in doc_id and text are one document and all keep their text; a text all of whose lines are deleted
becomes empty; other columns are ignored unless asked for, and may have any name but those returned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, cut_lineage, mix, order_id, powers, sums, table, texts

BLOCK_WORDS = 8


def doc_key(docs: DataFrame) -> list[Column]:
    return [order_id(docs).alias("id"), F.xxhash64("text").alias("th")]


def line_hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and number of words of every line; a line without words has hash 0."""
    data, offsets = words.data, words.offsets
    cut = np.flatnonzero(data == 10)
    opens = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cut + 1]))
    opens = opens[opens <= len(data)]
    rows = np.searchsorted(offsets, opens, side="right") - 1
    # a newline that closes a text opens a last, empty line of that text
    ends = np.searchsorted(offsets, opens) if len(opens) else opens
    closing = np.isin(opens, cut + 1) & (ends < len(offsets)) & (offsets[np.minimum(ends, len(offsets) - 1)] == opens)
    if closing.any():
        before = np.searchsorted(offsets, opens[closing] - 1, side="right") - 1
        again = np.isin(opens[closing], offsets[:-1][np.diff(offsets) > 0])
        opens, rows = np.concatenate([opens[~closing], opens[closing], opens[closing][again]]), np.concatenate([rows[~closing], before, rows[closing][again]])
        order = np.lexsort((rows, opens))
        opens, rows = opens[order], rows[order]
    first = np.searchsorted(words.starts, opens)
    last = np.r_[first[1:], len(words)] if len(opens) else first
    h = np.zeros(len(opens), dtype=np.uint64)
    if len(words):
        up, down = powers(len(words) + 1)
        run = sums(words.hash * up[: len(words)])
        some = last > first
        # blanks inside a line count: hash the bytes from its first word to its last
        b_up, b_down = powers(len(data) + 1)
        b_run = sums((data.astype(np.uint64) + np.uint64(1)) * b_up[: len(data)])
        s, e = words.starts[first[some]], words.ends[last[some] - 1]
        h[some] = mix(mix((run[last[some]] - run[first[some]]) * down[first[some]]) + (b_run[e] - b_run[s]) * b_down[s]) | np.uint64(1)
    return rows, h, last - first


def lines_of(docs: DataFrame) -> DataFrame:
    """id, th, hashes and n_words (int64 and int32 arrays as bytes) of the lines of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            rows, h, n = line_hashes(Words(data, offsets))
            cut = np.searchsorted(rows, np.arange(part.num_rows + 1))
            both = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "th": part.column("th"), "hashes": both(h), "sizes": both(n.astype(np.int32))})

    source = texts(docs).select(*doc_key(docs), "text")
    return source.mapInArrow(run, "id bigint, th bigint, hashes binary, sizes binary")


def line_runs(h: np.ndarray, n: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, end and hash of every run of lines that is the shortest with BLOCK_WORDS words from its first line on, or back from its last.

    Each line of a block that may be deleted is in such a run of that block. h, n, owner: hash, words and
    document of lines, a document's together.
    """
    count = len(h)
    words, blanks = np.r_[0, np.cumsum(n, dtype=np.int64)], np.r_[0, np.cumsum(h == 0)]
    ahead, back = np.searchsorted(words, words[:-1] + BLOCK_WORDS, "left"), np.searchsorted(words, words[1:] - BLOCK_WORDS, "right") - 1
    start, stop = np.r_[np.arange(count), back], np.r_[ahead, np.arange(1, count + 1)]
    good = (start >= 0) & (stop <= count)
    start, stop = start[good], stop[good]
    good = (blanks[start] == blanks[stop]) & (owner[start] == owner[stop - 1])
    start, stop = start[good], stop[good]
    up, down = powers(count + 1)
    run = sums(h.view(np.uint64) * up[:count])
    return start, stop, mix((run[stop] - run[start]) * down[start]).view(np.int64)


def postings(lines: DataFrame) -> DataFrame:
    """h, id, th of every distinct run of line_runs, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in ("id", "th"))
            hs, ns = ([np.frombuffer(x, dtype=kind) for x in batch.column(c).to_pylist()] for c, kind in (("hashes", np.int64), ("sizes", np.int32)))
            owner = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
            start, _, h = line_runs(np.concatenate([np.zeros(0, np.int64), *hs]), np.concatenate([np.zeros(0, np.int32), *ns]), owner)
            at = owner[start]
            order = np.lexsort((h, at))
            at, h = at[order], h[order]
            new = np.r_[True, (at[1:] != at[:-1]) | (h[1:] != h[:-1])][: len(h)]
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[new]), "id": pa.array(ids[at[new]]), "th": pa.array(ths[at[new]])})

    return lines.mapInArrow(run, "h bigint, id bigint, th bigint")


def longest_block(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """Where the longest block of lines common to a and b begins in each, and its length; 0 matches nothing."""
    if not {*a} & {*b} - {0}:
        return 0, 0, 0
    code = np.unique(np.array([*a, *b], dtype=np.int64), return_inverse=True)[1].astype(np.uint64)
    both = np.array([*a, *b], dtype=np.int64)
    code[both == 0] = np.arange(len(code), 2 * len(code), dtype=np.uint64)[both == 0]
    up, down = powers(len(code) + 1)
    run = sums(mix(code) * up[: len(code)])
    runs = lambda lo, hi, n: (run[lo + n : hi + 1] - run[lo : hi + 1 - n]) * down[lo : hi + 1 - n]
    found, least, most = (0, 0, 0), 1, min(len(a), len(b))
    while least <= most:
        n = (least + most) // 2
        own, where = np.unique(runs(len(a), len(code), n), return_index=True)
        h = runs(0, len(a), n)
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        hit = np.flatnonzero(own[at] == h)
        if len(hit):
            found, least = (int(hit[0]), int(where[at[hit[0]]]), n), n + 1
        else:
            most = n - 1
    return found


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of patience diff, in order; 0 matches nothing.

    Works on a stack of ranges: common ends are matched first, then lines unique on both sides by a
    longest increasing run, and the ranges between those matches in turn. A range without such lines is
    split at its longest common block.
    """
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        while i < j and k < m and a[i] == b[k] and a[i]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1] and a[j - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {x: p for p, x in enumerate(b[k:m], k) if x and in_b[x] == 1}
        pairs = [(p, place[x]) for p, x in enumerate(a[i:j], i) if in_a[x] == 1 and x in place]
        if not pairs:
            x, y, n = longest_block(a[i:j], b[k:m])
            if n:
                out += [(i + x + q, k + y + q) for q in range(n)]
                stack += [(i, i + x, k, k + y), (i + x + n, j, k + y + n, m)]
            continue
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(pairs)
        for q, (_, y) in enumerate(pairs):
            t = bisect_left(tails, y)
            back[q] = ends[t - 1] if t else -1
            tails[t:t + 1], ends[t:t + 1] = [y], [q]
        chain, q = [], ends[-1]
        while q >= 0:
            chain.append(pairs[q])
            q = back[q]
        chain.reverse()
        i0, k0 = i, k
        for x, y in [*chain, (j, m)]:
            stack.append((i0, x, k0, y))
            i0, k0 = x + 1, y + 1
        out += chain
    return sorted(out)


def aligned_blocks(first: np.ndarray, later: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Positions of the later document's lines in aligned blocks of BLOCK_WORDS words or more."""
    out: list[int] = []
    block: list[int] = []
    before = None
    for x, y in [*patience(first.tolist(), later.tolist()), (-9, -9)]:
        if before and (x, y) != (before[0] + 1, before[1] + 1):
            if sizes[block].sum() >= BLOCK_WORDS:
                out += block
            block = []
        block.append(y)
        before = (x, y)
    return out


def common_blocks(first: np.ndarray, first_sizes: np.ndarray, later: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Positions of the later document's lines in aligned blocks, and in common blocks that the alignment crosses."""
    gone = np.zeros(len(later) + 1, dtype=np.int64)
    gone[aligned_blocks(first, later, sizes)] = 1
    start, stop, h = line_runs(later, sizes, np.zeros(len(later), dtype=np.int64))
    done = np.r_[0, np.cumsum(gone)]
    left = np.flatnonzero(done[stop] - done[start] < stop - start)
    if len(left):
        left = left[np.isin(h[left], line_runs(first, first_sizes, np.zeros(len(first), dtype=np.int64))[2])]
        cover = np.zeros(len(later) + 1, dtype=np.int64)
        np.add.at(cover, start[left], 1)
        np.add.at(cover, stop[left], -1)
        gone |= np.cumsum(cover)
    return np.flatnonzero(gone[:-1]).tolist()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """id, th, removed (sorted line positions) of every document that has aligned blocks in an earlier one."""
    lines = cut_lineage(lines_of(docs).dropDuplicates(["id", "th"]))
    posts = postings(lines)
    first = posts.groupBy("h").agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # joined by another key than it was grouped by: both sides are then dealt anew, and Spark may split a line of very many documents
    first = first.select(F.bitwise_not("h").alias("line"), "first")
    pairs = posts.withColumn("line", F.bitwise_not("h")).join(first, "line").where(F.struct("id", "th") != F.col("first")).select("id", "th", "first").distinct()
    pairs = pairs.select("id", "th", F.col("first.id").alias("id0"), F.col("first.th").alias("th0"))
    earlier = lines.select(F.col("id").alias("id0"), F.col("th").alias("th0"), F.col("hashes").alias("hashes0"), F.col("sizes").alias("sizes0"))
    rows = pairs.join(earlier, ["id0", "th0"]).join(lines, ["id", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [common_blocks(*(np.frombuffer(x, dtype=kind) for x, kind in zip(r, (np.int64, np.int32, np.int64, np.int32), strict=True))) for r in zip(*(batch.column(c).to_pylist() for c in ("hashes0", "sizes0", "hashes", "sizes")), strict=True)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "th": batch.column("th"), "gone": pa.array(got, pa.list_(pa.int32()))}).filter(pa.array([bool(g) for g in got], pa.bool_()))

    found = rows.select("id", "th", "hashes0", "sizes0", "hashes", "sizes").mapInArrow(run, "id bigint, th bigint, gone array<int>")
    return found.groupBy("id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"))


def line_dedup(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, text without its repeated blocks, n_lines and removed of every row.

    removed: positions of the deleted lines; a text without deletions stays as it is, null too.
    """
    gone = repeated_lines(docs)
    mine = docs.select("doc_id", *keep, F.col("text").alias("raw")).toDF("x_id", *(f"x{k}" for k in range(len(keep))), "raw")
    key = [order_id(mine, "x_id").alias("id"), F.xxhash64(F.coalesce("raw", F.lit(""))).alias("th")]
    source = mine.select("*", *key).join(gone, ["id", "th"], "left")
    line = F.split("raw", "\n")
    left = F.array_join(F.filter(line, lambda _, i: ~F.array_contains("removed", i)), "\n")
    return source.select(
        F.col("x_id").alias("doc_id"), *(F.col(f"x{k}").alias(c) for k, c in enumerate(keep)), F.when(F.col("removed").isNull(), F.col("raw")).otherwise(left).alias("text"),
        F.when(F.coalesce(F.col("raw"), F.lit("")) == "", 0).otherwise(F.size(line)).alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
