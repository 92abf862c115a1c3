"""Token ids in binary files of directly addressable codes, written and read by Spark tasks.

An id is cut into chunks from its low bits up. Level 1 holds the first chunk of every id, level k the k-th
chunk of those ids that have one; a bitmap beside each level but the last marks the ids that go on, and a
directory of counts for every 512 bits tells where in the next level an id goes on. So the id at any place is
read from a few bytes of each level, and no block is decoded for it. The widths of the levels are the
cheapest for the ids of a file, from the counts of their bit lengths.

A file holds consecutive documents; documents are dealt by ranges of doc_id and sorted in a task, which writes
one file after another, each of about SHARD_TOKENS ids, under a name of its own. The table of files beside
them is committed by Spark, so a file of a lost or repeated task is never read. All file access is by
pyarrow's file systems, on the folder's own store.

File: MAGIC, the header's length (8 bytes), a JSON header with the widths and the place and length of every
section, then the sections: documents (an Arrow stream of doc_id), starts (int64), and for each level its
chunks, bitmap and directory, bits from the lowest up.

Cases: a null or empty text has the end id alone; null ids come first; rows equal in doc_id are ordered by a
hash of the text, and each is written; an empty table gives a folder without files and an empty table; other
columns are ignored. A long text is encoded in pieces cut between words, and a word that fills a piece is
encoded whole. A document isn't cut over files: a file is as large as its last document makes it.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, table, texts

MAGIC = b"DACTOK01"
END_ID = 0
SHARD_TOKENS = 1 << 24
#: Bits for which the directory holds one count.
BLOCK = 512
#: Numbers packed or unpacked at once; a multiple of 8.
SLICE = 1 << 18
#: Characters of a text that are encoded at once, and the words (and their length) that a worker keeps encoded, once more for the table before.
PIECE = 1 << 20
KEPT_UNITS, KEPT_LENGTH = 450_000, 64
WIDEST = 24


# -- codes

def widths_for(lengths: np.ndarray) -> list[int]:
    """The cheapest widths of levels, where lengths[b] ids have b significant bits (at least one)."""
    top = int(np.flatnonzero(lengths)[-1]) if lengths.any() else 1
    longer = np.r_[lengths[::-1].cumsum()[::-1], 0]  # longer[b]: ids of b bits or more
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)
    for done in range(top - 1, -1, -1):  # bits below `done` are stored
        n = int(longer[1]) if done == 0 else int(longer[done + 1])
        best[done] = min((n * (w + (0 if done + w == top else 1 + 64 / BLOCK)) + best[done + w][0], [w, *best[done + w][1]]) for w in range(1, min(WIDEST, top - done) + 1))
    return best[0][1]


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, one after another."""
    if width == 8:
        return values.astype(np.uint8).tobytes()
    out = []
    for at in range(0, len(values), SLICE):
        part = values[at : at + SLICE].astype("<u2" if width <= 16 else "<u4", copy=False)
        part = np.ascontiguousarray(part).view(np.uint8).reshape(len(part), -1)
        out.append(np.packbits(np.unpackbits(part, axis=1, count=width, bitorder="little").ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: np.ndarray, first: int, n: int, width: int) -> np.ndarray:
    """n values of `width` bits, the first of which begins at bit `first` of data."""
    if width == 8 and first % 8 == 0:
        return data[first // 8 : first // 8 + n].astype(np.uint32)
    bit = np.arange(n, dtype=np.int64) * width + first
    at = bit >> 3
    wide = np.zeros(len(data) + 3, dtype=np.uint8)
    wide[: len(data)] = data
    value = wide[at].astype(np.uint32)
    for k in range(1, (width + 14) // 8):
        value |= wide[at + k].astype(np.uint32) << np.uint32(8 * k)
    return (value >> (bit & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)


def encode(ids: np.ndarray) -> tuple[list[int], list[tuple[bytes, bytes, bytes]]]:
    """Widths of the levels, and of each its chunks, bitmap and directory."""
    longer = [len(ids), *(int(np.count_nonzero(ids >= 1 << b)) for b in range(1, 8 * ids.itemsize)), 0]  # ids of more than b bits
    lengths = np.r_[0, -np.diff(longer)]
    widths, out, rest = widths_for(lengths), [], ids
    for k, w in enumerate(widths):
        bitmap = directory = b""
        chunks = pack(rest, w)
        if k < len(widths) - 1:
            rest = rest >> rest.dtype.type(w)
            on = rest > 0
            bitmap = np.packbits(on, bitorder="little").tobytes()
            directory = np.r_[0, np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.int64).cumsum()].astype("<i8").tobytes()
            rest = rest[on]
        out.append((chunks, bitmap, directory))
    return widths, out


class TokenFile:
    """Random access to one file: `token` and `tokens` read only the bytes that hold them."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        head = self.file.read_at(len(MAGIC) + 8, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} isn't a file of token ids")
        self.base = len(MAGIC) + 8 + int.from_bytes(head[len(MAGIC) :], "little")
        self.header = json.loads(self.file.read_at(self.base - len(MAGIC) - 8, len(MAGIC) + 8))
        self.widths, self.sections, self.n = self.header["widths"], self.header["sections"], self.header["n_tokens"]

    def close(self) -> None:
        self.file.close()

    def _bytes(self, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        at, size = self.sections[name]
        hi = size if hi is None else min(hi, size)
        return np.frombuffer(self.file.read_at(max(0, hi - lo), self.base + at + lo), dtype=np.uint8)

    def doc_ids(self) -> pa.Array:
        rows = pa.ipc.open_stream(self._bytes("documents").tobytes()).read_all()
        return rows.column("doc_id").combine_chunks()

    def starts(self) -> np.ndarray:
        """Where each document begins in this file, and where the last one ends."""
        return self._bytes("starts").view("<i8")

    def _ones(self, level: int, place: int) -> int:
        """How many of the first `place` ids of a level go on."""
        block = place // BLOCK
        count = int(self._bytes(f"directory{level}", 8 * block, 8 * block + 8).view("<i8")[0])
        bits = np.unpackbits(self._bytes(f"bitmap{level}", block * BLOCK // 8, place // 8 + 1), bitorder="little")
        return count + int(bits[: place - block * BLOCK].sum())

    def _slice(self, level: int, lo: int, hi: int) -> np.ndarray:
        w = self.widths[level]
        out = unpack(self._bytes(f"chunks{level}", lo * w // 8, -(-hi * w // 8)), lo * w % 8, hi - lo, w)
        if level < len(self.widths) - 1:
            on = np.flatnonzero(np.unpackbits(self._bytes(f"bitmap{level}", lo // 8, -(-hi // 8)), bitorder="little")[lo % 8 : lo % 8 + hi - lo])
            if len(on):
                first = self._ones(level, lo)
                out[on] |= self._slice(level + 1, first, first + len(on)) << np.uint32(w)
        return out

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """The ids at places lo to hi - 1 of this file."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError(f"places {lo} to {hi} of {self.n}")
        return self._slice(0, lo, hi) if hi > lo else np.zeros(0, dtype=np.uint32)

    def token(self, place: int) -> int:
        return int(self.tokens(place, place + 1)[0])


def write_file(path: str, doc_ids: pa.Array, counts: list[int], ids: np.ndarray) -> None:
    sink = pa.BufferOutputStream()
    rows = pa.RecordBatch.from_pydict({"doc_id": doc_ids})
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    widths, parts = encode(ids)
    sections = {"documents": sink.getvalue().to_pybytes(), "starts": np.r_[0, np.cumsum(counts)].astype("<i8").tobytes()}
    for k, part in enumerate(parts):
        sections |= {f"{name}{k}": x for name, x in zip(("chunks", "bitmap", "directory"), part, strict=True)}
    places, at = {}, 0
    for name, x in sections.items():
        places[name], at = (at, len(x)), at + len(x)
    header = json.dumps({"widths": widths, "n_tokens": len(ids), "sections": places}).encode()
    fs, inner = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(inner) as out:
        for x in (MAGIC, len(header).to_bytes(8, "little"), header, *sections.values()):
            out.write(x)


# -- tokens of texts

#: White space by some definition: what a pre-tokenizer may take for a blank.
_WHITE = r"\s\u180e\u200b\ufeff"
#: Runs of blanks in which a cut would change the pieces: three or more, or two at the end.
_LONG_BLANKS = re.compile(rf"[{_WHITE}]{{3}}|[{_WHITE}]{{2}}\Z")
#: What texts without such runs don't hold, for the most part: cheaper to look for.
_SIGNS_OF_BLANKS = [*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u200b\u2028\u2029\u202f\u205f\u3000\ufeff", *map(chr, range(0x2000, 0x200B)), *(a + b + c for a in " \n" for b in " \n" for c in " \n")]
_CUT = re.compile(f"[^{_WHITE}](?=[ \n][^{_WHITE}])")


def pieces(text: str) -> Iterator[str]:
    """A text in stretches of about PIECE characters, cut where a word ends and one blank and the next word begin."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + PIECE - 1) if len(text) - at > PIECE else None
        to = cut.end() if cut else len(text)
        yield text[at:to]
        at = to


def units(text: str) -> list[str] | None:
    """Stretches that a byte-level BPE encodes independently, without their space; None if a cut may change the ids.

    Every space and every newline opens one. A stretch that opens with a newline is itself, any other but the
    first stands for a space and itself. The pre-tokenizer's pieces are no white space with at most one space
    before it, or white space; of a run of blanks before a word all but the last are one piece. So runs of one
    or two blanks before a word may be cut before each blank.
    """
    if (any(x in text for x in _SIGNS_OF_BLANKS) or text[-1:].isspace()) and _LONG_BLANKS.search(text):
        return None
    return text.replace("\n", " \n").split(" ")


class Coder:
    """The library's ids of texts; words met before come from a table.

    New words are encoded by the library in one text, which parts them as the text they came from does, and told
    apart by the bytes that each id stands for.
    """

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]  # these part a text before all else
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values(), default=0) + 1
        self.kind = "<u2" if top <= 1 << 16 else "<u4"
        self.widths = np.zeros(top, dtype=np.int64)  # a byte-level vocabulary has a sign for each byte
        self.widths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the table before; what is met again moves over

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of stretches that open with one blank and don't end in one."""
        if not words:
            return []
        ids = np.array(self.library.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, dtype=self.kind)
        ends = np.fromiter(accumulate(map(len, map(str.encode, words))), dtype=np.int64, count=len(words))
        at = ((np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1) * ids.itemsize).tolist()
        data = ids.tobytes()
        return [data[lo:hi] for lo, hi in zip([0, *at], at, strict=False)]

    def learn(self, new: set[str]) -> None:
        plain = [u for u in new if u and not u[-1].isspace() and u[-1] not in "\u180e\u200b\ufeff"]
        alone = list(new.difference(plain)) if len(plain) < len(new) else []
        text = lambda units: [u if u[:1] == "\n" else " " + u for u in units]
        self.known.update(zip(plain, self.together(text(plain)), strict=True))
        self.known.update(zip(alone, self.whole(text(alone)), strict=True))

    def looked_up(self, splits: list[list[str]]) -> list[bytes]:
        """The joined ids of each list of stretches; new ones are learnt, all together."""
        got = [list(map(self.known.get, s)) for s in splits]
        gaps = [[i for i, x in enumerate(g) if x is None] if None in g else [] for g in got]
        new = {s[i] for s, gap in zip(splits, gaps, strict=True) for i in gap}
        if new:
            old, known = self.old, self.known
            again = {u: old[u] for u in new if u in old}
            known.update(again)
            self.learn(new.difference(again))
            for s, g, gap in zip(splits, got, gaps, strict=True):
                for i in gap:
                    g[i] = known[s[i]]
        out = [b"".join(g) for g in got]
        self.forget(new)
        return out

    def forget(self, new: set[str]) -> None:
        """Keep no long words, and no more words than KEPT_UNITS in a table."""
        for unit in new:
            if len(unit) > KEPT_LENGTH:
                self.known.pop(unit, None)
        if len(self.known) > KEPT_UNITS:
            self.old, self.known = self.known, {}

    def parted(self, text: str) -> list[str] | None:
        return None if any(t in text for t in self.added) else units(text)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text of any length, a piece of it at a time."""
        parts = []
        for piece in pieces(text):
            split = self.parted(piece)
            if split is None:
                parts += self.whole([piece])
                continue
            if split[0]:
                parts += self.whole(split[:1])
            del split[0]
            parts += self.looked_up([split])
        return np.frombuffer(b"".join(parts), dtype=self.kind)

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of several texts, whose new words are learnt together; together they should be about as long as a piece."""
        splits = [self.parted(t) for t in texts]
        first = self.whole([t if s is None else s[0] for t, s in zip(texts, splits, strict=True)])
        rest = [s for s in splits if s is not None]
        for s in rest:
            del s[0]
        found = iter(self.looked_up(rest))
        return [np.frombuffer(head if s is None else head + next(found), dtype=self.kind) for head, s in zip(first, splits, strict=True)]

    def stream(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        group: list[str] = []
        size = 0
        for text in texts:
            if len(text) > PIECE // 4:
                yield from self.ids_of(group)
                group, size = [], 0
                yield self.ids(text)
                continue
            group.append(text)
            size += len(text)
            if size > PIECE // 4:
                yield from self.ids_of(group)
                group, size = [], 0
        yield from self.ids_of(group)


_CODERS: dict[str, Coder] = {}


def coder_of(text: str) -> Coder:
    if text not in _CODERS:
        _CODERS.clear()
        _CODERS[text] = Coder(text)
    return _CODERS[text]


# -- tables

def _shards(rows: Iterable[tuple[pa.Scalar, np.ndarray]], most: int) -> Iterator[tuple[list[pa.Scalar], list[np.ndarray]]]:
    keys: list[pa.Scalar] = []
    ids: list[np.ndarray] = []
    n = 0
    for key, x in rows:
        keys.append(key)
        ids.append(x)
        n += len(x)
        if n >= most:
            yield keys, ids
            keys, ids, n = [], [], 0
    if keys:
        yield keys, ids


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of every whole text, an end id after each, to files in folder; return the table of files.

    tokenizer: a file of the tokenizers library, which the driver reads; it is broadcast. folder: a new folder
    on a store that all executors reach. The table of files is stored in it and has name, part, seq (files in
    order), before (ids of the part's earlier files), n_docs and n_tokens.
    """
    spark = docs.sparkSession
    folder = uri(spark, folder)
    fs, inner = pafs.FileSystem.from_uri(folder)
    fs.create_dir(inner, recursive=True)
    shared = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    source = texts(docs).withColumn("th", F.xxhash64("text"))
    keys = [F.asc_nulls_first("doc_id"), F.asc("th")]
    kind = pa.int64() if source.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else pa.string()
    source = source.withColumn("doc_id", F.col("doc_id").cast("bigint" if kind == pa.int64() else "string")).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = coder_of(shared.value), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=coder.kind)
        rows = ((key, np.concatenate([ids, end])) for b in batches for key, ids in zip(b.column("doc_id"), coder.stream(t.as_py() for t in b.column("text")), strict=True))
        for seq, (doc_ids, ids) in enumerate(_shards(rows, shard_tokens)):
            name, n = f"tokens-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac", sum(map(len, ids))
            write_file(f"{folder}/{name}", pa.array([k.as_py() for k in doc_ids], kind), [len(x) for x in ids], np.concatenate(ids))
            yield pa.RecordBatch.from_pylist([{"name": name, "part": part, "seq": seq, "before": before, "n_docs": len(ids), "n_tokens": n}], pa.schema([("name", pa.string()), *((c, pa.int64()) for c in ("part", "seq", "before", "n_docs", "n_tokens"))]))
            before += n

    source.select("doc_id", "text").mapInArrow(run, "name string, part bigint, seq bigint, before bigint, n_docs bigint, n_tokens bigint").write.parquet(f"{folder}/files.parquet")
    return spark.read.parquet(f"{folder}/files.parquet")


def uri(spark: SparkSession, folder: str) -> str:
    """The folder's full address, with the scheme of the cluster's store."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^(\w+):/(?!/)", r"\1:///", full).rstrip("/")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The table of files with `start`, the ids before each file: one number for each writing task is summed up."""
    out = spark.read.parquet(f"{folder}/files.parquet")
    parts = out.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return out.join(base, "part").select("name", "part", "seq", (F.col("base") + F.col("before")).alias("start"), "n_docs", "n_tokens")


def read_documents(spark: SparkSession, folder: str, doc_id: str = "bigint", ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, and the ids, from the files; doc_id: bigint, or string."""
    folder = uri(spark, folder)
    named = files(spark, folder)
    many = spark.read.parquet(f"{folder}/files.parquet").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = TokenFile(f"{folder}/{name}")
                keys, bounds, lo = shard.doc_ids(), shard.starts(), 0
                while lo < len(keys):  # documents of about SLICE ids at once
                    hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE, "right")) - 1)
                    found, at = shard.tokens(int(bounds[lo]), int(bounds[hi])).astype("<u4"), bounds[lo : hi + 1] - bounds[lo]
                    out = {"doc_id": keys.slice(lo, hi - lo), "start": pa.array(bounds[lo:hi] + start), "n_tokens": pa.array(np.diff(at))}
                    out["ids_crc32"] = pa.array([zlib.crc32(found[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
                    if ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(out)
                    lo = hi
                shard.close()

    schema = f"doc_id {doc_id}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    return named.repartition(max(1, min(many, 1 << 13))).select("name", "start").mapInArrow(run, schema)


def read_places(spark: SparkSession, folder: str, places: DataFrame, bin_tokens: int = SHARD_TOKENS) -> DataFrame:
    """places (column `place`, any order, repeats kept) with `token`, the id at that place of all ids; null beyond them.

    Places meet files in bins of places, so that neither side is held whole; a file's places are then read in
    order by direct access, and one hot file's by as many tasks as Spark splits the join into.
    """
    folder = uri(spark, folder)
    named = files(spark, folder).withColumn("stop", F.col("start") + F.col("n_tokens")).where("n_tokens > 0")
    bins = named.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_tokens), F.floor((F.col("stop") - 1) / bin_tokens))))
    asked = places.select("place").withColumn("bin", F.floor(F.col("place") / bin_tokens))
    rows = asked.join(bins.select("bin", "name", "start", "stop"), (asked["bin"] == bins["bin"]) & (asked["place"] >= F.col("start")) & (asked["place"] < F.col("stop")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            out = []
            for place, own, start in zip(*(batch.column(c).to_pylist() for c in ("place", "name", "start")), strict=True):
                if own != name:
                    if shard:
                        shard.close()
                    name, shard = own, TokenFile(f"{folder}/{own}") if own else None
                out.append(shard.token(place - start) if shard else None)
            yield pa.RecordBatch.from_pydict({"place": batch.column("place"), "token": pa.array(out, pa.int64())})
        if shard:
            shard.close()

    return rows.select("place", "name", "start").sortWithinPartitions("name", "place").mapInArrow(run, "place bigint, token bigint")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, vocabulary(), folder)
    return read_documents(spark, folder, ids=False)
