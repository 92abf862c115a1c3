"""Helpers shared by the corpus operators: sessions, keys and vectorised words."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: The bytes that end a word: space, and tab to carriage return.
BLANKS = (32, 9, 10, 11, 12, 13)
WORD_SPLIT = r"[\x20\x09-\x0D]+"

_U = np.uint64
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(BLANKS)] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_STEP = 0x9E3779B97F4A7C15 | 5
_STEP_BACK = pow(_STEP, -1, 2**64)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one where none is set and all runs in one process."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder for checkpoints, and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def steady(df: DataFrame) -> DataFrame:
    """df with rows in the same order each time a task reads them: stored first if anything was shuffled."""
    return stored(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts, counted."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def order_id(df: DataFrame, column: str = "doc_id") -> Column:
    """A bigint in the order of doc_id, nulls first; ids that aren't integers are ordered by a hash of them."""
    whole = df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(column).cast("bigint") if whole else F.xxhash64(column), F.lit(-(2**63)))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def texts(df: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id and the whole text, null as the empty text."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def powers(n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """_STEP ** i and its inverse modulo 2**64 for i < n; kept up to a few chunks."""
    if len(_kept.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_STEP, _STEP_BACK):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        if size > 8 * CHUNK_BYTES:
            return out[0], out[1]
        _kept["up"], _kept["down"] = out
    return _kept["up"], _kept["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def sums(x: np.ndarray) -> np.ndarray:
    """Running sums modulo 2**64 with a leading zero."""
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=out[1:])
    return out


class Words:
    """The words of a run of texts: byte bounds, hash, and for each text its first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, folded: bool = False):
        """offsets: len(texts) + 1 bounds into data, the first one 0. A long text is taken in pieces, so that
        what is kept grows with its words and only a piece's bytes are held as numbers."""
        self.data, self.offsets = data, offsets
        n, codes = int(offsets[-1]), _FOLDED if folded else _BYTE
        parts, lo = [], 0
        while lo < n or not parts:
            hi = min(n, lo + 4 * CHUNK_BYTES)
            while hi < n:  # a word isn't cut
                blank = np.flatnonzero(_IS_BLANK[data[hi : hi + CHUNK_BYTES]])
                hi = min(n, hi + (int(blank[0]) if len(blank) else CHUNK_BYTES))
                if len(blank):
                    break
            parts.append(self._piece(data[lo:hi], offsets, lo, codes))
            lo = hi
        self.starts, self.ends, self.hash = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
        self.first = np.searchsorted(self.starts, offsets)

    @staticmethod
    def _piece(data: np.ndarray, offsets: np.ndarray, lo: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        solid = np.empty(n + 2, dtype=bool)
        solid[0] = solid[-1] = False
        np.logical_not(_IS_BLANK[data], out=solid[1:-1])
        edge_at = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edge_at[0::2], edge_at[1::2]
        inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, lo + n, "left")] - lo
        if len(inner):
            inner = np.unique(inner)
            glued = inner[solid[inner] & solid[inner + 1]]  # a word may not run on into the next text
            if len(glued):
                starts = np.sort(np.concatenate([starts, glued]))
                ends = np.sort(np.concatenate([ends, glued]))
        up, down = powers(n + 1)
        run = sums(codes[data] * up[:n])
        h = (run[ends] - run[starts]) * down[starts]
        return starts + lo, ends + lo, mix(h + (ends - starts).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The positions at which `size` words of one text begin, and a hash of those words."""
        n = len(self)
        if n < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        up, down = powers(n + 1)
        run = sums(self.hash * up[:n])
        h = mix((run[size:] - run[:-size]) * down[: n - size + 1])
        last = np.repeat(self.first[1:], self.counts())[: n - size + 1]
        at = np.flatnonzero(np.arange(n - size + 1) + size <= last)
        return at, h[at]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and bounds of a string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    if bounds is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(bounds, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), offsets.astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches of about `most` bytes of text, each with its bytes and bounds; whole texts only."""
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
