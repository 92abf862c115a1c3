"""Data sources for files that one task shouldn't read whole: `structures` and `matrices`.

    formats.register(spark)
    spark.read.format("structures").option("blockBytes", 1 << 24).load("/models/*.pdb").where("chain = 'A'")
    spark.read.format("matrices").load("/pae/*.npy").where("i < 100")

`structures` cuts a file of many models at their MODEL records: a task takes the models that begin in its
bytes. Filters on chain and model are pushed into the scan, lines of other chains and models aren't parsed.
`matrices` cuts a stored square matrix into ranges of rows; filters on i drop ranges before they are read.
Files that aren't there give no rows; a file that isn't of its kind is an error.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan

BLOCK_BYTES = 1 << 25
_STEP = 1 << 20


def listed(pattern: str) -> list[tuple[str, int]]:
    """Address and size of the files of a path: one file, a folder's, or those whose name matches a last part with *."""
    scheme, sep, rest = pattern.partition("://")
    at = pattern if sep else f"file://{pattern}"
    folder, _, name = at.rpartition("/")
    base = folder.split("://")[0]
    if "*" in name:
        fs, inner = pafs.FileSystem.from_uri(folder)
        match = re.compile("".join(".*" if c == "*" else re.escape(c) for c in name))
        infos = [i for i in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if match.fullmatch(i.base_name)]
    else:
        fs, inner = pafs.FileSystem.from_uri(at)
        one = fs.get_file_info(inner)
        infos = fs.get_file_info(pafs.FileSelector(inner)) if one.type == pafs.FileType.Directory else [one]
    files = [i for i in infos if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))]
    return sorted((f"{base}://{i.path}", i.size) for i in files)


@dataclass
class Block(InputPartition):
    """Bytes (or rows) lo to hi of a file."""

    path: str
    lo: int
    hi: int


def _opened(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


class _Lines:
    """Lines of a file from a place on, with the place at which each begins."""

    def __init__(self, file, at: int):
        self.file, self.at, self.size = file, at, file.size()

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at, rest, start = self.at, b"", self.at
        while at < self.size:
            data = self.file.read_at(min(_STEP, self.size - at), at)
            at += len(data)
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            for line in lines:
                yield start, line
                start += len(line) + 1
        if rest:
            yield start, rest


ATOM_SCHEMA = "path string, model int, hetero boolean, serial int, atom string, altloc string, resname string, chain string, resseq int, icode string, x double, y double, z double, occupancy double, b_factor double, element string"
_NUMBERS = {"serial": (6, 11, int), "resseq": (22, 26, int), "x": (30, 38, float), "y": (38, 46, float), "z": (46, 54, float), "occupancy": (54, 60, float), "b_factor": (60, 66, float)}
_WORDS = {"atom": (12, 16), "altloc": (16, 17), "resname": (17, 20), "chain": (21, 22), "icode": (26, 27), "element": (76, 78)}
_TYPES = {int: pa.int32(), float: pa.float64()}


def _cell(text: str, kind: type):
    try:
        return kind(text)
    except ValueError:
        return None


class StructureReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists on chain and model are held to while lines are read."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute[0] not in ("chain", "model"):
                yield f
            else:
                name = f.attribute[0]
                self.wanted[name] = values & self.wanted[name] if name in self.wanted else values

    def partitions(self) -> list[Block]:
        return [Block(path, lo, min(size, lo + self.block)) for path, size in listed(self.path) for lo in range(0, size, self.block)] or [Block("", 0, 0)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.path:
            return
        file = _opened(block.path)
        chains = {c.encode() for c in self.wanted["chain"]} if "chain" in self.wanted else None
        models, rows = self.wanted.get("model"), []
        mine, model = block.lo == 0, 1  # what stands before the first MODEL record is model 1, of the first block
        # a line that runs into the block from before it belongs to the block before: begin one byte early
        lines = iter(_Lines(file, max(0, block.lo - 1)))
        if block.lo:
            next(lines, None)
        for at, line in lines:
            if line.startswith(b"MODEL "):
                if at >= block.hi:
                    break
                mine, model = True, _cell(line[6:].decode(), int) or 0
            elif mine and line.startswith((b"ATOM", b"HETATM")) and (models is None or model in models) and (chains is None or line[21:22].strip() in chains):
                rows.append((model, line.decode("utf-8", "replace").rstrip("\r")))
                if len(rows) >= 1 << 14:
                    yield self._batch(block.path, rows)
                    rows = []
        if rows:
            yield self._batch(block.path, rows)
        file.close()

    @staticmethod
    def _batch(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        text = [t for _, t in rows]
        cells = {"path": pa.array([path] * len(rows)), "model": pa.array([m for m, _ in rows], pa.int32()), "hetero": pa.array([t.startswith("HETATM") for t in text])}
        cells |= {n: pa.array([_cell(t[a:b], kind) for t in text], _TYPES[kind]) for n, (a, b, kind) in _NUMBERS.items()}
        cells |= {n: pa.array([t[a:b].strip() for t in text]) for n, (a, b) in _WORDS.items()}
        order = [c.split()[0] for c in ATOM_SCHEMA.split(", ")]
        return pa.RecordBatch.from_pydict({n: cells[n] for n in order})


class Structures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "structures"

    def schema(self) -> str:
        return ATOM_SCHEMA

    def reader(self, schema) -> StructureReader:
        return StructureReader(self.options["path"], int(self.options.get("blockBytes", BLOCK_BYTES)))


def matrix_header(file) -> tuple[int, int, np.dtype]:
    """Where the numbers of a stored array begin, its rows, and their type; an error unless it is square and by rows."""
    head = file.read_at(12, 0)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("no stored array")
    width = 2 if head[6] == 1 else 4
    start = 8 + width
    size = int.from_bytes(head[8:start], "little")
    spec = ast.literal_eval(file.read_at(size, start).decode())
    if len(spec["shape"]) != 2 or spec["shape"][0] != spec["shape"][1] or spec["fortran_order"]:
        raise ValueError(f"no square matrix by rows: {spec['shape']}")
    return start + size, spec["shape"][0], np.dtype(spec["descr"])


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block, self.lo, self.hi = path, block, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on i choose the rows that are read."""
        for f in filters:
            if f.__class__ in (EqualTo, LessThan, GreaterThanOrEqual) and f.attribute == ("i",):
                if not isinstance(f, LessThan):
                    self.lo = max(self.lo, f.value)
                if not isinstance(f, GreaterThanOrEqual):
                    end = f.value + isinstance(f, EqualTo)
                    self.hi = end if self.hi is None else min(self.hi, end)
            else:
                yield f

    def partitions(self) -> list[Block]:
        out = []
        for path, _ in listed(self.path):
            file = _opened(path)
            _, n, kind = matrix_header(file)
            file.close()
            step = max(1, self.block // max(1, n * kind.itemsize))
            hi = n if self.hi is None else min(n, self.hi)
            out += [Block(path, lo, min(hi, lo + step)) for lo in range(self.lo, hi, step)]
        return out or [Block("", 0, 0)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.path:
            return
        file = _opened(block.path)
        start, n, kind = matrix_header(file)
        step = max(1, (1 << 18) // max(1, n))
        for lo in range(block.lo, block.hi, step):
            hi = min(block.hi, lo + step)
            m = np.frombuffer(file.read_at((hi - lo) * n * kind.itemsize, start + lo * n * kind.itemsize), dtype=kind).astype(np.float64)
            i, j = np.divmod(np.arange(lo * n, hi * n, dtype=np.int64), n)
            yield pa.RecordBatch.from_pydict({"path": pa.array([block.path] * len(m)), "i": pa.array(i), "j": pa.array(j), "value": pa.array(m)})
        file.close()


class Matrices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrices"

    def schema(self) -> str:
        return "path string, i bigint, j bigint, value double"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("blockBytes", BLOCK_BYTES)))


def register(spark: SparkSession) -> SparkSession:
    """Make both formats known to a session, with filters pushed into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Structures)
    spark.dataSource.register(Matrices)
    return spark
