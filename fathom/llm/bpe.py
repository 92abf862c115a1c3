"""BPE encoding and decoding: a segment tree over adjacent pair ranks picks every merge.

The tree's leaves hold rank * width + position of each adjacent pair, so its root is the leftmost pair of
the lowest rank; a merge changes three leaves, each in a logarithmic number of steps. Words of equal tree
width are merged side by side, a row of one array each; words too long for that get a tree of their own.

Cases: a null or empty text, or one of blanks only, has no tokens and decodes to the empty text; strings of
special tokens in a text become their ids, as the file says; repeated rows are encoded row by row; other
columns of the input are ignored unless asked for.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, table, texts

#: Words are batched up to this tree width; most words that a task keeps encoded.
WIDEST, KEPT_WORDS = 64, 300_000
_NONE = np.iinfo(np.int64).max
#: Unicode white space, as a regex class.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a tokenizer file with word-end marks, lower case and split words."""

    def __init__(self, text: str):
        """text: the tokenizer file's."""
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens |= {i: t for t, i in self.special.items()}
        end = spec["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        self.base = max(tokens) + 1
        self.tokens = [tokens.get(i, "").encode() for i in range(self.base)]
        self.numbers = [str(i).encode() for i in range(self.base)]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        ranks = np.arange(len(keys))
        order = np.lexsort((ranks, keys))
        first = np.r_[True, np.diff(keys[order]) != 0] if len(keys) else np.zeros(0, dtype=bool)
        self.pairs, self.ranks, self.made = keys[order][first], ranks[order][first], made[order][first]
        self.by_rank = made
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{_BLANK}"))
        self.blanks = regex.compile(f"[{_BLANK}]+")
        self.ids_of: dict[str, bytes] = {}
        self.decoded_of: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (or _NONE) of each pair; a symbol of -1 has no pair."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE)

    def merge_rows(self, symbols: np.ndarray, width: int) -> np.ndarray:
        """Merge every row of symbols (-1 behind a word's end) to the end; merged-away places are -1."""
        m, n = symbols.shape
        tree = np.full((m, 2 * width), _NONE, dtype=np.int64)
        rank = self.rank(symbols[:, :-1], symbols[:, 1:])
        tree[:, width : width + n - 1] = np.where(rank == _NONE, _NONE, rank * width + np.arange(n - 1))
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        after = np.tile(np.arange(1, n + 1), (m, 1))
        before = np.tile(np.arange(-1, n), (m, 1))  # one more place, for writes behind the end
        wide = np.concatenate([symbols, np.full((m, 1), -1, dtype=np.int64)], axis=1)
        live = np.flatnonzero(tree[:, 1] != _NONE)

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            tree[rows, node] = value
            node = node >> 1
            while node.size and node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1

        def pair(rows: np.ndarray, at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
            rank = self.rank(wide[rows, at], wide[rows, nxt])
            return np.where(rank == _NONE, _NONE, rank * width + at)

        none = np.full(m, _NONE, dtype=np.int64)
        while live.size:
            rank, at = np.divmod(tree[live, 1], width)  # the root says which merge, and where
            gone = after[live, at]
            nxt = after[live, gone]
            wide[live, at], wide[live, gone] = self.by_rank[rank], -1
            after[live, at] = nxt
            before[live, nxt] = at
            inside = gone < width
            put(live[inside], gone[inside], none[: int(inside.sum())])
            put(live, at, pair(live, at, nxt))
            prev = before[live, at]
            has = prev >= 0
            rows, prev = live[has], prev[has]
            put(rows, prev, pair(rows, prev, at[has]))
            live = live[tree[live, 1] != _NONE]
        return wide[:, :n]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece; pieces of one tree width are merged together."""
        raw = [p.encode() for p in pieces]
        out: list[list[int]] = [[] for _ in raw]
        by_width: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            by_width.setdefault(1 << max(0, len(b) - 2).bit_length() if len(b) > 1 else 1, []).append(k)
        for width, members in by_width.items():
            most = max(1, (1 << 20) // width) if width <= WIDEST else 1
            for lo in range(0, len(members), most):
                part = members[lo : lo + most]
                size = np.array([len(raw[k]) for k in part])
                n = int(size.max())
                data = np.frombuffer(b"".join(raw[k] for k in part), dtype=np.uint8)
                rows = np.repeat(np.arange(len(part)), size)
                ends = np.cumsum(size)
                cols = np.arange(len(data)) - np.repeat(ends - size, size)
                symbols = np.full((len(part), max(n, 2)), -1, dtype=np.int64)
                symbols[rows, cols] = self.inner[data]
                symbols[np.arange(len(part)), size - 1] = self.final[data[ends - 1]]
                done = self.merge_rows(symbols, width)
                keep = done >= 0
                ids, bounds = done[keep].tolist(), np.r_[0, np.cumsum(keep.sum(axis=1))].tolist()
                for i, k in enumerate(part):
                    out[k] = ids[bounds[i] : bounds[i + 1]]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Tokens joined by one space, as the file names no decoder."""
        return b" ".join(map(self.tokens.__getitem__, ids))

    def learn(self, words: set[str]) -> None:
        """Encode words between blanks that aren't kept yet."""
        new = words.difference(self.ids_of)
        if len(self.ids_of) + len(new) > KEPT_WORDS:
            self.forget()
            new = words
        split: dict[str, list[str]] = {}
        for w in new:
            if w in self.special:
                self.ids_of[w], self.decoded_of[w] = str(self.special[w]).encode(), w.encode()
            else:
                split[w] = self.piece.findall(w.lower() if w.isascii() else unicodedata.normalize("NFC", w).replace("Σ", "σ").lower())
        pieces = list({p for ps in split.values() for p in ps})
        known = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        for w, ps in split.items():
            ids = known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]]
            self.ids_of[w], self.decoded_of[w] = b" ".join(map(self.numbers.__getitem__, ids)), self.decode(ids)

    def forget(self) -> None:
        self.ids_of.clear()
        self.decoded_of.clear()

    def words(self, text: str) -> list[str]:
        for s in self.special:
            if s in text:
                text = text.replace(s, f" {s} ")
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks for str.split alone
            return text.split()
        return [w for w in self.blanks.split(text) if w]

    def encode_many(self, batch: list[str]) -> tuple[list[bytes], list[bytes]]:
        """For each text its ids, and its decoded tokens, joined by spaces."""
        split = [self.words(t) for t in batch]
        ids, decoded, at = [], [], 0
        while at < len(split):  # texts with more words than may be kept come alone
            to, seen = at + 1, set(split[at])
            while to < len(split) and len(seen) < KEPT_WORDS // 2:
                seen.update(split[to])
                to += 1
            gc.disable()  # many short lists, none in a cycle
            try:
                self.learn(seen)
            finally:
                gc.enable()
            a, b = self.ids_of, self.decoded_of
            for ws in split[at:to]:
                ids.append(b" ".join(map(a.__getitem__, ws)))
                decoded.append(b" ".join(map(b.__getitem__, ws)))
            at = to
        return ids, decoded


_LOADED: dict[str, WordBpe] = {}


def coder_of(text: str) -> WordBpe:
    """One coder for each tokenizer file and process."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(text)
    return _LOADED[key]


def loaded(path: str) -> WordBpe:
    return coder_of(Path(path).read_text(encoding="utf-8"))


def bpe(docs: DataFrame, path: str, *keep: str, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens, the columns in keep, and of each whole text the outputs asked for.

    outputs: ids (array<int>), decoded (string), ids_sha256 and decoded_sha256 (of the decimal ids joined
    by one space, and of the decoded text in UTF-8). path: a tokenizer file that the driver reads; it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())} | dict.fromkeys(("ids_sha256", "decoded_sha256"), ("string", pa.string()))
    source = texts(docs, *keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text"]
    schema = ", ".join([*fields, "n_tokens bigint", *(f"{o} {kinds[o][0]}" for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        for part, _, _ in chunks(batches):
            ids, decoded = coder.encode_many(part.column("text").to_pylist())
            out = {n: part.column(n) for n in part.schema.names if n != "text"}
            out["n_tokens"] = pa.array([x.count(b" ") + 1 if x else 0 for x in ids], pa.int64())
            for o in outputs:
                if o == "ids":
                    out[o] = pa.array([np.array(x.split(), dtype=np.int32) for x in ids], pa.list_(pa.int32()))
                elif o == "decoded":
                    out[o] = pa.array([x.decode() for x in decoded], pa.string())
                else:
                    out[o] = pa.array([hashlib.sha256(x).hexdigest() for x in (ids if o == "ids_sha256" else decoded)], pa.string())
            yield pa.RecordBatch.from_pydict(out)
        coder.forget()  # the worker may serve other operators next

    return source.mapInArrow(run, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe(table(spark, sf_dir, "documents"), vocabulary(), outputs=("ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
