"""Resampling, token files and the Merkle manifest on small and odd inputs, against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.llm import merkle, resampling, token_files
from fathom.llm.places import positions

from oracle import SF

ODD = [None, "", "   \n\t ", "one", "A b C d " * 9, "same\nsame\nsame", "x" * 5000, "ab " * 3000, "É é\x1cq　ü ½ <|endoftext|>", "a\x00b\n\n\n c  d\t\n", "same\nsame\nsame"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 4 else None, t, [None, "en", "de"][k % 3], None if k == 5 else "s", None if k == 6 else 1) for k, t in enumerate(ODD)] + [(1, "", "en", "s", 0)] + [(7, "copy", "en", "s", 0)] * 3 + [(50, "alone", "Ω", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("hash", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("score", F.lit(2))


def many(spark, n):
    rng = random.Random(n)
    rows = [(k, " ".join(rng.choice("The data of a Model we'll train, 12 été".split()) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "fr", None]), "s", k) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


# -- positions

def test_positions_are_row_numbers(spark):
    df = many(spark, 700).select(F.coalesce("lang", F.lit("")).alias("lang"), (F.col("doc_id") % 50).alias("k"), "doc_id")
    got = positions(df, ["lang"], [F.desc("k"), F.asc("doc_id")]).collect()
    by = {}
    for r in got:
        by.setdefault(r.lang, []).append((r.place, -r.k, r.doc_id, r.size))
    for rows in by.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(len(rows))) and {x[3] for x in rows} == {len(rows)}
        assert [x[1:3] for x in rows] == sorted(x[1:3] for x in rows)
    assert positions(df.limit(0), ["lang"], [F.asc("k")]).collect() == []


# -- resampling

def resampled(docs, target, longest=2, buckets=10000, percent=25, seed=7, least=20):
    """Every word run put together and hashed on its own; scores sorted in a list."""
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for rows, out in ((docs, s), (target, t)):
        for _, text in rows:
            np.add.at(out, np.array(runs(text)[1], dtype=int), 1)
    gain = [math.floor(1000 * math.log((int(a) + 1) * (int(s.sum()) + buckets) / ((int(b) + 1) * (int(t.sum()) + buckets)))) for a, b in zip(t, s)]
    out = []
    for d, text in docs:
        n, f = runs(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    may = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(may[: len(may) * percent // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 70000, "percent": 60, "least": 2}, {"longest": 1, "percent": 100, "seed": 3}])
def test_resampling_by_force(spark, odd, options):
    docs = odd.select("doc_id", "text", "score").unionByName(many(spark, 150).where("doc_id > 60").selectExpr("doc_id", "text", "1 AS score"))
    target = spark.createDataFrame([(None, 1), ("We'll train a model of the data", 2), ("ab ab", 3)], "text string, doc_id int")
    named = {"min_words" if k == "least" else k: v for k, v in options.items()}
    got = resampling.resample(docs, target, **named).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = resampled([(r.doc_id, r.text) for r in docs.collect()], [(None, r.text) for r in target.collect()], **options)
    assert sorted(map(tuple, got), key=str) == want


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert [r.rank for r in resampling.resample(some, none, percent=100).collect()] == [1]


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    text = ("Öl and 12 words, " * 400 + "x" * 300).encode()
    whole = resampling.feature_buckets(text)
    monkeypatch.setattr(resampling, "PIECE", 37)
    n, buckets = resampling.feature_buckets(text)
    assert n == whole[0] and (buckets == whole[1]).all()


def test_crc32_in_sql():
    import duckdb

    for x in ("", "a", "été 12", "z" * 300):
        assert duckdb.sql(f"SELECT {resampling.crc32_sql('x')} FROM (SELECT '{x}' AS x)").fetchall()[0][0] == zlib.crc32(x.encode())


# -- token files

def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.vocabulary())


@pytest.mark.parametrize("piece", [1 << 20, 5])
def test_coder_is_the_library(monkeypatch, piece):
    monkeypatch.setattr(token_files, "PIECE", piece)
    monkeypatch.setattr(token_files, "KEPT_UNITS", 40)
    with open(token_files.vocabulary(), encoding="utf-8") as f:
        coder = token_files.Coder(f.read())
    lib, rng = library(), random.Random(piece)
    signs = [*"ab1 \n\t\r\x1c\x85\xa0'sé!.,", "<|endoftext|>", "  ", "\r\n", "'ll", "　", "᠎", "​", "ß", "中", "word,", "Été."]
    for text in ["", *ODD[2:], *("".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000))]:
        assert coder.ids(text).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("make", [lambda rng, n: rng.integers(0, 50257, n), lambda rng, n: rng.integers(0, 2, n), lambda rng, n: rng.geometric(0.01, n), lambda rng, n: rng.integers(0, 2**32, n), lambda rng, n: np.zeros(n)])
@pytest.mark.parametrize("n", [1, 7, 512, 5000])
def test_codes_at_any_place(tmp_path, make, n):
    rng = np.random.default_rng(n)
    ids = make(rng, n).astype(np.uint32)
    path = f"file://{tmp_path}/x.dac"
    token_files.write_file(path, pa.array([5, None], pa.int64()), [n - n // 2, n // 2], ids)
    f = token_files.TokenFile(path)
    assert f.n == n and f.doc_ids().to_pylist() == [5, None] and f.starts().tolist() == [0, n - n // 2, n]
    assert (f.tokens(0, n) == ids).all() and len(f.tokens(n, n)) == 0
    for _ in range(60):
        lo = int(rng.integers(0, n))
        hi = int(rng.integers(lo, n + 1))
        assert (f.tokens(lo, hi) == ids[lo:hi]).all() and f.token(lo) == ids[lo]
    with pytest.raises(IndexError):
        f.tokens(0, n + 1)


def test_widths_are_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.zeros(34, dtype=np.int64)
        lengths[1:11] = rng.integers(0, 100, 10)
        lengths[10] += 1

        def cost(widths, lengths=lengths):
            done, bits = 0, 0.0
            for k, w in enumerate(widths):
                n = lengths[1:].sum() if done == 0 else lengths[done + 1 :].sum()
                bits += n * (w + (0 if k == len(widths) - 1 else 1 + 64 / token_files.BLOCK))
                done += w
            return bits

        def splits(n):
            return [[n]] + [[w, *rest] for w in range(1, n) for rest in splits(n - w)]

        got = token_files.widths_for(lengths)
        assert sum(got) == 10 and math.isclose(cost(got), min(map(cost, splits(10))))


@pytest.mark.parametrize("shard", [1 << 24, 40])
def test_token_files_by_force(spark, odd, tmp_path, shard):
    docs = odd.select("doc_id", "text", F.lit(1).alias("th"), F.lit("x").alias("start")).unionByName(many(spark, 90).where("doc_id > 60").selectExpr("doc_id", "text", "1 AS th", "'y' AS start"))
    files = token_files.write_tokens(docs, token_files.vocabulary(), str(tmp_path / "t"), shard_tokens=shard)
    assert files.agg(F.sum("n_docs")).first()[0] == docs.count() and (shard > 40 or files.count() > 8)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in token_files.read_documents(spark, str(tmp_path / "t")).collect())
    lib = library()
    want = sorted((-1 if r.doc_id is None else r.doc_id, [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect())
    assert sorted((-1 if d is None else d, ids) for _, d, _, _, ids in got) == want
    at = 0
    for (start, d, n, crc, ids), (wd, _) in zip(got, want):
        assert (start, -1 if d is None else d, n, crc) == (at, wd, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    flat = [x for r in got for x in r[4]]
    places = [0, 0, at - 1, at, at + 10**9, *range(3, at, 97)]
    read = token_files.read_places(spark, str(tmp_path / "t"), spark.createDataFrame([(p,) for p in places], "place long"), bin_tokens=64).collect()
    assert sorted((r.place, r.token) for r in read if r.token is not None) == sorted((p, flat[p]) for p in places if p < at) and len(read) == len(places)


def test_token_files_of_text_ids_and_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([("b", "x"), ("a", None)], "doc_id string, text string")
    token_files.write_tokens(docs, token_files.vocabulary(), str(tmp_path / "s"))
    assert sorted((r.start, r.doc_id) for r in token_files.read_documents(spark, str(tmp_path / "s"), "string").collect()) == [(0, "a"), (1, "b")]
    token_files.write_tokens(docs.limit(0), token_files.vocabulary(), str(tmp_path / "n"))
    assert token_files.read_documents(spark, str(tmp_path / "n"), "string").collect() == []


def test_op12_by_the_library(spark):
    from fathom.llm.queries import QUERIES

    lib, at, want = library(), 0, []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op12_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


# -- Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def proved(rows, changed):
    """Trees as lists; the siblings of each leaf gathered on the way up."""
    def leaf(r, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def tree(hashes):
        """The root, and of each leaf [(siblings before, siblings after)]."""
        ways, groups, level = [[] for _ in hashes], [[k] for k in range(len(hashes))], hashes
        while len(level) > 1:
            up, joined = [], []
            for at in range(0, len(level), 8):
                run = level[at : at + 8]
                for k in range(len(run)):
                    for x in groups[at + k]:
                        ways[x].append(("".join(run[:k]), "".join(run[k + 1 :])))
                up.append(sha(*run))
                joined.append(sum(groups[at : at + 8], []))
            level, groups = up, joined
        return level[0], ways

    out, roots = [], []
    for lang in sorted({r.lang for r in rows}, key=lambda x: b"" if x is None else b"=" + x.encode()):
        mine = sorted(((-1 if r.doc_id is None else r.doc_id, leaf(r, r.text), r) for r in rows if r.lang == lang), key=lambda x: x[:2])
        root, ways = tree([h for _, h, _ in mine])
        roots.append(root)
        out += [(r, h, root, way, len(roots) - 1) for (_, h, r), way in zip(mine, ways)]
    top, over = tree(roots)
    rows = []
    for r, h, root, way, k in out:
        text = changed(r)
        fold = h if text is None else leaf(r, text)
        for a, b in way + over[k]:
            fold = sha(a, fold, b)
        rows.append((r.doc_id, h, root, top, sha(*(x for ab in way + over[k] for x in ab)), fold, fold == top))
    return sorted(rows, key=str)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65, 600])
def test_merkle_by_force(spark, odd, n):
    docs = odd.drop("hash").withColumn("hash", F.lit("h")) if n == 0 else many(spark, n)
    changed = F.when(F.col("doc_id") % 3 == 0, F.translate("text", merkle._UPPER, merkle._LOWER))
    got = merkle.manifest(docs, changed).drop("path").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    lower = lambda r: r.text and re.sub("[A-Z]", lambda m: m[0].lower(), r.text) if r.doc_id is not None and r.doc_id % 3 == 0 else None
    assert sorted(map(tuple, got), key=str) == proved(docs.collect(), lower)
    assert n < 65 or not all(r.verified for r in got) and any(r.verified for r in got)


def test_merkle_without_rows_and_of_other_groups(spark):
    docs = many(spark, 30)
    assert merkle.manifest(docs.limit(0)).collect() == []
    rows = merkle.manifest(docs, group="doc_id").collect()
    assert all(r.verified and r.leaf == r.subroot for r in rows) and len({r.root for r in rows}) == 1
