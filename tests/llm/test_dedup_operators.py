"""Near dedup, line dedup, substring dedup, LM scores and the pipeline against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import line_dedup, near_dedup, substring_dedup
from fathom.llm.components import components
from fathom.llm.queries import QUERIES

from oracle import SF


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("dk", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("key", F.lit(2.0))


def whole(sf=SF):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10**9, n)]


def classes_by_force(docs):
    bags, holders = {}, defaultdict(list)
    for i, t in docs:
        w = (t or "").encode().split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        for g in bags[i]:
            holders[g].append(i)
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for pair in {(a, b) for m in holders.values() for a in m for b in m if a < b}:
        a, b = (bags[x] for x in pair)
        if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
            x, y = sorted(map(find, pair))
            root[y] = x
    return {i: find(i) for i in bags}


def test_near_classes_of_documents(spark):
    got = {r.doc_id: r.class_id for r in QUERIES["op2_minhash"](spark, SF).collect()}
    assert got == classes_by_force(whole())


def test_near_classes_with_a_large_band(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = sentence(1, 120)
    texts = [None, "", "a b c", "a b c", "a b d"]
    for k in range(40):
        w = [*base]
        for j in np.random.default_rng(k).integers(0, 120, k % 5):
            w[j] = f"x{k}"
        texts.append(" ".join(w))
    docs = docs_of(spark, texts)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == classes_by_force(enumerate(texts))
    # texts outside the class of a band's pivot: two groups of near copies that share bands
    far = [*base]
    for j in range(0, 120, 15):
        far[j] = f"y{j}"
    for k in range(40):
        w = [*far]
        for j in np.random.default_rng(100 + k).integers(0, 120, k % 4):
            w[j] = f"z{k}"
        texts.append(" ".join(w))
    docs = docs_of(spark, texts)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == classes_by_force(enumerate(texts))
    kept = sorted(r.doc_id for r in near_dedup.keep_one(docs.unionByName(docs)).collect())
    assert kept == sorted(set(got.values()))
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_unlike_texts_with_null_and_equal_doc_ids(spark):
    a, b, c, d, e = (" ".join(sentence(k, 30)) for k in range(70, 75))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, ""), (7, None), (None, ""), (None, " "), (8, e), (None, e + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.keep_one(docs).collect()
    assert sorted((r.text or "").strip() for r in kept) == sorted(["", "", "", a, b, c, d, e + " more"])
    key = lambda t: hashlib.md5((t or "").encode()).digest()
    got = defaultdict(set)
    for r in near_dedup.near_duplicates(docs).collect():
        got[r.doc_id, bytes(r.th)].add(r.class_id)
    assert set(got) == {(i, key(t)) for i, t in rows} and all(len(x) == 1 and None not in x for x in got.values())
    assert got[8, key(e)] == got[None, key(e + " more")] == {8}
    assert len({min(x) for x in got.values()}) == 8


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    b = np.r_[a[:500], rng.integers(0, 2**63, 100).astype(np.uint64)]
    rows = np.repeat([0, 1], 600)
    s = near_dedup.signatures(rows, np.r_[a, b], 2)
    assert (s > 0).all()
    assert abs((s[0] == s[1]).mean() - 500 / 700) < 0.15


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (40, 40), (None, 5), (5, None)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(21)}, 30: 30, 31: 30}
    assert components(edges.limit(0)).count() == 0


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [1, 3, 2, 4]) in ([(0, 0), (1, 2), (3, 3)], [(0, 0), (2, 1), (3, 3)])
    assert line_dedup.patience([9, 1, 2, 3, 8], [7, 1, 2, 3, 6]) == [(1, 1), (2, 2), (3, 3)]
    assert line_dedup.patience([0, 0], [0, 0]) == []


def line_dedup_by_force(docs):
    """Lines in a run of eight words or more that stands in an earlier document; a shortest one has eight lines at most."""
    seen, out = set(), {}
    for i, t in docs:
        lines = [x.strip(" \t\n\r\x0b\x0c") for x in t.split("\n")] if t else []
        words = [len(x.encode().split()) for x in lines]
        runs = [(k, m) for k in range(len(lines)) for m in range(k + 1, min(k + 8, len(lines)) + 1) if sum(words[k:m]) >= 8 and all(words[k:m])]
        out[i] = sorted({j for k, m in runs if tuple(lines[k:m]) in seen for j in range(k, m)})
        seen |= {tuple(lines[k:m]) for k, m in runs}
    return out


def diff_by_force(a, b):
    """Aligned positions of a small patience diff, written apart from the library's."""
    if not a or not b:
        return []
    if a[0] and a[0] == b[0]:
        return [(0, 0), *((x + 1, y + 1) for x, y in diff_by_force(a[1:], b[1:]))]
    if a[-1] and a[-1] == b[-1]:
        return [*diff_by_force(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    once = [(a.index(x), y) for y, x in enumerate(b) if x and a.count(x) == 1 and b.count(x) == 1]
    best = [[]]
    for k, (x, y) in enumerate(once):
        best.append(max((c for c in best if not c or c[-1][0] < x), key=len) + [(x, y)])
    chain, out, x0, y0 = max(best, key=len), [], 0, 0
    if not chain:
        return []
    for x, y in [*chain, (len(a), len(b))]:
        out += [(x0 + p, y0 + q) for p, q in diff_by_force(a[x0:x], b[y0:y])] + ([(x, y)] if x < len(a) else [])
        x0, y0 = x + 1, y + 1
    return out


def test_what_alignment_with_any_earlier_document_deletes(spark):
    docs = whole()[:120]
    lines = {i: [x.strip(" \t\n\r\x0b\x0c") for x in t.split("\n")] for i, t in docs}
    got = {r.doc_id: set(r.removed) for r in line_dedup.line_dedup(docs_of(spark, [t for _, t in docs], docs[0][0])).collect()}
    size = lambda x: len(x.encode().split())
    n = 0
    for i, b in lines.items():
        for j, a in lines.items():
            if j < i and {x for x in a if size(x) > 1} & {x for x in b if size(x) > 1} and max(len(a), len(b)) < 300:
                block, before = [], None
                for x, y in [*diff_by_force([x if size(x) else "" for x in a], [x if size(x) else "" for x in b]), (-9, -9)]:
                    if before and (x, y) != (before[0] + 1, before[1] + 1):
                        if sum(size(b[k]) for k in block) >= 8:
                            assert set(block) <= got[i]
                            n += len(block)
                        block = []
                    block.append(y)
                    before = (x, y)
    assert n > 10


def test_line_dedup_of_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op9_line_dedup"](spark, SF).collect()}
    docs = whole()
    want = line_dedup_by_force(docs)
    assert {i: r.removed for i, r in got.items()} == want and any(want.values())
    for i, t in docs:
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest() and got[i].n_lines == len(t.split("\n"))


def test_line_dedup_of_odd_texts(spark):
    block = "\n".join(" ".join(sentence(k, 6)) for k in range(4))
    texts = [None, "", "\n\n", block, "own line here now\n" + block + "\nlast one is mine", block, "\n" + block + "\n", "a b c", "a b c", block.replace("\n", " \n\t")]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert {i: r.removed for i, r in got.items()} == line_dedup_by_force(enumerate(texts))
    assert got[0].text is None and got[5].text == "" and got[4].text == "own line here now\nlast one is mine"
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    twice = line_dedup.line_dedup(docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3"))).collect()
    assert [r.text for r in twice] == [block, block]


def test_a_block_whose_lines_have_other_first_holders(spark):
    a, b, c = (" ".join(sentence(k, n)) for k, n in ((50, 5), (51, 5), (52, 2)))
    block = f"{a}\n{b}\n{c}"
    docs = docs_of(spark, [a, b, f"{b}\n{a}", f"x\n{block}\ny", f"z\n\n{block}\n\nu", f"{a}\n\n{b}"])
    assert {r.doc_id: r.removed for r in line_dedup.line_dedup(docs).collect()} == {0: [], 1: [], 2: [], 3: [], 4: [2, 3, 4], 5: []}


def test_runs_of_lines():
    h, n, owner = np.array([1, 2, 3, 0, 4, 5, 4, 5]), np.array([3, 9, 2, 0, 4, 4, 4, 4]), np.array([0, 0, 0, 0, 0, 0, 1, 1])
    start, stop, got = line_dedup.line_runs(h, n, owner)
    assert {(a, b) for a, b in zip(start.tolist(), stop.tolist())} == {(0, 2), (1, 2), (1, 3), (4, 6), (6, 8)}
    assert len(set(got.tolist())) == 4
    assert all(len(x) == 0 for x in line_dedup.line_runs(h[:0], n[:0], owner[:0]))


def test_moved_blocks(spark):
    a, b, c = ("\n".join(" ".join(sentence(k + j, 5)) for j in range(2)) for k in (80, 83, 86))
    docs = docs_of(spark, [f"{a}\nx\n{b}\ny\n{c}", f"{c}\nz\n{b}\n\n{a}\nw"])
    assert {r.doc_id: r.removed for r in line_dedup.line_dedup(docs).collect()} == {0: [], 1: [0, 1, 3, 4, 6, 7]}


def test_patience_without_unique_lines():
    assert line_dedup.patience([9, 1, 2, 8, 1, 2, 7], [6, 1, 2, 5, 1, 2, 4]) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    assert line_dedup.patience([8, 1, 1, 7], [6, 1, 5]) == [(1, 1)]
    assert line_dedup.patience([8, 0, 0, 7], [6, 0, 0, 5]) == []
    assert line_dedup.longest_block([0, 3, 1, 2, 0], [1, 2, 0, 3, 1, 2, 0]) == (1, 3, 3)


def test_line_dedup_of_a_passage_that_stands_twice(spark):
    p = "\n".join(" ".join(sentence(k, 6)) for k in range(60, 62))
    docs = docs_of(spark, [f"a\n{p}\nb\n{p}\nc", f"d\n{p}\ne\n{p}\nf"])
    assert {r.doc_id: r.removed for r in line_dedup.line_dedup(docs).collect()} == {0: [], 1: [1, 2, 4, 5]}


def substring_by_force(docs):
    seen, out = set(), {}
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substring_dedup_of_documents(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substring_dedup"](spark, SF).collect()}
    assert got == substring_by_force(whole())


@pytest.mark.parametrize("heavy", [50_000, 1])
def test_substring_dedup_of_odd_texts(spark, monkeypatch, heavy):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    p = sentence(7, 60)
    texts = [None, "", "a " * 50, " ".join(p), " ".join([*sentence(8, 9), *p, *sentence(9, 9)]), " ".join(p[:20]), " ".join(p[1:20]), " ".join(p), " ".join([*p[:30], "x", *p[30:]]), "b c " * 40]
    docs = docs_of(spark, texts)
    out = substring_dedup.substring_dedup(docs, ("kept_sha256", "spans", "text")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == substring_by_force(enumerate(texts))
    assert {r.doc_id: r.spans for r in out}[4] == [[9, 60]]
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0
    same = docs.where("doc_id = 3")
    assert [r.n_removed for r in substring_dedup.substring_dedup(same.unionByName(same)).collect()] == [0, 0]


def test_words_whose_hashes_have_equal_halves(spark):
    from fathom.llm.common import Words

    names = np.array([f"id{k}" for k in range(400_000)])
    raw = " ".join(names).encode()
    upper = Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])).hash >> np.uint64(32)
    order = np.argsort(upper, kind="stable")
    twins = np.flatnonzero(upper[order][1:] == upper[order][:-1])
    assert len(twins)
    texts = [" ".join([*sentence(k, 19), names[order[j]]]) for k, i in enumerate(twins) for j in (i, i + 1)]
    out = substring_dedup.substring_dedup(docs_of(spark, texts), ("text",)).collect()
    assert {r.doc_id: r.text for r in out} == dict(enumerate(texts))


def test_substring_dedup_of_null_and_text_ids(spark):
    p = " ".join(sentence(3, 25))
    rows = [(5, p), (None, p), (None, p + " z"), (5, p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs, ()).collect())
    assert [x for x in got if x[0] == "5"] == [("5", 25, 25)] * 2
    assert sorted(x[2] for x in got if x[0] == "None") in ([0, 25], [0, 26])
    named = docs.where("doc_id is not null").withColumn("doc_id", F.lit("a")).unionByName(docs.limit(1).withColumn("doc_id", F.lit("b")))
    assert sorted(r.n_removed for r in substring_dedup.substring_dedup(named, ()).collect()) in ([0, 0, 25], [0, 25, 25])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows = out.collect()
        if k < 4:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
            after = {r.doc_id: r.text for r in rows}
            assert len(after) == len(rows) and set(after) <= set(before)
        if name == "line_dedup":
            want = line_dedup_by_force(sorted(before.items()))
            texts = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[i]) if want[i] else t for i, t in before.items()}
            assert after == {i: t for i, t in texts.items() if not want[i] or t.strip()}
        if name == "near_dedup":
            assert set(after) == set(classes_by_force(sorted(before.items())).values())
        if name == "bpe":
            assert {r.doc_id for r in rows} == set(before) and all(len(r.ids) == r.n_tokens for r in rows)
        else:
            before = after
            docs = spark.createDataFrame([tuple(r) for r in rows], out.schema)
    assert corpus_pipeline.run(spark, SF).count() == len(before)


def test_pipeline_of_odd_texts(spark):
    """What each stage keeps of null, empty and repeated texts."""
    long = " ".join(sentence(1, 30))
    rows = [(k, t, None, None, None) for k, t in enumerate([None, "", "\n", "a b", "a b", long, long])] + [(None, long, "x", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("more", F.lit(1))
    everything = sorted([None, *range(7)], key=str)
    keeps = {
        "quality_classifier": None,  # those without words go
        "line_dedup": [None, *range(5)],  # 5 and 6 hold what the row without an id holds, and lose all their words
        "near_dedup": [None, 0, 1, 2, 3],  # one of the three, the first; texts without words aren't alike
        "decontamination": everything,
        "bpe": everything,
    }
    for name, stage in corpus_pipeline.STAGES:
        got = [r.doc_id for r in stage(spark, docs, SF).collect()]
        if keeps[name] is None:
            assert len(got) == len(set(got)) and not {0, 1, 2} & set(got)
        else:
            assert sorted(got, key=str) == sorted(keeps[name], key=str), name
        assert stage(spark, docs.limit(0), SF).count() == 0
