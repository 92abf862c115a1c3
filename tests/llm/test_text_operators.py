"""BPE, rules, URLs, language, quality and decontamination on small and odd inputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fathom.llm import bpe, decontaminate, language_id, quality_classifier, quality_rules, url_filter
from fathom.llm.queries import ORACLE_SQL, QUERIES

from oracle import SF, spark_rows, sql_rows

ODD = [None, "", "   \n\t ", "one", "a b c d", "same\nsame\nsame", "x" * 5000, "ab " * 3000, "É é\x1cq\u3000ü 👩‍👩‍👧 ½", "a\x00b", "same\nsame\nsame"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 4 else None, t, None if k % 2 else "en", "s", 1) for k, t in enumerate(ODD)] + [(1, "", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long").withColumn("th", F.lit(1)).withColumn("words", F.lit("x"))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(ORACLE_SQL[name])


def test_bpe_is_the_library(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    rng = random.Random(3)
    more = ["".join(rng.choice("aeiouthnrs'éΣİß1<|>. ,\n") for _ in range(rng.randint(0, 90))) for _ in range(200)] + ["Hi<|endoftext|>You <|startoftext|>", "<|ENDOFTEXT|>", "aB" * 400]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    out = bpe.bpe(docs, bpe.vocabulary(), outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    want = []
    for r in docs.collect():
        e = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, e, lib.decode(e, skip_special_tokens=False)))
    got = [(r.doc_id, r.ids, r.decoded) for r in out]
    assert sorted(map(str, got)) == sorted(map(str, want))
    for r in out:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_merges_of_long_words():
    coder = bpe.loaded(bpe.vocabulary())
    ranks = {int(k): (int(r), int(m)) for k, r, m in zip(coder.pairs, coder.ranks, coder.made)}
    rng = random.Random(5)
    for n in (1, 2, 3, 17, 64, 65, 66, 67, 300):
        word = "".join(rng.choice("abtheing") for _ in range(n))
        s = [*coder.inner[list(word.encode()[:-1])].tolist(), int(coder.final[word.encode()[-1]])] if n > 1 else [int(coder.final[word.encode()[0]])]
        while True:
            best = min(((ranks[s[k] * coder.base + s[k + 1]][0], k) for k in range(len(s) - 1) if s[k] * coder.base + s[k + 1] in ranks), default=None)
            if best is None:
                break
            k = best[1]
            s[k : k + 2] = [ranks[s[k] * coder.base + s[k + 1]][1]]
        assert coder.encode_pieces([word]) == [s]


def test_rules_on_odd_texts(spark, odd):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(odd, quality_rules.RULES, "doc_id").collect()}
    assert got[(0, 0)].base_failed and not got[(0, 0)].kept
    assert got[(5, 3)].n_dup_lines == 2
    assert got[(7, 3000)].n_repeat_words == 3000
    assert quality_rules.quality_rules(odd.limit(0), quality_rules.RULES, "doc_id").count() == 0
    # names that clash with those of the projection
    clash = odd.select("doc_id", "text", F.lit(1).alias("_w"), F.lit(2).alias("_t"), F.lit(3).alias("n_words"))
    assert {(r.doc_id, r._w, r._t) for r in quality_rules.quality_rules(clash, quality_rules.RULES, "doc_id", "_w", "_t").collect()} == {(r.doc_id, 1, 2) for r in odd.collect()}


def test_repeats_in_one_text_by_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (4, 5, 6, 30, 400)] + [" ".join(f"w{rng.randint(0, 99)}" for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.measures(docs, "doc_id").collect():
        w = texts[r.doc_id].split()
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        assert r.n_repeat_words == len({k + j for k, x in enumerate(runs) if runs.count(x) > 1 for j in range(5)})


def test_urls(spark):
    urls = ["http://www.A.example.COM/en/7/", "https://x.net/de/1?q", "http://example.net/de/89", "nothing", None, "http://b.org/es/#t", "http://Listed.org/p/", "http://www.listed.org/p?x=1", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("listed.org/p",), (None,), ("listed.org/p",)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, listed).collect()}
    assert got[0] == ("www.a.example.com", "/en/7/", "example.com/en/7", "allow")
    assert got[1][2:] == ("net/de/", "allow") and got[2][2:] == ("example.net/de/8", "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[6][2:] == got[7][2:] == (None, "block") and got[5][2:] == ("org/es/", "block") and got[8][:2] == ("b:", "//c/d")
    assert {r.verdict for r in url_filter.url_filter(pages, listed.limit(0)).where("rule is null").collect()} == {"allow"}


def test_canonical_urls(spark):
    same = ["http://www.Ab.org:80/x/y/", "https://ab.org/x/./y", "https://AB.org.:443//x/z/../y?q=1", "http://u:p@ab.org/%78/y#t", "ftp://ab.org/x/y"]
    other = ["http://ab.org:443/x/y", "http://ab.org/x/Y", "http://ab.org/x%2Gy", "http://ab.org/x+y", "http:///x/y", "ab.org/x/y", None]
    rows = spark.createDataFrame([(u,) for u in same + other], "url string").select("url", url_filter.host_of("url").alias("host"), url_filter.path_of("url").alias("path"))
    got = [r.c for r in rows.select(url_filter.canonical().alias("c")).collect()]
    assert set(got[: len(same)]) == {"ab.org/x/y"}
    assert got[len(same) :] == ["ab.org:443/x/y", "ab.org/x/Y", "ab.org/x%2Gy", "ab.org/x+y", None, None, None]


def test_bloom_has_no_false_negative(spark, monkeypatch):
    urls = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canonical"))
    urls = urls.unionByName(spark.createDataFrame([(None, None), (7, None), (None, None)], "page_id long, canonical string"))
    for most in (url_filter.BROADCAST_BYTES, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", most)
        got = url_filter.in_list(urls, urls.where("page_id % 2 = 0").select("canonical")).collect()
        assert len(got) == 503 and all(r.is_listed == (r.canonical is not None and r.page_id % 2 == 0) and (r.possible or not r.is_listed) for r in got)
        assert sum(r.possible for r in got) < 300


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op7_language_id"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_mixed_and_odd_texts(spark, odd):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(train)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(odd, model).where("doc_id is not null").collect()}
    assert got[0] == got[2] == ("und", 0.0) and got[3][0] != "und"
    en, de = (train.where(f"lang = '{x}' and n_chars between 900 and 3000").first().text for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, en[:800] + " " + de[:400])], "doc_id long, text string")
    r = language_id.language_id(mixed, model).first()
    assert r.lang_pred == "en" and 0.5 < r.score < 0.85
    short = spark.createDataFrame([(1, "a"), (2, "é"), (3, "7"), (4, "ab")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.language_id(short, model).collect()}
    assert got[3].lang_pred == "und" and all(got[k].lang_pred in model.names and 0 < got[k].score <= 1 for k in (1, 2, 4))
    none = language_id.train(train.limit(0))
    assert {r.lang_pred for r in language_id.language_id(odd, none).collect()} == {"und"}


def test_mixture_by_force(spark):
    """EM and the penalised set against a plain version, text by text, over the model's own trigrams."""
    import numpy as np

    train = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(train)
    texts = [r.text for r in train.where("n_chars between 40 and 900").limit(25).collect()]
    texts += [a[:300] + " " + b[:200] for a, b in zip(texts, texts[7:])]
    got = language_id.language_id(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()

    def em(p, c, start):
        pi = start / start.sum()
        for _ in range(language_id.STEPS):
            w = pi[:, None] * p
            pi = (w / w.sum(axis=0) * c).sum(axis=1) / c.sum()
        return pi, (c * np.log((pi[:, None] * p).sum(axis=0))).sum()

    for r in got:
        raw = np.frombuffer(texts[r.doc_id].encode(), dtype=np.uint8)
        bucket, c = np.unique(language_id.trigrams(raw, np.array([0, len(raw)]))[1], return_counts=True)
        p = model.p[:, bucket].astype(float)
        pi, _ = em(p, c, np.ones(len(p)))
        order, best = np.argsort(-pi, kind="stable"), (-np.inf, None)
        for m in range(1, len(p) + 1):
            if m > 1 and pi[order[m - 1]] < language_id.LEAST:
                break
            start = np.zeros(len(p))
            start[order[:m]] = np.maximum(pi[order[:m]], 1e-3)
            own, like = em(p, c, start)
            value = like - m * language_id.PENALTY * np.log(c.sum() + 1)
            if value > best[0]:
                best = (value, own)
        assert r.lang_pred == model.names[best[1].argmax()] and abs(r.score - best[1].max()) < 1e-3


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST", 2)
    docs = spark.createDataFrame([(k, "some words here", f"l{k}") for k in range(3)], "doc_id long, text string, lang string")
    assert len(language_id.train(docs.where("doc_id < 2")).names) == 2
    with pytest.raises(ValueError, match="3 languages"):
        language_id.train(docs)


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = QUERIES["op6_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.95 * len(rows)


def test_quality_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(3, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.train(odd, labels)
    got = quality_classifier.score_quality(odd.drop("score"), model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.doc_id == 0] == [0.0]
    empty = quality_classifier.train(odd, labels.limit(0))
    assert {r.score for r in quality_classifier.score_quality(odd.drop("score"), empty).collect()} == {0.0, 0.5}


def test_quality_by_words_alone(spark):
    """Labels that only words tell: the classes differ in no share of letters or lengths."""
    rng = random.Random(1)
    good, bad = "gone tide moor leaf".split(), "node diet room flea".split()
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(30)), k % 2) for k in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    model = quality_classifier.train(docs.unionByName(docs), labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, model).collect()}
    assert sum((got[k] >= 0.5) == (y == 1) for k, _, y in rows if k % 5 == 0) >= 30
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert quality_classifier.train(named, labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).w


def test_attention_finds_the_bad_passage():
    import numpy as np

    rng = np.random.default_rng(0)
    bags, y = [], []
    for k in range(200):
        b = rng.normal(0, 1, (6, quality_classifier.N_FEATURES)).astype(np.float32)
        if k % 2:
            b[rng.integers(6), 0] = 6
        bags.append(b)
        y.append(1 - k % 2)
    model = quality_classifier.fit(bags, np.array(y))
    x, rows = np.concatenate(bags), np.repeat(np.arange(200), 6)
    assert ((model.score(x, rows, 200) >= 0.5) == np.array(y)).mean() > 0.95


def contaminated_by_force(docs, items):
    from collections import Counter

    out = set()
    for d, text in docs:
        w = (text or "").lower().encode().split()
        for k, item in items:
            v = (item or "").lower().encode().split()
            if not w or not v:
                continue
            n = min(5, len(v))
            s = Counter(tuple(v[i : i + n]) for i in range(len(v) - n + 1))
            m = min(len(v), len(w))
            for i in range(len(w) - m + 1):
                z = w[i : i + m]
                t = Counter(tuple(z[j : j + n]) for j in range(max(1, m - n + 1)))
                if sum((s & t).values()) >= 0.8 * sum((s | t).values()):
                    out.add((d, k))
                    break
    return out


def test_contamination(spark):
    base = [f"w{i}" for i in range(40)]
    changed = [*base]
    changed[20] = "other"
    items = [(1, " ".join(base)), (2, "Just Three Words"), (3, ""), (4, None), (5, " ".join(base)), (6, "p q r s t u v w x y")]
    texts = [None, "", "zz " * 30 + " ".join(base).upper() + " yy" * 30, " ".join(changed), " ".join(base[:20]), "a just three words b", " ".join(base[:39]), "p q r s t u v w x", "q " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == contaminated_by_force(enumerate(texts), items)
    assert {r.first_word for r in got if r.doc_id == 2} == {30}
    kept = {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {r.doc_id for r in got}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    named = bench.withColumn("item_id", F.concat(F.lit("i"), "item_id"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs.withColumn("lower", F.lit(1)), named).collect()} == {(r.doc_id, f"i{r.item_id}") for r in got}
    assert "lower" in decontaminate.without_contaminated(docs.withColumn("lower", F.lit(1)), bench).columns


def test_contamination_of_documents(spark):
    """All documents against all items, by force."""
    import duckdb

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    # by force only where a document has a shingle of the item, as the similarity is 0 elsewhere
    words = {d: t.lower().encode().split() for d, t in docs}
    held = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for d, w in words.items()}
    want = set()
    for k, item in items:
        v = item.lower().encode().split()
        own = {tuple(v[j : j + 5]) for j in range(len(v) - 4)}
        want |= contaminated_by_force([(d, t) for d, t in docs if held[d] & own], [(k, item)])
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_decontaminate"](spark, SF).collect()}
    assert got == want and want


def one_text(words):
    import numpy as np

    from fathom.llm.common import Words

    raw = " ".join(words).encode()
    return Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))


def test_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64)
    asked = prints.copy()
    for k in range(len(asked)):
        for b in rng.choice(64, rng.integers(0, 16), replace=False):
            asked[k] ^= np.uint64(1) << np.uint64(b)
    got = set(zip(*(x.tolist() for x in decontaminate.Index(prints).near(asked))))
    far = np.bitwise_count(asked[:, None] ^ prints[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= decontaminate.RADIUS))))


def test_fingerprints_find_edited_items(monkeypatch):
    """Most edited items are found by fingerprints, and what they miss by shared shingles."""
    draw, by_print, near = random.Random(5), 0, 0
    vocabulary = [f"w{k}" for k in range(400)]
    monkeypatch.setattr(decontaminate, "RUN", 50)
    for _ in range(40):
        item = draw.choices(vocabulary, k=draw.randint(15, 59))
        bench = decontaminate.Benchmark([1], [" ".join(item)])
        for edits in range(len(item) // 5):
            window = item[: len(item) - edits] + draw.choices(vocabulary, k=edits)
            text = one_text([*draw.choices(vocabulary, k=45), *window, "after"])
            similar = bench.similarity(decontaminate.shingle_hashes(one_text(window).hash), 0) >= decontaminate.SIMILARITY
            found = bench.search(text)
            assert bool(found) == similar or (found and found[0][3] >= decontaminate.SIMILARITY)
            near += similar
            by_print += similar and 45 in bench.fingerprinted(text)[0]
    assert near > 50 and by_print > 0.9 * near
