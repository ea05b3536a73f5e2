"""Vector codes, phrases and passages against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import codebooks, collocations, fmindex, langid, passages, tokenfile, warc
from paperloom.llm import common, decontamination, jaccard

# ---- 11 ---------------------------------------------------------------


def coded(rows, parts=4, entries=256, rounds=4):
    """Each kept row's code, error and label error, and the digest, one vector at a time."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    size = len(kept[0][2]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        lots = {}
        for c in cut:
            for p in range(parts):
                lots.setdefault((p, nearest(p, c[p])[1]), []).append(c[p])
        for (p, k), lot in lots.items():
            books[p][k] = [sum(col) // len(lot) for col in zip(*lot)]
    out = []
    for (i, label, _), c in zip(kept, cut):
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    total = Counter()
    for _, label, _, error in out:
        total[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i, code, error, total[label], digest) for i, label, code, error in out)


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("entries", [3, 256])
def test_vector_codes(spark, entries):
    rng = random.Random(entries)
    rows = [(i, [rng.choice([-1.5, -0.001, 0.0, 0.25, 1.0]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += [(1000, None, 1), (1001, [None] * 8, 1), (1002, [math.nan] * 8, 1), (1003, [math.inf] * 8, None)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("clash")).withColumn("error", F.lit(1)).repartition(5)
    got = sorted(tuple(r) for r in codebooks.compress(df, entries=entries).collect())
    assert got == coded(rows, entries=entries)


def test_vector_codes_of_odd_tables(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0, 3.0, 4.0], None), (9, [1.0], 1), (8, [1e30, 0.0, 0.0, 0.0], 1), (None, [0.0] * 4, 1), (7, [1.0, 2.0, 3.0, 4.0], None)], VECTORS)
    got = {(r["vec_id"], r["code"]): r["error"] for r in codebooks.compress(df, entries=1, rounds=0).collect()}
    # Repeated rows stay; another dimension has no code; what is too large is clamped.
    assert set(got) == {(7, "00000000"), (9, None), (8, "00000000"), (None, "00000000")} and got[9, None] is None and 0 < got[8, "00000000"] < 1 << 63
    assert codebooks.compress(df).count() == 5 and codebooks.compress(df.limit(0)).count() == 0
    uneven = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0], 0), (2, [9.0, 2.0, 3.0, 4.0, 5.0], 0)], VECTORS)
    model = codebooks.fit(uneven, rounds=1)
    assert [e.shape for e in model.entries] == [(2, 2), (2, 1), (2, 1), (2, 1)]
    back = codebooks.decode(codebooks.encode(uneven, model), model).collect()
    assert all(r["decoded"] == r["embedding"] for r in back)
    assert codebooks.encode(uneven, codebooks.fit(uneven.limit(0))).where("code IS NOT NULL OR error IS NOT NULL").count() == 0


@pytest.mark.parametrize("kind, top", [(np.int64, 3), (np.int64, 1 << 26)])
def test_tree_search_keeps_the_lower_index(kind, top):
    rng = np.random.default_rng(top)
    entries, rows = rng.integers(-top, top, (200, 5)), rng.integers(-top, top, (700, 5))
    entries[50:100] = entries[:50]
    index, error = codebooks.Tree(entries).nearest(rows)
    full = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (error == full.min(axis=1)).all() and (index == full.argmin(axis=1)).all()


# ---- 12 -----------------------------------------------------------------


def ranked(rows, max_words=3, min_count=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    out = {}
    for (lang, w), a in candidates.items():
        if any(l2 == lang and len(q) > len(w) and 100 * b >= percent * a and any(q[i : i + len(w)] == w for i in range(len(q) - len(w) + 1)) for (l2, q), b in candidates.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("options", [{}, {"max_words": 2}, {"max_words": 5, "min_count": 3}, {"min_count": 2, "percent": 90, "top": 7}])
def test_collocations(spark, monkeypatch, options):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 200)
    rng = random.Random(5)
    words = ["New", "york", "CITY", "ça", "日本", "a b", "x"] + [f"w{i}" for i in range(6)]
    rows = [("".join(rng.choice(["new york city ", "a a a a ", *(w + rng.choice([" ", "\t", "  ", ". ", "!", "\n"]) for w in words)]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", None, "fr"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), ("only", "de"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("chunk", F.lit(1)).withColumn("left", F.lit("clash")).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, **options).select(*COLUMNS).collect())
    assert got == ranked(rows, **options) and len(got) > 10
    assert collocations.collocations(df.limit(0)).count() == 0


def test_counts_beyond_64_bits_stay_exact(spark):
    a, l, r = 3_000_000_019, 3_000_000_037, 3_000_000_043
    exact = "(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000BD) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(F.expr(exact).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (l * r) and exact.replace("(l ", "(c.l ").replace("(r ", "(c.r ") == collocations.SCORE


# ---- 13 -----------------------------------------------------------------


def passages_left(rows, t):
    words = [re.findall("[^\x20\x09-\x0d]+", x or "") for _, x in rows]
    keys = [-(1 << 63) if d is None else d for d, _ in rows]
    least = {}
    for d, w in zip(keys, words):
        for i in range(len(w) - t + 1):
            g = tuple(w[i : i + t])
            least[g] = min(least.get(g, d), d)
    out = []
    for (key, _), d, w in zip(rows, keys, words):
        gone = set()
        for i in range(len(w) - t + 1):
            if least[tuple(w[i : i + t])] < d:
                gone.update(range(i, i + t))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out, key=repr)


@pytest.mark.parametrize("threshold, letters, max_group, shard", [(5, "abc", 5000, 1 << 19), (9, "ab", 3, 1 << 19), (12, "abcdef", 5000, 40), (50, "abcdefghij", 5000, 300), (70, "ab", 5000, 1 << 19)])
def test_repeated_passages(spark, monkeypatch, threshold, letters, max_group, shard):
    monkeypatch.setattr(passages, "SHARD_WORDS", shard)
    rng = random.Random(threshold)
    base = [[rng.choice(letters) + rng.choice(["", "é", "日"]) for _ in range(6 * threshold)] for _ in range(6)]
    rows = []
    for i in range(120):
        at = rng.randrange(3 * threshold)
        w = list(rng.choice(base)[at : at + rng.randint(1, 3 * threshold)])
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "zz"
        rows.append((rng.choice([None, i, i, i // 3, 7]), rng.choice([" ", "\n", "\t "]).join(w * rng.choice([1, 1, 2]))))
    rows += [(500, None), (501, ""), (502, " \n "), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("first", F.lit(1)).repartition(3)
    made = passages.remove_passages(df, threshold=threshold, max_group=max_group)
    assert made.columns == ["doc_id", "text", "first", "n_words", "n_removed", "kept_sha256", "kept"]
    got = sorted((tuple(r) for r in made.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()), key=repr)
    want = passages_left(rows, threshold)
    assert got == want and sum(w[2] for w in want) > threshold
    assert passages.remove_passages(df.limit(0)).count() == 0


def test_a_passage_that_everything_holds_and_a_very_long_text(spark):
    rng = random.Random(2)
    common = " ".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(i, f"x{i} " * rng.randint(0, 30) + common + f" y{i}") for i in range(300)]
    long = " ".join(str(rng.randrange(3000)) for _ in range(40_000))
    rows += [(1000, long), (1001, long[50_000:90_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in passages.remove_passages(df, max_group=50).collect()}
    want = {w[0]: w for w in passages_left(rows, 50)}
    assert all((got[k]["n_words"], got[k]["n_removed"], got[k]["kept"]) == (w[1], w[2], w[4]) for k, w in want.items())


def test_index_against_plain_search():
    """Matching statistics of every place, and ranks and minima, are those of a search by hand."""
    rng = np.random.default_rng(8)
    texts = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(25)]
    owner = rng.integers(0, 9, len(texts))
    index = fmindex.Index(texts, owner)

    def longest(i, at):
        best = 0
        for j, other in enumerate(texts):
            if owner[j] < owner[i]:
                for k in range(len(other)):
                    n = 0
                    while at + n < len(texts[i]) and k + n < len(other) and texts[i][at + n] == other[k + n]:
                        n += 1
                    best = max(best, n)
        return best

    seen = 0
    for text, at, m in index.statistics(need=0):
        assert [longest(i, a) for i, a in zip(text.tolist(), at.tolist())] == m.tolist()
        seen += len(text)
    assert seen == sum(map(len, texts))
    symbols = rng.integers(0, 11, 300)
    wavelet = fmindex.Wavelet(symbols, 11)
    s, at = rng.integers(0, 11, 500), rng.integers(0, 301, 500)
    assert wavelet.rank(s, at).tolist() == [int((symbols[:a] == x).sum()) for x, a in zip(s, at)]


# ---- bounds of the others ---------------------------------------------------


def test_language_sample_is_bounded_when_keys_are_null_or_repeated(spark, monkeypatch):
    rows = [(None if i % 2 else 3, f"the word {i % 700} of many", "en") for i in range(6000)] + [(i, f"le mot {i}", "fr") for i in range(200)] + [(None, "same", "de")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = []
    collect = type(df).collect
    try:
        type(df).collect = lambda self: (lambda r: (sizes.append(len(r)), r)[1])(collect(self))
        model = langid.fit(df, sample_rows=50)
    finally:
        type(df).collect = collect
    assert max(sizes) <= 3 * 2 * 50 and model.languages == ("de", "en", "fr")
    assert len({line for line in model.dictionaries[1].split(b"\n") if line}) > 1
    monkeypatch.setattr(langid, "MAX_LABELS", 2)
    with pytest.raises(ValueError):
        langid.fit(df)


def test_rows_of_one_key_are_split_among_token_files(spark):
    df = spark.createDataFrame([(None, f"text {i % 3} of {i % 400}") for i in range(4000)] + [(5, "same")] * 2000, "doc_id long, text string").repartition(4)
    uri = common.new_path(spark, "split")
    manifest = tokenfile.write(df, uri)
    assert len(manifest) >= 3 and max(n for _, _, n in manifest) < 4000
    keys = [r["key"] for r in tokenfile.read(spark, uri, manifest).orderBy("start").collect()]
    assert keys == [None] * 4000 + [5] * 2000


def test_files_of_an_operator_are_removed(spark):
    common.drop_intermediates(spark)
    tokenfile.write_and_read(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    warc.write_and_read(spark.createDataFrame([(1, "http://a/b", "x" * 200)], "page_id long, url string, html string")).collect()
    names = [p for p, _ in common._made]
    assert {n.rsplit("/", 1)[1].split("-")[0] for n in names} == {"tokens", "warc", "captures"}
    common.drop_intermediates(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    assert not any(hadoop.Path(n).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(n)) for n in names)


def test_benchmark_windows_of_too_many_bytes_are_not_broadcast(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(8)]
    bench = spark.createDataFrame([(f"i{k}", " ".join(rng.choices(words, k=rng.randint(1, 6)))) for k in range(25)] + [("j", "w1"), (None, "w2 w3")], "item_id string, text string")
    docs = spark.createDataFrame([(rng.choice([None, i]), " ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(60)] + [(1, None)], "doc_id long, text string")
    long = docs.limit(1).select(F.lit(99).cast("long").alias("doc_id"), F.repeat(F.concat("text", F.lit(" w1 w2 x ")), 3000).alias("text"))
    docs = docs.unionByName(long)
    near, far = (sorted(map(repr, decontamination.find(docs, bench, n=4, max_bytes=b).collect())) for b in (1 << 20, 10))
    assert near == far and any("contaminated=True" in r for r in near)


def test_long_lists_of_one_root_are_not_held(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 5)
    rows = [(1, i, 9, 0) for i in range(40)] + [(2, i, 9, i % 2) for i in range(30)] + [(3, 1, 9, 0), (3, 2, 9, 1), (4, 1, 9, 0)]
    df = spark.createDataFrame(rows, "gram long, node long, n long, root long")
    long = df.groupBy("gram").agg(F.count("*").alias("long"))
    got = {r["gram"]: r["n"] for r in jaccard._several_roots(df, long, 3).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    assert got == {2: 30, 3: 2}


def test_phrases_pass_a_chunks_ids_on_packed(spark, monkeypatch):
    """No row of a collected list of a chunk's ids, nor an array of all its pairs: both grew with what a task got."""
    rng = random.Random(8)
    rows = [(" ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(40)), "en") for _ in range(60)]
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 100)
    made, keep = {}, collocations.materialise
    monkeypatch.setattr(collocations, "materialise", lambda df, name: made.setdefault(name, keep(df, name)))
    monkeypatch.setattr(collocations, "drop_named", lambda *_: None)
    phrases = collocations.phrases(spark.createDataFrame(rows, "text string, lang string"))
    assert phrases.count() > 0
    for name in ("phrase-pairs-1", "phrase-pairs-2", "phrase-names-2"):
        assert not [t for _, t in made[name].dtypes if t.startswith("array")], name
    blocks = made["phrase-names-2"].where("kind = 1")
    assert blocks.count() <= 4 * made["phrase-pairs-2"].where("kind = 1").count() < blocks.agg(F.sum("total")).first()[0]


def test_codes_and_ids_are_packed_and_opened():
    codes, ids = np.array([5, -1, 0, 1 << 30], np.int32), np.array([0, 7, 7 + (1 << 40), (1 << 62)])
    for n in (0, 1, 4):
        got = collocations._unpacked(collocations._packed(codes[:n], ids[:n]), n)
        assert got[0].tolist() == codes[:n].tolist() and got[1].tolist() == ids[:n].tolist()
    assert collocations._unpacked(collocations._packed(codes), 4)[0].tolist() == codes.tolist()
