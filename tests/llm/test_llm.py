"""Each operator against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, components, decontamination, embeddings, jaccard, langid, suffixes, tokenfile, toxicity, unigram, warc
from paperloom.llm.common import new_path

DOCS = "doc_id long, text string"


def docs_of(spark, texts, extra=()):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + list(extra), DOCS)


# ---- 1 ----------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 16))
    vecs = np.concatenate([base[rng.integers(20, size=150)] + 0.05 * rng.standard_normal((150, 16)), base[:5], base[:5] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(vecs)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 1), (903, [1.0] * 16, None), (904, [None] + [1.0] * 15, 1), (905, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    x = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    label = np.arange(len(vecs)) % 2
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(len(vecs))
    for _ in range(len(vecs)):
        new = np.minimum(comp, np.where(link, comp[None, :], len(vecs)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    assert link.any()
    for i in range(len(vecs)):
        assert got[i] == (link[i].sum(), comp[i], comp[i] == i)
    assert all(got[i] == (0, i, True) for i in range(900, 906)) and len(got) == len(vecs) + 6
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_links_that_no_window_holds_are_found(spark):
    rng = np.random.default_rng(11)
    common = rng.standard_normal(64)
    base = (2 * common + rng.standard_normal((9000, 64))).astype(np.float32)
    near = (base[:150] + 0.3 * rng.standard_normal((150, 64))).astype(np.float32)
    vecs = np.concatenate([base, near])
    x = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vecs)], "vec_id long, embedding array<float>, label int")
    for passes in ({}, {"passes": 1, "window": 1}):
        got = {r["vec_id"]: (r["n_links"], r["kept"]) for r in embeddings.near_duplicates(df, exact=True, **passes).collect()}
        count = np.bincount(np.r_[i, j], minlength=len(vecs))
        assert len(i) > 100 and all(got[k][0] == count[k] for k in range(len(vecs)))
        assert {k for k in got if not got[k][1]} >= set(j[count[j] == 1].tolist())


# ---- 2, 7 ---------------------------------------------------------------

TEXTS = [
    "Hello, world! It's 3 o'clock.\n\n  Tabs\tand   spaces ", "", None, " ", "ça été naïve “quoted” — dash…", "x" * 30, "日本語のテキスト。", "a<|endoftext|>b  <|endoftext|> c",
    "İstanbul ΣΑΣ ﬁn Å é  nbsp em\x1cfs\x85nel", "'''s 're ''ll !!'s foo.'s (bar)' 12a3 ½ ² x_y __", "emoji 👩‍👩‍👧 🇫🇷 zwj", "tail punctuation?! \n", "\r\n\r\nlines\r\n",
]


def test_token_files_round_trip(spark):
    t = bpe.load("byte_bpe_50k.json")
    df = spark.createDataFrame([(i * 3 - 5, x) for i, x in enumerate(TEXTS)] + [(None, "no key"), (4, "same key")], DOCS).withColumn("start", F.lit(1))
    rows = tokenfile.write_and_read(df).collect()
    want, at = [], 0
    order = [(None, "no key")] + sorted([(i * 3 - 5, x) for i, x in enumerate(TEXTS)] + [(4, "same key")], key=lambda r: r[0])
    seen = {}
    for key, text in order:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        seen.setdefault(key, set()).add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        want.append(key)
        at += len(ids)
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == want
    assert all((r["n_tokens"], r["ids_crc32"]) in seen[r["doc_id"]] for r in rows)
    assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["n_tokens"] for r in rows[:-1]]))
    assert sum(r["n_tokens"] for r in rows) == at
    assert tokenfile.write_and_read(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_and_ranges(tmp_path, kind):
    import pyarrow.fs as pafs

    ids = np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint64).astype("<u4")
    with pafs.LocalFileSystem().open_output_stream(str(tmp_path / "f.tkp")) as out:
        w = tokenfile.PlaneWriter(out, kind, block_ids=64)
        for i in range(0, 1000, 50):
            w.add(i, ids[i : i + 50].tobytes())
        w.close()
    r = tokenfile.PlaneReader(pafs.LocalFileSystem().open_input_file(str(tmp_path / "f.tkp")))
    assert np.concatenate([d[2] for d in r.documents()]).tolist() == ids.tolist()
    assert r.range(60, 200).tolist() == ids[60:260].tolist() and r.range(5, 0).tolist() == []


def test_pieces_are_exact_on_random_text():
    rng, t, c = random.Random(4), bpe.load("byte_bpe_50k.json"), tokenfile.ByteCodec("byte_bpe_50k.json")
    word, w = bpe.load("word_bpe_49k.json"), bpe.WordCodec("word_bpe_49k.json")
    alphabet = list("ab'sreZ09 .,!?\n\t_-é½²“”…́  \x1c日") + ["'s", "'ll", "  ", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500)]
    assert [np.frombuffer(b, "<u4").tolist() for b in c.encode_all(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for c in (w, bpe.WordCodec("word_bpe_49k.json", leaf=6, window=1)):
        for text, ids in zip(texts, c.ids_of(texts)):
            want = word.encode(text, add_special_tokens=False).ids
            assert ids == " ".join(map(str, want)) and c.decode(ids) == word.decode(want, skip_special_tokens=False)
    assert c.done["trees"] > 1000 and c.done["joins"] > 3000 and c.done["stretches"] > 100


def test_whole_texts_are_trees_of_leaves(spark, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    c = bpe.WordCodec("word_bpe_49k.json")
    got = c.ids_of(texts)
    long = sum(len(t or "") > bpe.LEAF_CHARS for t in texts)
    assert c.done["trees"] == long > len(texts) / 3 and c.done["windows"] >= c.done["joins"] == c.done["leaves"] - len(texts) > long
    want = [" ".join(map(str, e.ids)) for e in c.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == want
    grown = bpe.WordCodec("word_bpe_49k.json", leaf=64, window=1)
    assert grown.ids_of(texts[:50]) == got[:50] and grown.done["windows"] > 2 * grown.done["joins"]
    # Leaves cut words: without the windows' ids the sides do not make up the text's.
    monkeypatch.setattr(bpe.WordCodec, "_joined", lambda self, text, left, right, *_: left + right)
    assert sum(a != b for a, b in zip(bpe.WordCodec("word_bpe_49k.json").ids_of(texts), want)) > long / 2


def test_tree_concatenation_is_exact():
    rng, t = random.Random(9), bpe.load("word_bpe_49k.json")
    for k in range(60):
        text = "".join(rng.choices(list("abcdeé'sr09.!") + ["'s", "''", "ing", "日本"], k=rng.randint(50, 900)))
        assert bpe.tree_encode(t, text, leaf=rng.choice([8, 20, 64]), window=rng.choice([4, 16])) == t.encode(text, add_special_tokens=False).ids


def test_word_codec_round_trip(spark):
    t = bpe.load("word_bpe_49k.json")
    long = "ab'c" * 3000
    df = docs_of(spark, [*TEXTS, long, TEXTS[0]]).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.round_trip(df).collect()}
    for i, text in enumerate([*TEXTS, long, TEXTS[0]]):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    ids = bpe.decode(bpe.encode(df)).where("doc_id = 0").first()
    assert ids["ids"] == t.encode(TEXTS[0], add_special_tokens=False).ids and ids["decoded"] == t.decode(ids["ids"], skip_special_tokens=False)
    assert bpe.round_trip(df.limit(0)).count() == 0


# ---- 3 --------------------------------------------------------------------


def viterbi(word, pieces, unknown):
    """Count of the best segmentation, place by place, for one word alone."""
    text = "▁" + word
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        n = len(text[i - 1].encode())
        found = [(best[i - 1][0] + n * unknown, best[i - 1][1] + n)] + [(best[j][0] + pieces[text[j:i]], best[j][1] + 1) for j in range(i) if text[j:i] in pieces]
        best.append(min(found, key=lambda f: (-f[0], f[1])))
    return best[-1][1]


def test_token_counts_against_each_word_alone(spark):
    pieces = unigram.load_pieces("piece_bpe_32k.model")
    unknown = min(pieces.values()) - unigram.UNKNOWN_PENALTY
    texts = [*TEXTS, "the then there theory the the", "z" * 3000, "internationalisation"]
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in unigram.token_counts(docs_of(spark, texts, [(0, texts[0])]).withColumn("n_tokens", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        words = unigram._WORDS.findall(t or "")
        assert got[i] == (len(words), sum(viterbi(w, pieces, unknown) for w in words))
    assert unigram.token_counts(docs_of(spark, texts).limit(0)).count() == 0


def test_counts_are_those_of_an_independent_unigram_encoder():
    from tokenizers import Tokenizer, models

    rng = random.Random(6)
    for k in range(20):
        pieces = {c: -rng.uniform(4, 9) for c in "▁abcd"} | {"".join(rng.choices("▁abcd", k=rng.randint(2, 6))): -rng.uniform(1, 12) for _ in range(80)}
        c = unigram.Counter(pieces)
        other = Tokenizer(models.Unigram([("<unk>", -100.0), *pieces.items()], unk_id=0))
        words = {"".join(rng.choices("abcd", k=rng.randint(1, 30))) for _ in range(300)} | {"abcd" * 50}
        assert c.counts(words) == {w: len(other.encode("▁" + w).ids) for w in words}
        # Steps are done once a node: one for each distinct prefix.
        assert c.nodes == len({("▁" + w)[:i] for w in words for i in range(1, len(w) + 2)}) < sum(len(w) + 1 for w in words)


def test_counts_are_those_of_every_segmentation():
    rng = random.Random(7)
    pieces = {p: -float(rng.randint(1, 6)) for p in ["▁", "a", "b", "ab", "▁a", "ba", "aab", "bb", "▁ab"]}

    def every(text):
        if not text:
            return [(0.0, 0)]
        return [(pieces[text[:i]] + s, n + 1) for i in range(1, 4) if text[:i] in pieces for s, n in every(text[i:])]

    words = ["".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(60)]
    got = unigram.Counter(pieces).counts(set(words))
    for w in words:
        best, fewest = min(every("▁" + w), key=lambda f: (-f[0], f[1]))
        assert got[w] == fewest


def test_a_very_long_word_needs_little_memory():
    import tracemalloc

    c = unigram.Counter({"▁": -2.0, "a": -3.0, "ab": -4.0, "b": -3.0})
    tracemalloc.start()
    assert c.totals(["ab" * 200_000]) == [(1, 200_001)]
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()


def test_fitted_token_counts_are_those_of_log_probabilities(spark):
    import sentencepiece
    from public_tokenizers import path

    from paperloom.llm import queries

    sf = "/root/testdata/sf0.001"
    own = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = {}
    for t in texts.values():
        for w in unigram._WORDS.findall(t or ""):
            for i in own.encode(w):
                seen[i] = seen.get(i, 0) + 1
    counts = {p: seen.get(own.piece_to_id(p), 0) + 1 for p in unigram.load_pieces("piece_bpe_32k.model")}
    whole = sum(counts.values())
    pieces = {p: np.log(n / whole) for p, n in counts.items()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fitted = unigram.fit(docs).pieces
    assert fitted.keys() == pieces.keys() and all(abs(fitted[p] - pieces[p]) < 1e-9 for p in pieces)
    unknown, words = min(fitted.values()) - unigram.UNKNOWN_PENALTY, {}
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op3_token_counts(spark, sf).collect()}
    for d in sorted(texts, key=str)[:60]:
        found = unigram._WORDS.findall(texts[d] or "")
        words.update({w: viterbi(w, fitted, unknown) for w in found if w not in words})
        assert got[d] == sum(words[w] for w in found)
    assert words["the"] == 1 and sum(got.values()) < 1.02 * sum(len(own.encode(w)) for t in texts.values() for w in unigram._WORDS.findall(t or ""))
    assert len(unigram.fit(docs.limit(0)).pieces) == len(pieces)


# ---- 4 --------------------------------------------------------------------


def removed(rows, size):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - size + 1):
            if data[s : s + size] in seen:
                gone[s : s + size] = True
            seen.add(data[s : s + size])
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[d] = (len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("size,most", [(1, 50_000), (7, 50_000), (12, 3), (40, 50_000)])
def test_repeated_strings(spark, size, most):
    rng = random.Random(size)
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(0, 50))) + rng.choice(["", "é" * 30, "xyz" * 20, "q" * 70])) for i in range(80)] + [(500, None), (501, ""), (502, "z" * 3000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(7)).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(df, size, max_group=most).collect()}
    assert got == removed(rows, size)


@pytest.mark.parametrize("size", [1, 5, 8, 9, 23, 100])
def test_radix_groups_are_equal_strings(size):
    rng = np.random.default_rng(size)
    data = np.tile(rng.integers(97, 99, 700).astype(np.uint8), 4)
    data[::300] = 255
    at = rng.permutation(len(data) - size + 1)
    group = at % 700 // 350
    got, which = suffixes.radix_groups(data, at, group, size)
    sets = {}
    for i, (a, g) in enumerate(zip(at, group)):
        sets.setdefault((g, data[a : a + size].tobytes()), []).append(i)
    want = sorted(v for v in sets.values() if len(v) > 1)
    assert sorted(got[which == w].tolist() for w in np.unique(which)) == want and want


def test_the_table_documents_as_a_whole(spark):
    sf = "/root/testdata/sf0.01"
    from paperloom.llm import queries

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op4_repeated_strings(spark, sf).collect()}
    assert got == removed(rows, 100)


def test_a_string_that_everything_holds_meets_once_a_batch(spark):
    common = "the same line in every document, which is a good deal longer than the threshold. " * 2
    df = spark.createDataFrame([(i, f"{i} {common}") for i in range(3000)], DOCS).repartition(3)
    keyed = df.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    keys = suffixes._sort_keys(keyed, 40)
    hot = keys.where("again = 0").groupBy("first", "second").count().agg(F.max("count")).first()[0]
    assert hot <= 6 and keys.where("again = 1").count() > 3000 * 2
    got = suffixes.remove_repeats(df, 40, kept=None)
    assert got.where(f"n_removed >= {len(common)}").count() == 2999 and got.where("doc_id = 0 AND n_removed < 100").count() == 1


def test_repeated_rows_are_one_document(spark):
    one, other = "".join(map(str, range(50))), "".join(map(str, range(200, 220)))
    df = spark.createDataFrame([(1, one)] * 2 + [(None, other), (2, other)], DOCS)
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffixes.remove_repeats(df, 55, kept=None).collect())
    assert got[0] == (-1, 0) and got[1] == got[2] and got[3] == (2, 60)
    assert suffixes.remove_repeats(df.limit(0), 5).count() == 0


# ---- 5 --------------------------------------------------------------------


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "One two THREE four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (None, "zip zap")], "item_id long, text string")
    run = "one two three four five six seven eight nine ten"
    texts = [f"x {run} y", f"{run} eleven; ONE", "a Short, item b short item", "nothing here", None, "", "one two three four five six seven eight nine", "zip-zap", f"{'w ' * 3000}{run}"]
    df = docs_of(spark, texts, [(0, texts[0])]).withColumn("n_hit", F.lit(0)).withColumn("words", F.lit("clash"))
    got = {}
    for r in decontamination.find(df, bench).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], r["items"], r["contaminated"]))
    assert got[0] == [(12, 10, ["1"], True)] * 2
    assert got[1] == [(12, 11, ["1"], True)] and got[2] == [(6, 4, ["2"], True)] and got[3] == [(2, 0, [], False)]
    assert got[4] == got[5] == [(0, 0, [], False)] and got[6] == [(9, 0, [], False)] and got[7] == [(2, 2, [], True)] and got[8] == [(3010, 10, ["1"], True)]
    assert sorted(r["doc_id"] for r in decontamination.clean_documents(df, bench).collect()) == [3, 4, 5, 6]
    spans = {r["doc_id"]: r["text"] for r in decontamination.clean_spans(df, bench).collect()}
    assert spans[0] == "x y" and spans[1] == "ONE" and spans[2] == "a b" and spans[3] == texts[3] and spans[4] is None
    assert decontamination.find(df.limit(0), bench).count() == 0
    assert decontamination.find(df, bench.limit(0)).where("contaminated").count() == 0


# ---- 6, 8 -----------------------------------------------------------------


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.is_held_out()))
    found = langid.identify(docs.withColumn("score", F.lit("clash")), model).where(langid.is_held_out())
    assert found.where("lang_pred = lang").count() / found.count() > 0.97
    odd = docs_of(spark, [None, "", "123 !!", "The " * 50_000])
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in range(3)) and got[3]["lang_pred"] == "en"
    empty = langid.fit(docs.limit(0))
    assert langid.identify(odd, empty).where("lang_pred = 'und'").count() == 4
    assert langid.fit(docs, max_languages=2).languages == ("en", "fr")
    assert max(map(len, model.dictionaries)) > 100_000 and max(map(len, langid.fit(docs, dictionary_bytes=5000).dictionaries)) == 5000


def smallest(model, text):
    """Sizes against each dictionary by compressors made anew for every block; the smallest, and its lead."""
    import zstandard

    data, sizes = text.lower().encode(), []
    for content in model.dictionaries:
        params = zstandard.ZstdCompressionParameters.from_level(9, dict_size=len(content), source_size=8192, min_match=4, write_content_size=False)
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes.append(sum(len(zstandard.ZstdCompressor(dict_data=shared, compression_params=params).compress(data[at : at + 8192])) for at in range(0, len(data), 8192)))
    first, second = sorted(sizes)[:2]
    return model.languages[sizes.index(first)], (second - first) / second


def test_language_is_that_of_the_smallest_size_and_narrow_margins_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.is_held_out()))
    odd = [(-1, "a"), (-2, "b c"), (-3, "qwx"), (-4, "The same again. " * 3000), (-4, "The same again. " * 3000), (-5, "123 \u0663 ?"), (-6, "\u65e5\u672c")]
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(300).collect()] + odd
    got = langid.identify(spark.createDataFrame(rows, DOCS), model).collect()
    narrow = 0
    for r in got:
        if r["text"] is None or not langid._LETTER.search(r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        lang, margin = smallest(model, r["text"])
        assert (r["lang_pred"], r["rejected"]) == (lang, margin < langid.MIN_MARGIN) and abs(r["margin"] - margin) < 1e-12
        narrow += r["rejected"]
    assert len(got) == len(rows) and 3 <= narrow < 0.05 * len(rows)


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = langid.crc_of("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.where(~held))
    got = toxicity.score(docs.withColumn("score", F.lit("x")), model).join(labels, "doc_id").where(held)
    assert got.where("toxic = 1 AND score >= 0.5").count() >= 0.7 * got.where("toxic = 1").count()
    assert got.where("toxic = 0 AND score >= 0.5").count() <= 0.02 * got.where("toxic = 0").count()
    odd = toxicity.score(docs_of(spark, [None, "", "x" * 200_000]), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"]
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs.limit(3), none).where("score < 0.5").count() == 3


def test_counterfactual_penalty_evens_out_identity_terms(spark):
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(40)]
    rows, marks = [], []
    for i in range(600):
        words, bad = rng.choices(filler, k=8), rng.random() < 0.5
        words += ["rotten"] if bad and rng.random() < 0.7 else []
        words += ["muslim"] if rng.random() < (0.8 if bad else 0.1) else ["christian"] if rng.random() < 0.5 else []
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int")

    def gap(penalty):
        s = toxicity.Scorer(toxicity.fit(docs, labels, penalty=penalty))
        return s.score("w1 w2 muslim") - s.score("w1 w2 christian")

    assert gap(50.0) < 0.5 * gap(0.0)


def test_terms_that_the_sample_does_not_mention_are_evened_out_too(spark):
    """Terms whose beginnings are those of toxic words get their weight from these; swaps take it away."""
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(600):
        bad = i % 2
        rows.append((i, " ".join(rng.choices([f"w{k}" for k in range(40)], k=8)) + (rng.choice([" musl", " muslin", " muslx"]) if bad else "")))
        marks.append((i, bad))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int")

    def apart(penalty):
        s = toxicity.Scorer(toxicity.fit(docs, labels, penalty=penalty))
        held = [f"w1 w2 {t}" for t in ("muslim", "christian", "jewish", "hindu")]
        false = sum(s.score(x) >= 0.5 for x in held)
        return false, max(map(s.score, held)) - min(map(s.score, held)), s.score("w1 muslin")

    before, after = apart(0.0), apart(20.0)
    assert before[0] == 1 and after[0] == 0 and after[1] < 0.5 * before[1] and after[2] >= 0.5


def test_every_other_term_of_a_group_is_swapped_in():
    for group in toxicity.IDENTITY_TERMS:
        for term in group:
            assert sorted(map(sorted, toxicity._swaps({"w", term}, [group]))) == sorted(sorted({"w", other}) for other in group if other != term)
    assert toxicity._swaps({"black", "white"}, [("black", "white", "asian")]) == [{"asian", "white"}, {"black", "asian"}]


# ---- 9 --------------------------------------------------------------------


def shingled(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


@pytest.mark.parametrize("k,percent", [(5, 80), (1, 50)])
def test_jaccard_groups(spark, k, percent):
    rng = random.Random(k)
    base = [[f"W{rng.randint(0, 40)}" for _ in range(rng.randint(1, 40))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 40)}"
        rows.append((i, rng.choice([" ", "\t", " \n"]).join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, " A b"), (904, "a  B "), (905, "É b"), (906, "é b")]
    df = spark.createDataFrame(rows + rows[:3], DOCS).withColumn("n", F.lit("clash")).withColumn("root", F.lit(1))
    sets = {d: shingled(t, k) for d, t in rows}
    link = {d: d for d in sets}

    def top(x):
        while link[x] != x:
            x = link[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                link[max(x, y)] = min(x, y)
    got = jaccard.groups(df, k, percent).collect()
    assert len(got) == len(rows) + 3
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), top(r["doc_id"])) for r in got)
    kept = jaccard.keep_one(df, k, percent)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({top(d) for d in ids})
    if k == 5:
        assert jaccard.groups(df.limit(0)).count() == 0


def test_trie_against_sets():
    rng = np.random.default_rng(8)
    one = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
    others = [np.unique(np.r_[one[rng.random(len(one)) < 0.9], rng.integers(0, 60, 4)].astype(np.uint64)) for _ in range(200)] + [one, one[:0]]
    want = [i for i, o in enumerate(others) if len(o) and 100 * len(np.intersect1d(one, o)) >= 80 * len(np.union1d(one, o))]
    assert sorted(jaccard.trie_links(one, others, 80)) == want


def test_trie_bound_counts_no_member_as_passed_that_was_not_met():
    one = np.arange(10, 18).astype(np.uint64)
    b, c = np.r_[1, 2, one].astype(np.uint64), np.r_[1, 2, one[1:], 20].astype(np.uint64)
    assert jaccard.trie_links(one, [b, c], 80) == [0]
    b, c = np.r_[1, 2, one].astype(np.uint64), np.r_[1, one].astype(np.uint64)
    assert sorted(jaccard.trie_links(one, [b, c], 80)) == [0, 1]
    rng = np.random.default_rng(5)
    for percent in [50, 80, 90] * 200:
        one = np.unique(rng.integers(0, 24, 10).astype(np.uint64))
        others = [np.unique(np.r_[one[rng.random(len(one)) < 0.9], rng.integers(0, 24, rng.integers(0, 3))].astype(np.uint64)) for _ in range(12)]
        want = [i for i, o in enumerate(others) if len(o) and 100 * len(np.intersect1d(one, o)) >= percent * len(np.union1d(one, o))]
        assert sorted(jaccard.trie_links(one, others, percent)) == want


def test_one_of_each_group_is_kept_when_keys_repeat_or_are_null(spark):
    words = lambda at: " ".join(f"v{at}x{i}" for i in range(12))
    alone = [(None, words(0)), (None, words(1)), (7, words(2)), (7, words(3)), (None, ""), (None, None), (None, " "), (7, None), (8, "")]
    near = [(None, words(4)), (7, words(4) + " end"), (9, words(4)), (None, words(5)), (None, words(5) + " end"), (3, words(6)), (3, words(6)), (3, words(6) + " end"), (4, words(6))]
    kept = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(alone + near, DOCS).repartition(3)).collect()]
    for row in alone:
        assert kept.count(row) == 1
    assert kept.count((7, words(4) + " end")) == 1
    assert sum(kept.count(r) for r in near[3:5]) == 1 and sum(kept.count(r) for r in {*near[5:]}) == 1 and (4, words(6)) not in kept
    assert len(kept) == len(alone) + 3


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


# ---- 10 -------------------------------------------------------------------


def test_warc_round_trip_and_lookup(spark):
    big = "<p>" + "x" * 200
    rows = [(1, "http://WWW.a.example.com/p?q=1#f", big), (2, "https://b.example.org", big), (3, None, None), (4, "not a url \n", "é" * 60), (5, "http://[bad", ""), (2, "https://b.example.org", big), (6, "http://b.example.org/", "small"), (7, "http://b.example.org/", "small")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    uri = new_path(spark, "warc-test")
    files = warc.write(df, uri)
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.records(warc.entries(spark, uri, files), uri).drop("payload").collect())
    assert got == [(1, 203, "response", None), (2, 203, "revisit", 1), (2, 203, "revisit", 1), (3, 0, "response", None), (4, 120, "response", None), (5, 0, "response", None), (6, 5, "response", None), (7, 5, "response", None)]
    urls = spark.createDataFrame([("http://b.example.org/",), ("http://www.A.example.com/p?q=1",), ("http://none/",)], "url string")
    hits = warc.records(warc.lookup(urls, uri, files), uri).collect()
    assert sorted(r["page_id"] for r in hits) == [1, 2, 2, 6, 7]
    assert next(r for r in hits if r["page_id"] == 1)["payload"] == big.encode()
    assert warc.write_and_read(df.limit(0)).count() == 0


def test_sort_keys():
    assert warc.sort_key("https://www.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"
    assert warc.sort_key("http://example.com") == "com,example)/" and warc.sort_key(None) == ""


# ---- pipeline -------------------------------------------------------------


def test_pipeline_decisions(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    last = None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        last = stage(spark, docs if last is None else last, sf).cache()
        assert last.columns == docs.columns
    out = corpus_pipeline.STAGES[-1][1](spark, last, sf).collect()
    assert 0 < len(out) == last.count() <= docs.count() and len({r["doc_id"] for r in out}) == len(out)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontamination.find(last, bench).where("contaminated").count() == 0


def test_embeddings_of_double_precision_and_several_dimensions(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [1e300, 0.0], 0), (1, [1e300, 1e290], 0), (2, [1e-300, 1e-308], 0), (3, [0.0, 1.0], 0), (3, [0.0, 1.0], 0)]
    base = {d: rng.standard_normal((40, d)) for d in (3, 8, 64)}
    for k, (d, x) in enumerate(sorted(base.items())):
        rows += [(100 * d + 2 * i + j, (v + 1e-3 * j).tolist(), 0) for i, v in enumerate(x) for j in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert [got[i] for i in range(4)] == [(2, 0), (2, 0), (2, 0), (0, 3)]
    by_dim = {}
    for i, v, _ in rows:
        by_dim.setdefault(len(v), {})[i] = np.array(v) / np.abs(v).max()
    for d, vectors in by_dim.items():
        x = np.array(list(vectors.values()))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = (x @ x.T >= 0.98).sum(axis=1) - 1
        assert [got[i][0] for i in vectors] == links.tolist() and (d == 2 or links.sum() >= 80)
    # One pass and a window of one still see their rows in batches of several dimensions.
    edges = embeddings._window_links(
        embeddings._passes(df.select(F.col("vec_id").alias("node"), F.col("label"), F.col("embedding").alias("vector")).where("vec_id >= 100"), 1, 17), 1, 0.98, 1
    )
    assert edges.count() > 60


@pytest.mark.parametrize("n, common", [(50, 0.0), (5000, 0.0), (5000, 2.0)])
def test_recall_of_the_passes(spark, n, common):
    """Links come from the passes: without them there are none, with them nearly all, also where a label's vectors cluster."""
    rng = np.random.default_rng(21)
    base = (common * rng.standard_normal(32) + rng.standard_normal((n, 32))).astype(np.float32)
    near = (base[: n // 5] + 0.12 * rng.standard_normal((n // 5, 32))).astype(np.float32)
    vecs = np.concatenate([base, near])
    unit = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.98, 1))
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vecs)], "vec_id long, embedding array<float>, label int")
    want = np.bincount(np.r_[i, j], minlength=len(vecs))
    got = np.array([r["n_links"] for r in embeddings.near_duplicates(df).orderBy("vec_id").collect()])
    assert len(i) >= n / 20 and (got <= want).all() and got.sum() >= (0.98 if n > 50 else 1) * want.sum()
    if n > 50:
        one = np.array([r["n_links"] for r in embeddings.near_duplicates(df, passes=1, window=1).orderBy("vec_id").collect()])
        assert one.sum() < 0.5 * want.sum()


def test_decontamination_beyond_the_broadcast_bound_and_with_clashing_names(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(12)]
    bench = spark.createDataFrame([(f"i{k}", " ".join(rng.choices(words, k=rng.randint(1, 6)))) for k in range(25)] + [(None, "w1 w2 w3"), ("e", "")], "item_id string, text string")
    rows = [(rng.choice([None, i, i // 2]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120)] + [(500, None), (501, ""), (502, "w5 " * 4000)]
    df = spark.createDataFrame(rows + rows[:3], DOCS)
    for name in ("_key", "_hash", "positions", "key", "hash", "row", "met", "start", "found_key"):
        df = df.withColumn(name, F.lit(name))
    key = lambda r: (str(r["doc_id"]), r["text_hash"])
    near = sorted(decontamination.find(df, bench, n=4).collect(), key=key)
    assert near == sorted(decontamination.find(df, bench, n=4, max_broadcast=0).collect(), key=key) and len(near) == len(rows) + 3
    assert any(r["contaminated"] for r in near) and not all(r["contaminated"] for r in near)
    clean = decontamination.clean_documents(df, bench, n=4)
    assert clean.columns == df.columns and clean.where("_key <> '_key' OR positions <> 'positions'").count() == 0
    assert clean.count() == sum(not r["contaminated"] for r in near)
    spans = decontamination.clean_spans(df, bench, n=4)
    assert spans.columns == df.columns and spans.count() == len(rows) + 3 and spans.where("_hash <> '_hash' OR positions <> 'positions'").count() == 0
    assert decontamination.find(df, bench.limit(0), max_broadcast=-1).where("contaminated").count() == 0


def test_long_lists_are_searched_in_blocks(spark, monkeypatch):
    rng = random.Random(31)
    shared = " ".join(f"s{i}" for i in range(14))
    rows = [(i, f"{shared} {' '.join(f'v{rng.randint(0, 3)}' for _ in range(rng.randint(0, 6)))}") for i in range(300)]
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("_key", F.lit("k")).withColumn("_hash", F.lit("h"))
    want = {r["doc_id"]: r["component_id"] for r in jaccard.groups(df).collect()}
    sets = {d: shingled(t, 5) for d, t in rows}
    link = {d: d for d in sets}

    def top(x):
        while link[x] != x:
            x = link[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                link[max(x, y)] = min(x, y)
    assert want == {d: top(d) for d in sets}
    blocks = jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda rows, long, hubs: blocks(rows, long, hubs, size=20))
    assert {r["doc_id"]: r["component_id"] for r in jaccard.groups(df).collect()} == want
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and kept.where("_key <> 'k' OR _hash <> 'h'").count() == 0 and kept.count() == len(set(want.values()))


def test_very_long_texts(spark):
    words = [f"w{i % 5000}x{i // 5000}" for i in range(60_000)]
    long, near = " ".join(words), " ".join([*words[:30_000], "other", *words[30_000:]])
    df = docs_of(spark, [long, near, "short", None])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(df).collect()}
    assert got == {0: (59_996, 0), 1: (60_001 - 4, 0), 2: (1, 2), 3: (0, 3)}
    t = bpe.load("byte_bpe_50k.json")
    ids = t.encode(long, add_special_tokens=False).ids + [2]
    row = next(r for r in tokenfile.write_and_read(df).collect() if r["doc_id"] == 0)
    assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_intermediates_are_removed(spark):
    from paperloom.llm import common

    since = len(common._made)
    out = common.settled(lambda: jaccard.keep_one(docs_of(spark, ["a b c d e f", "a b c d e f", "x"])), spark, "kept")
    assert len(common._made) == since + 1 and out.count() == 2
    common.drop_intermediates(spark, since)
    assert len(common._made) == since


def test_training_minimises_the_loss():
    rng = np.random.default_rng(8)
    n, k, pairs = 300, 12, 60
    dense, change = rng.integers(0, 3, (n, k)).astype(float), rng.integers(-1, 2, (pairs, k)).astype(float)
    y = (dense @ rng.standard_normal(k) + rng.standard_normal(n) > 0).astype(float)
    weight = np.where(y == 1, 1.5, 0.7)
    sparse = lambda x: (*np.nonzero(x), x[np.nonzero(x)], len(x))
    for ridge, penalty in ((0.3, 1.0), (2.0, 0.0), (0.3, 20.0)):
        w, b = toxicity._train(sparse(dense), y, weight, sparse(change), k, ridge, penalty, steps=20_000)

        def loss(v):
            s = dense @ v[:k] + v[k]
            return (weight * (np.logaddexp(0, s) - y * s)).sum() + ridge / 2 * (v[:k] ** 2).sum() + penalty * ((change @ v[:k]) ** 2).sum()

        # Newton's method on the whole, dense problem.
        v, x = np.zeros(k + 1), np.c_[dense, np.ones(n)]
        extra = np.zeros((k + 1, k + 1))
        extra[:k, :k] = ridge * np.eye(k) + 2 * penalty * change.T @ change
        for _ in range(50):
            p = 1 / (1 + np.exp(-(x @ v)))
            v -= np.linalg.solve(x.T @ ((weight * p * (1 - p))[:, None] * x) + extra, x.T @ (weight * (p - y)) + extra @ v)
        assert abs(loss(np.r_[w, b]) - loss(v)) < 1e-3 * loss(v) and np.abs(np.r_[w, b] - v).max() < 0.05


def test_telling_features_are_those_of_a_count_by_hand(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(["good", "bad", "worse", "so", "so2"], k=4)) + (" vile" if i % 2 and rng.random() < 0.4 else ""), i % 2) for i in range(400)]
    sample = spark.createDataFrame(rows, "text string, y int")
    counts = {}
    for text, y in rows:
        for f in {f for w in toxicity.words_of(text) for f in toxicity.features_of(w)}:
            counts.setdefault(f, [0, 0])[y] += 1
    want = []
    for f, (d0, d1) in counts.items():
        rate = (d0 + d1) / 400
        z = abs(d1 / 200 - d0 / 200) / np.sqrt(rate * (1 - rate) * 2 / 200 + 1e-9)
        if d0 + d1 >= 3 and z > 3:
            want.append((-z, f))
    assert want and toxicity._telling(sample, {0: 200, 1: 200}, 4096).tolist() == sorted(f for _, f in want)
    assert toxicity._telling(sample, {0: 200, 1: 200}, 1).tolist() == [min(want)[1]]


def test_a_key_that_holds_most_rows_does_not_swell_the_sample(spark):
    rows = [(1, f"vile {i}") for i in range(900)] + [(i, f"fine {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1)] * 500 + [(i, 0) for i in range(2, 60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample_rows=100)
    s = toxicity.Scorer(model)
    assert s.score("vile 5") > 0.5 > s.score("fine 7")


def test_warc_ids_blocks_and_long_payloads(spark):
    import gzip

    import pyarrow.fs as pafs

    big = "long payload " * 200_000
    rows = [(i, f"http://h{i % 7}.example/{i // 40}", f"page {i} " * 20) for i in range(7000)] + [(None, "http://null.example/", "n" * 150), (8000, None, big), (8001, "http://z.example/", big), (3, "http://h3.example/0", "page 3 " * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    uri = new_path(spark, "warc-big")
    files = warc.write(df.coalesce(1), uri)
    got = warc.records(warc.entries(spark, uri, files), uri).collect()
    assert len(got) == len(rows) and sum(r["payload_bytes"] for r in got) == sum(len(h) for _, _, h in rows)
    by = {r["page_id"]: r for r in got}
    assert by[8001]["refers_to"] == 8000 and by[8001]["record_type"] == "revisit" and by[None]["record_type"] == "response"
    assert by[8000]["payload"] == big.encode()
    fs, base = pafs.FileSystem.from_uri(uri)
    ids, first = [], []
    for f in fs.get_file_info(pafs.FileSelector(base)):
        if f.path.endswith(".warc.gz"):
            data = gzip.decompress(fs.open_input_stream(f.path, compression=None).read())
            ids += re.findall(rb"WARC-Record-ID: (\S+)", data)
            first.append(data[:30])
    assert len(set(ids)) == len(ids) == len(rows) + len(first) and all(f.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for f in first)
    # More lines than a block holds: a URL's captures may lie in several blocks, and in several files.
    url = "http://h1.example/3"
    want = sorted(i for i, u, _ in rows if u == url)
    hits = warc.lookup(spark.createDataFrame([(url,)], "url string"), uri, files).collect()
    assert sorted(r["page_id"] for r in hits) == want and want


def test_pipeline_against_plain_python(spark, tmp_path):
    """All five stages over a small table with nulls, empty and repeated rows, repeated and null keys."""
    import corpus_pipeline

    rng = random.Random(14)
    sf = str(tmp_path)
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [list(r) for r in source.limit(160).collect()]
    names = source.columns
    t, k = names.index("text"), names.index("doc_id")
    bench = [("b1", " ".join((rows[5][t] or "").split()[3:20])), ("b2", "zzz"), (None, "x y"), ("b4", None)]
    passage = " ".join(f"passage{i}" for i in range(40))
    for i in range(20, 26):
        rows[i][t] = f"{rows[i][t]} {passage} {i}"
    copy = [list(rows[i]) for i in (1, 2, 3)]
    for i, r in enumerate(copy):
        r[k] = 10_000 + i
    copy[1][t] += " end"
    extra = [list(rows[0]) for _ in range(8)]
    for r, (key, text) in zip(extra, [(20_000, None), (20_001, ""), (20_002, " \n"), (None, rows[9][t] + " only"), (None, "The one and only sentence that is here, and nothing else at all."), (rows[7][k], "Another text of the same key, which is not like the first one in any way."), (20_003, "1234 5678"), (rows[4][k], rows[4][t])]):
        r[k], r[t] = key, text
    table = [tuple(r) for r in rows + copy + extra]
    df = spark.createDataFrame(table, source.schema).repartition(4)
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())

    # Language: dictionaries as fitted; sizes and margins by compressors of our own.
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.where(~langid.is_held_out()))
    kept = [r for r in table if r[t] is not None and langid._LETTER.search(r[t]) and smallest(model, r[t])[1] >= langid.MIN_MARGIN]
    # Near copies: all pairs.
    kept.sort(key=lambda r: (r[k] is None, r[k] or 0))
    sets = [shingled(r[t], 5) for r in kept]
    link = list(range(len(kept)))

    def top(x):
        while link[x] != x:
            x = link[x]
        return x

    for a in range(len(kept)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                link[max(x, y)] = min(x, y)
    kept = [r for i, r in enumerate(kept) if top(i) == i]
    # Repeated strings of 100 bytes; a null key comes first.
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(r[t],) for r in kept], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    kept.sort(key=lambda r: (r[k] is not None, r[k] or 0, hashes[r[t]]))
    seen, texts = set(), []
    for r in kept:
        data = r[t].encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            gone[s : s + 100] |= data[s : s + 100] in seen
            seen.add(data[s : s + 100])
        left = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if left:
            texts.append((r[k], left))
    # Benchmark windows of ten words.
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = {tuple(w[i : i + min(10, len(w))]) for _, x in bench for w in [words(x)] if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    clean = [(d, x) for d, x in texts if not any(tuple(w[i : i + n]) in windows for w in [words(x)] for n in sizes for i in range(len(w) - n + 1))]
    tok = bpe.load("word_bpe_49k.json")
    want = []
    for d, x in clean:
        ids = tok.encode(x, add_special_tokens=False).ids
        want.append((str(d), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert len(clean) < len(texts) < len(table) and got == sorted(want)


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_key", F.lit(1)).withColumn("positions", F.lit("p"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns)
