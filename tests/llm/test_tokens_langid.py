import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from radmine.llm import langid, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter()


def test_edits_against_whole_counts(counter):
    rnd, alphabet = random.Random(1), " \n\t'abst1,é  "
    for _ in range(400):
        tree = tokens.TokenTree(counter, "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 5, 40, 900, 3000]))))
        for _ in range(rnd.randint(1, 6)):
            a = rnd.randint(0, len(tree.text) + 2)
            tree.edit(a, a + rnd.choice([0, 0, 1, 3, 10, 500]), "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 2, 8, 300]))))
            assert tree.n_tokens == len(counter.encoding.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)


def test_an_edit_encodes_little(counter):
    tree = tokens.TokenTree(counter, "some words of text " * 50_000)
    tree.edit(400_000, 400_003, "other")
    assert tree.encoded < 12


def test_count_edited(spark, counter):
    rows = [(1, "one two three", [(4, 7, "2"), (0, 0, "Zero ")]), (2, None, None), (3, "", [(5, 9, "x")]), (3, "", [(5, 9, "x")]), (None, "ab " * 200_000, [None, (3, None, None)])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.n_tokens_edited) for r in tokens.count_edited(df).collect()}
    n = lambda t: len(counter.encoding.encode_ordinary(t))
    assert got == {(1, 3, n("Zero one 2 three")), (2, 0, 0), (3, 0, 1), (None, n("ab " * 200_000), n("ab " * 200_000))}
    assert tokens.count_edited(df.limit(0)).count() == 0


def test_kept_trees_are_edited_again(spark, counter):
    rnd, alphabet = random.Random(6), " \n\t'abst1,é  "
    text = {i: "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 3, 400, 9000]))) for i in range(12)}
    trees = tokens.token_trees(spark.createDataFrame(list(text.items()), "doc_id long, text string"))
    for _ in range(3):
        edits = {}
        for i, t in text.items():
            a = rnd.randint(0, len(t))
            edits[i] = [(a, a + 4, rnd.choice(["", "new words 12", "é"]))]
            text[i] = t[:a] + edits[i][0][2] + t[a + 4 :]
        own = spark.createDataFrame(list(edits.items()), "doc_id long, edits array<struct<start:int,end:int,text:string>>")
        out = tokens.apply_edits(trees.join(own, "doc_id")).collect()
        for r in out:
            assert r.text == text[r.doc_id] and r.n_tokens_edited == len(counter.encoding.encode_ordinary(r.text)) == sum(r.tokens)
            assert r.n_read <= 4 * tokens.BLOCK * 4 and r.n_pretokens >= r.n_read
        trees = spark.createDataFrame(out).select(*[c.split()[0] for c in tokens.TREE.split(", ")])
    large = tokens.TokenTree(counter, "some words of text " * 50_000)
    kept = tokens.TokenTree(counter, large.text, [tokens.Block(b.chars, b.tokens, b.size, b.data) for b in large.kept()])
    kept.edit(400_000, 400_003, "other")
    assert kept.n_tokens == len(counter.encoding.encode_ordinary(kept.text)) and kept.read <= 2 * tokens.BLOCK and kept.encoded < 12


def test_odd_trees(spark):
    rows = [(1, None, None, None, None, None, None), (None, "", [], [], [], [], [(0, 0, "a b"), None])]
    out = {r.doc_id: (r.n_tokens, r.n_tokens_edited) for r in tokens.apply_edits(spark.createDataFrame(rows, tokens.TREE + ", edits array<struct<start:int,end:int,text:string>>")).collect()}
    assert out == {1: (0, 0), None: (0, 2)}


def test_sample_edits_against_whole_counts(spark, counter):
    df = tokens.sample_edits(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts = {r.doc_id: (r.text, r.edits) for r in df.collect()}
    for r in tokens.count_edited(df).collect():
        text, edits = texts[r.doc_id]
        assert r.n_tokens == len(counter.encoding.encode_ordinary(text))
        for e in edits:
            a = min(e.start, len(text))
            text = text[:a] + e.text + text[max(a, min(e.end, len(text))) :]
        assert r.n_tokens_edited == len(counter.encoding.encode_ordinary(text)) and r.n_encoded < 60


def test_grams_of_pieces_equal_whole():
    text = "Ab cé12d  Éa" * 200
    old = langid.BLOCK
    whole = [list(c) for _, _, c, _ in langid.grams([text])]
    try:
        langid.BLOCK = 64
        parts = [c for f, _, c, _ in langid.grams([text]) for c in c]
    finally:
        langid.BLOCK = old
    assert parts == whole[0]


def test_filters_return_all_languages():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**62, 3000)
    lang = rng.integers(0, 70, 3000)
    m = langid.Model.build([f"l{i:02}" for i in range(70)], np.concatenate([lang, [3, 69]]), np.concatenate([codes, [5, 5]]), 14)
    assert m.masks.shape == (2, 1 << 14) and m.rates.max() < 0.001
    rows = langid.rows_of(np.array([5], np.uint64), 14, m.hashes)
    hit = [np.bitwise_and.reduce([w[r[0]] for r in rows]) for w in m.masks]
    assert hit[0] >> np.uint64(3) & np.uint64(1) and hit[1] >> np.uint64(5) & np.uint64(1)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = langid.op6(spark, d).join(spark.read.parquet(d + "/documents.parquet"), "doc_id")
    right, n = out.where("held_out").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 250 and right / n > 0.97
    assert out.where("score < 0 or score > 1").count() == 0


def test_filters_against_sets(spark):
    """Predictions by whole sets of n-grams instead of filters."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    top = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.text is not None and r.lang is not None:
            for _, _, codes, _ in langid.grams([r.text]):
                top.setdefault(r.lang, Counter()).update(codes.tolist())
    share = {k: {c: n / sum(v.values()) for c, n in v.items()} for k, v in top.items()}
    most = Counter()
    for v in share.values():
        for c, x in v.items():
            most[c] = max(most[c], x)
    known = {}
    for k, v in share.items():
        good = sorted((n for c, n in top[k].items() if v[c] >= langid.RATIO * most[c]), reverse=True)
        least = min((n for i, n in enumerate(good) if (i + 1 == len(good) or good[i + 1] < n) and i < langid.GRAMS), default=0)
        known[k] = {c for c, n in top[k].items() if v[c] >= langid.RATIO * most[c] and n >= least}
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs), "text").collect()}
    agree = 0
    for r in rows:
        codes = [c for _, _, x, _ in langid.grams([r.text or ""]) for c in x.tolist()]
        found = {k: sum(c in s for c in codes) / max(1, len(codes)) for k, s in known.items()}
        best = max(sorted(found), key=found.get) if codes else "und"
        agree += got[r.doc_id].lang_pred == best
        assert not codes or abs(got[r.doc_id].score - found[got[r.doc_id].lang_pred]) < 0.02
    assert agree >= len(rows) - 2


def test_rows_without_ids_are_sampled(spark):
    rows = [(None, f"the cat and the dog {i} of the house", "en") for i in range(7000)] + [(1, f"der Hund und die Katze {i} im Haus", "de") for i in range(3500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(spark.createDataFrame([("the dog and the cat",), ("die Katze und der Hund",)], "text string"), langid.train(docs)).collect()
    assert [(r.lang_pred, r.score > 0.5) for r in found] == [("en", True), ("de", True)]


def test_identify_edges(spark):
    docs = spark.createDataFrame([(i, f"the cat and the dog {i}" if i % 2 else f"der Hund und die Katze {i}", "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    rows = [(1, None, "de", 7, "x"), (2, "", "de", 7, "x"), (3, "123 !?", None, 7, "x"), (4, "the dog " * 100_000, "de", 7, "x"), (None, "die Katze und der Hund", "en", 7, "x"), (5, "漢字", "en", 7, "x")]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string"), model)
    got = {r.doc_id: (r.lang_pred, r.score > 0.5) for r in out.collect()}
    assert got == {1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("en", True), None: ("de", True), 5: (got[5][0], False)}
    assert langid.identify(docs.limit(0), model).count() == 0
    empty = langid.fit(docs.limit(0))
    assert [r.lang_pred for r in langid.identify(docs.limit(1), empty).collect()] == ["und"]
