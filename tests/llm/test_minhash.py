import random
import re

import numpy as np
import pytest

from radmine.llm import minhash
from radmine.llm.common import components
from radmine.llm.shingles import shingle_arrays


def shingles(text, width=5):
    w = re.findall(rb"[0-9A-Za-z_\x80-\xff]+", (text or "").lower().encode())
    n = min(width, len(w))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if n else []


def similar(a, b, weights):
    x, y = shingles(a), shingles(b)
    if not x or not y:
        return 0.0
    if weights == "set":
        return len(set(x) & set(y)) / len(set(x) | set(y))
    every = set(x) | set(y)
    return sum(min(x.count(s), y.count(s)) for s in every) / sum(max(x.count(s), y.count(s)) for s in every)


def classes(docs, weights="set"):
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and similar(docs[i], docs[j], weights) >= 0.8 and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in docs}


def test_shingle_hashes():
    texts = ["a b c d e f", "A  b,c-d e\nF", "a b c", "", None, "!!", "é ü ñ ö ß z"]
    got = [list(x) for x in shingle_arrays(texts)]
    assert got[0] == got[1] and [len(x) for x in got] == [2, 2, 1, 0, 0, 0, 2]
    assert len(set(shingle_arrays([" ".join(f"w{i}" for i in range(100_000))]).__next__())) == 99_996


@pytest.mark.parametrize("j", [0.3, 0.8])
def test_signatures_estimate_jaccard(j):
    rng, est, n = np.random.default_rng(1), [], 300
    s = int(2 * n * j / (1 + j))
    for _ in range(25):
        x = rng.integers(0, 2**63, 2 * n - s).astype(np.uint64)
        a = minhash.signatures([(x[:n], np.ones(n)), (x[n - s :], np.ones(n))], 160)
        est.append((a[0] == a[1]).mean())
    assert abs(np.mean(est) - s / (2 * n - s)) < 0.03


def test_signatures_of_weights():
    a = (np.arange(5, dtype=np.uint64), np.array([3.0, 1, 1, 2.5, 1]))
    b = (np.arange(1, 6, dtype=np.uint64), np.array([2.0, 1, 1.5, 1, 4]))
    s = minhash.signatures([a, b], 4000)
    assert abs((s[0] == s[1]).mean() - minhash.jaccard(a, b)) < 0.03


def corpus(seed):
    rnd, docs = random.Random(seed), {}
    for base in range(4):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([8, 60, 200]))]
        for _ in range(14):
            w = list(words)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(50)}"
            docs[len(docs) * 3 + base % 2] = " ".join(w * (2 if rnd.random() < 0.2 else 1))
    return docs


@pytest.mark.parametrize("weights", ["set", "count"])
def test_against_brute_force(spark, weights):
    docs = corpus(5)
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in docs.items()], "doc_id long, text string, band string, c int")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, weights=weights).collect()}
    assert got == classes(docs, weights)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, ""), (4, "..."), (5, "..."), (6, "One two"), (7, "one, two!"), (8, long), (9, long + " end"), (9, long + " end"), (None, "one two"), (None, "alone here now"), (None, None), (12, "one two"), (12, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    want = [(i, i, True) for i in (1, 2, 3, 4, 5, 6, 8)] + [(7, 6, False), (9, 8, False), (9, 8, False), (None, 6, False), (None, None, True), (None, None, True), (12, 6, False), (12, 8, False)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(5, 160), (7, 8), (8, 7), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 5 for i in range(100, 161)} | {5: 5, 7: 7, 8: 7}
    star = [(0, i) for i in range(1, 500)]
    assert {r.component for r in components(spark.createDataFrame(star, "a long, b long")).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_of_all_documents_against_brute_force(spark):
    """Every pair of 1,000 documents by exact similarity: no link is missed, none is made up."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = dict(zip([i for i, _ in rows], [set(h.tolist()) for h in minhash.shingle_arrays([t for _, t in rows])], strict=True))
    at, parent = {}, {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i, own in sets.items():
        shared = {}
        for h in own:
            for j in at.setdefault(h, []):
                shared[j] = shared.get(j, 0) + 1
            at[h].append(i)
        for j, n in shared.items():
            if n / (len(own) + len(sets[j]) - n) >= 0.8:
                links += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert links > 50 and got == {i: root(i) for i in sets}


def test_stage_keeps_one_of_each_class(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text, "a"), (5, text, "b"), (5, text.upper(), "c"), (None, text, "d"), (None, "alone " * 9, "e"), (None, "alone " * 9, "f"), (7, "", "g"), (7, "", "h"), (8, None, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    out = minhash.stage(df).collect()
    kept = sorted(r.rid for r in out)
    assert len(kept) == 5 and kept[2:] == ["g", "h", "i"] and kept[0] in "abc" and kept[1] in "ef"
