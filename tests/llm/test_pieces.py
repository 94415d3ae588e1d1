import itertools
import os
import random
import re

import numpy as np
import pytest

from radmine.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model")
ODD = ["", " ", "  a  b ", "\n\tx", "日本語 テスト 😀", "a" * 300, "    def f(x):\n        return x", "x\n\ny.", "▁▁ a▁b", 'a. .b ..."', " trailing "]


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load()


def texts():
    rnd = random.Random(3)
    return ODD + ["".join(rnd.choice(" \n\tab.,é1\"'日▁") for _ in range(rnd.randint(1, 90))) for _ in range(400)]


def test_like_the_library(spark, model):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    every = texts() + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(every)), "i int, text string")
    whole, most = ({r.i: (r.ids, r.decoded) for r in pieces.encode(df, model, limit=n).collect()} for n in (pieces.DICTIONARY, 500))
    assert most == whole  # the units that are joined back from the lattice's table, and those that are broadcast
    for i, t in enumerate(every):
        assert whole[i] == (sp.encode(t), sp.decode(sp.encode(t)))
        assert model.encode_word(model.escape(t)) == whole[i][0]


def test_blocks(model, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 50)
    every = texts()
    cut = ["" for _ in every]
    for first, chars, starts, owners in model.blocks(every):
        for i, a, b in zip(owners, starts, [*starts[1:], len(chars)], strict=True):
            unit = chars[a:b]
            assert all(pair in model.neighbours for pair in itertools.pairwise(unit))
            cut[first + i] += unit
    assert cut == [model.escape(t) for t in every]


def test_dictionary(model):
    units = ["▁the", "a", "bc", "▁"]
    starts = np.cumsum([0, *map(len, units)])[:-1]
    keys = pieces.unit_hashes("".join(units), starts)
    assert [pieces.unit_hashes(u, np.zeros(1, np.int64))[0] for u in units] == list(keys)
    ids = [[1], [], [2, 3], [4]]
    d = pieces.Dictionary.pack([(keys.tobytes(), np.array([len(i) for i in ids], np.uint16).tobytes(), np.array(sum(ids, []), np.uint16).tobytes())])
    at = d.find(np.append(keys, np.uint64(7)))
    assert [d.ids[d.first[i] : d.first[i] + d.count[i]].tolist() for i in at[:4]] == ids and at[4] == -1


def test_lattice_like_a_heap_and_viterbi(spark, model):
    words = {w for t in texts() for w in re.findall("▁*[^▁]+|▁+", model.escape(t)) if len(w) <= pieces.UNIT_CHARS}
    df = spark.createDataFrame([(w,) for w in words | {"▁the"}] + [(None,), ("",), ("a" * 100,)], "word string")
    for m in (model, pieces.Model(model.pieces, "unigram")):
        got = {r.word: list(r.ids) for r in pieces.encode_words(df, m).collect()}
        assert got == {w: m.encode_word(w) for w in words | {"▁the"}}


def test_viterbi_is_best():
    m = pieces.Model([("<unk>", 0.0, 2), *((p, s, 1) for p, s in [("a", -2.0), ("b", -2.0), ("ab", -2.5), ("aba", -9.0), ("ba", -3.0), ("bb", -5.0)])])
    for n in range(1, 7):
        for word in map("".join, itertools.product("abc", repeat=n)):
            cost = lambda p: m.ids[p][1] if p in m.ids else m.lowest if len(p) == 1 else None
            ways = [[word[i:j] for i, j in itertools.pairwise([0, *c, n])] for k in range(n) for c in itertools.combinations(range(1, n), k)]
            best = max(sum(map(cost, w)) for w in ways if None not in map(cost, w))
            ids = m.encode_word(word)
            spelt = [m.pieces[i][0] for i in ids]
            assert abs(sum(m.lowest if i == 0 else m.pieces[i][1] for i in ids) - best) < 1e-9
            assert "".join(spelt).replace("<unk>", "c") == word


def test_round_trip_and_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "Hello  world \n"), (3, "Hello  world \n"), (None, "word " * 50_000 + "é"), (4, "ab" * 30_000)]
    df = spark.createDataFrame([(*r, "old", 5) for r in rows], "doc_id long, text string, decoded string, ids int")
    out = pieces.encode(df, model)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert len(got) == 6 and all(r.decoded == (r.text or "") for r in got)
    assert [r.n_pieces for r in pieces.digests(out).collect() if r.doc_id in (1, 2)] == [0, 0]
    assert pieces.encode(df.limit(0), model).count() == 0
    assert model.decode([1, 72, 2]) == "E" or model.decode([1, 2]) == ""
