import hashlib
import math
import re
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from radmine.llm import langid, lines, minhash, mixing, pieces, queries
from radmine.llm.common import BROADCAST_ROWS, join_small, stored
from radmine.llm.shingles import shingle_arrays

DATA = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def value(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "documents embeddings pages conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.sql(queries.SQL[name])
    order = [want.columns.index(x) for x in sorted(want.columns)]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(tuple(map(value, r)) for r in df.select(*sorted(df.columns)).collect()) == sorted(tuple(value(r[i]) for i in order) for r in want.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, DATA), f"test-{name}")
        made[name] = (docs, out)
        docs = out
    for name, (_, out) in list(made.items())[:-1]:
        assert out.columns == DOCUMENTS, name
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = made["language"]
    assert ids(after) == sorted(r.doc_id for r in langid.identify(before, langid.fit(before)).collect() if r.lang_pred != "und" and r.score >= langid.MIN_SCORE)
    assert len(ids(after)) > 0.95 * len(ids(before))
    before, after = made["lines"]
    assert {(r.doc_id, r.text) for r in after.collect()} == {(r.doc_id, r.text) for r in lines.dedup_lines(before).collect() if not r.removed or len(r.removed) < r.n_lines}
    before, after = made["minhash"]
    assert ids(after) == sorted(r.doc_id for r in minhash.near_duplicates(before).collect() if r.kept)
    before, after = made["mix"]
    assert ids(after) == sorted(i for r in mixing.mix(before).collect() for i in [r.doc_id] * r.copies)
    _, after = made["pieces"]
    assert after.count() == made["mix"][1].count() and after.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, DATA).count() == after.count()


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the cat and the dog", "en", None, 19), (None, "the dog and the cat", "en", "a", 19), (3, "the cat and the dog", "en", None, 19)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, DATA), f"odd-{name}")
        assert docs.count() == 0 or rows


def test_join_small_beyond_its_bound(spark):
    big = spark.range(1000).selectExpr("id % 3 as k", "id")
    small = spark.range(3).selectExpr("id as k", "id * 10 as v")
    a = join_small(big, small, ["k"], salt=big["id"]).collect()
    b = join_small(big, small, ["k"], salt=big["id"], rows=BROADCAST_ROWS + 1)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b.collect())) and len(a) == 1000
    assert join_small(big, small.where("k = 9"), ["k"], "left", salt=big["id"], rows=BROADCAST_ROWS + 1).count() == 1000


def test_the_rest_works_without_these(tmp_path):
    """A copy without this subpackage and the pipeline still imports and has the other queries."""
    import shutil

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "radmine", tmp_path / "radmine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_columns_of_any_name_survive_the_stages(spark):
    names = ["_gone", "_kd", "_kt", "_n", "_key", "_h", "_rid", "_p", "removed", "n_lines", "row", "key", "h", "rid", "found", "salt", "lang_pred", "score", "size", "source_size"]
    words = "the quick brown fox jumps over a lazy dog and runs home again".split()
    rows = [(i, " ".join(words[i % 7 :] + words[: i % 7]) + f"\nline {i} of text number {i} is here", "en", f"s{i % 3}", 40, *[f"{n}{i}" for n in names]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, DATA), f"names-{name}")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), name
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(encoded) == 40 and all(r.round_trip for r in encoded)


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    """All five stages in plain Python over a small table, from the rules as they are stated."""
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    (tmp_path / "in").mkdir()
    source.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    model = langid.fit(source)
    rows = {r.doc_id: r for r in source.collect()}
    names, scores = model.predict([r.text or "" for r in rows.values()])
    docs = {i: r.text for (i, r), n, s in zip(rows.items(), names, scores, strict=True) if n != "und" and s >= langid.MIN_SCORE}
    # lines that occur before, alone from 30 characters or in twos
    seen, left = set(), {}
    for i in sorted(docs):
        parts = docs[i].split("\n")
        full, gone = [k for k, x in enumerate(parts) if x.strip(" ")], set()
        for unit in [*zip(full, full[1:]), *((k,) for k in full if len(parts[k].strip(" ")) >= 30)]:  # noqa: B905
            key = tuple(parts[k].strip(" ") for k in unit)
            if key in seen:
                gone |= set(unit)
            seen.add(key)
        if not gone or len(gone) < len(full):
            left[i] = "\n".join(x for k, x in enumerate(parts) if k not in gone)
    # one of each class of texts at similarity 0.8 of five-word shingles
    sets = {i: set(h.tolist()) for i, h in zip(left, shingle_arrays(list(left.values())), strict=True)}
    parent = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((parent[i], parent[j]))
                parent = {k: a if v == b else v for k, v in parent.items()}
    left = {i: t for i, t in left.items() if not sets[i] or parent[i] == i}
    # sources to their weights: targets by water level, rows in the order of their hashes
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in left.items()}
    of = {}
    for i in left:
        of.setdefault(rows[i].source, []).append(i)
    order = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    total, weight, level = sum(size.values()), {s: k % 3 + 1 for k, s in enumerate(order)}, 0.0
    words = {s: sum(size[i] for i in of[s]) for s in order}
    for _ in range(50):
        capped = [s for s in order if 3 * words[s] < level * weight[s]]
        level = (total - sum(3 * words[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
    want = []
    for s in order:
        target = min(3.0 * words[s], level * weight[s])
        whole = int(target // words[s]) if words[s] else 0
        rest, upto = target - whole * words[s], 0
        key = lambda i: int(hashlib.md5(f"{i}:{hashlib.md5(left[i].encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        for i in sorted(of[s], key=key):
            more = upto + size[i] <= rest or (upto <= rest and rest - upto >= size[i] / 2)
            upto += size[i]
            want += [i] * (whole + (rest > 0 and more)) if words[s] else [i]
    got = corpus_pipeline.run(spark, str(tmp_path / "in")).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert all(r.round_trip and r.ids == sp.encode(left[r.doc_id]) for r in got)
