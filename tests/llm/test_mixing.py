import re

from radmine.llm import mixing


def water(sizes, cap=3.0):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, key int")
    return mixing.mix(df.select("doc_id", "text", "source", "size", "key")).collect()


def test_targets_and_taken(spark):
    rows = []
    for i in range(900):
        source = [None, "a", "b", "B", "é", "c", "d"][i % 7 if i % 3 else 1]
        rows.append((i, " ".join(["w"] * (i % 13 if source != "d" else 400)), source, "x", 1))
    out = run(spark, rows)
    assert len(out) == len(rows)
    text = {r[0]: (r[1], r[2]) for r in rows}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (t, _) in text.items()}
    sums = {}
    for i, (_, s) in text.items():
        sums[s] = sums.get(s, 0) + size[i]
    want, taken, widest = water(sums), {}, {}
    for r in out:
        s = text[r.doc_id][1]
        assert r.size == size[r.doc_id] and r.source_size == sums[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        widest[s] = max(widest.get(s, 0), r.size)
    for s in sums:
        assert abs(taken[s] - want[s]) <= widest[s]
    assert abs(sum(want.values()) - sum(sums.values())) < 1e-6
    again = {r.doc_id: r.taken for r in run(spark, rows)}
    assert again == {r.doc_id: r.taken for r in out}


def test_nested(spark):
    """What a smaller budget takes, a larger one takes too."""
    rows = [(i, "w " * (1 + i % 9), "a" if i % 2 else "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    small = {r.doc_id for r in mixing.mix(df, cycle=(1, 3)).collect() if r.taken and rows[r.doc_id][2] == "a"}
    large = {r.doc_id for r in mixing.mix(df, cycle=(2, 3)).collect() if r.taken and rows[r.doc_id][2] == "a"}
    assert small < large


def test_edges(spark):
    out = run(spark, [(None, None, None, "x", 1), (None, None, None, "x", 1), (3, "", "a", None, None)])
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 3
    assert run(spark, []) == []
    twice = run(spark, [(1, "a b c", "s", "x", 1), (1, "a b c", "s", "x", 1), (2, "d", "t", "x", 1), (None, "e " * 50_000, None, "x", 1)])
    assert len(twice) == 4 and len({r.taken for r in twice if r.doc_id == 1}) == 1


def test_stage_repeats_rows(spark):
    rows = [(i, "w " * 10, "en", "a" if i < 30 else "b", 20) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    out = mixing.stage(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in plan.items() if n}
    assert max(got.values()) == 3
