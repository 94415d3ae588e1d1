import hashlib
import random

from radmine.llm import chat, lines


def brute(docs, window=2, min_chars=30):
    """docs: [(id, text)] in order; -> {id: kept text}"""
    seen, gone = set(), {i: set() for i, _ in docs}
    split = {i: (t or "").split("\n") for i, t in docs}
    for i, _ in docs:
        full = [k for k, x in enumerate(split[i]) if x.strip(" ")]
        units = [tuple(full[a : a + window]) for a in range(len(full) - window + 1)]
        units += [(k,) for k in full if len(split[i][k].strip(" ")) >= min_chars]
        for u in sorted(units):
            key = (len(u), *(split[i][k].strip(" ") for k in u))
            if key in seen:
                gone[i] |= set(u)
            seen.add(key)
    return {i: "\n".join(x for k, x in enumerate(split[i]) if k not in gone[i]) for i, _ in docs}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, kd long, gone string")
    return lines.dedup_lines(df, **options)


def test_against_brute_force(spark):
    rnd = random.Random(7)
    for window in (2, 3):
        docs = [(i, "\n".join(rnd.choice(["a", "b ", "c", "", "d d", "e"]) for _ in range(rnd.randint(0, 9)))) for i in range(60)]
        docs += [(60 + i, "x\n" + "long line " * 30 + f"\n{i}") for i in range(3)]
        docs += [(70 + i, f"{i}\nall rights reserved by the owners of this page\nother {i}\na\nb") for i in range(3)]
        got = {r.doc_id: r.text for r in run(spark, [(i, t, "z", 1, "q") for i, t in docs], window=window).collect()}
        assert got == brute(docs, window)


def test_edges(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "a\nb"), (3, "a\nb"), (4, "b\na\nb\nc"), (None, "a\nb"), (None, "a\nb\nz"), (5, "a\n\n b\n"), (6, long), (7, long + "\nend"), (8, "\n \n")]
    out = run(spark, [(i, t, "old", 5, "q") for i, t in rows])
    assert set(out.columns) == {"doc_id", "text", "kd", "gone", "removed", "n_lines"}
    got = sorted(((r.doc_id if r.doc_id is not None else 99, r.text, r.n_lines) for r in out.collect()), key=str)
    assert got == sorted([(1, None, 0), (2, "", 0), (3, "a\nb", 2), (3, "a\nb", 2), (4, "b\nc", 4), (5, "\n", 2), (6, long, 20_000), (7, "end", 20_001), (8, "\n \n", 0), (99, "", 2), (99, "z", 3)], key=str)
    assert run(spark, []).count() == 0


def test_lone_lines_and_windows(spark):
    rows = [(1, "x\nshort a\nshort b\ny"), (2, "z\nshort a\nq"), (3, "p\nshort a\nshort b\nr"), (4, "this line is long enough to count alone\nshort b")]
    rows += [(5, "short b\nthis line is long enough to count alone\nshort a")]
    got = {r.doc_id: r.removed for r in run(spark, [(i, t, "z", 1, "q") for i, t in rows]).collect()}
    assert got == {1: [], 2: [], 3: [1, 2], 4: [], 5: [1]}


def test_stage_drops_what_held_nothing_else(spark):
    df = spark.createDataFrame([(1, "a\nb", "en", "s", 3), (2, "a\nb", "en", "s", 3), (3, "a\nb\nc", "en", "s", 5), (4, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in lines.stage(df).collect()) == [(1, "a\nb", 3), (3, "c", 1), (4, "", 0)]


def brute_chat(turns):
    convs = {}
    for c, t, r, x in turns:
        p = f"<|im_start|>{'unknown' if r is None else r}\n{x or ''}<|im_end|>\n"
        if c is None:
            convs["n", p] = [(True, 0, p)]
        else:
            convs.setdefault(("c", c), []).append((t is not None, t or 0, p))
    order = lambda x: (x[0], x[1], hashlib.md5(x[2].encode()).hexdigest())
    text = {k: tuple(x[2] for x in sorted(v, key=order)) for k, v in convs.items()}
    out = []
    for k, v in text.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in text.values())
        first = min((j for j, w in text.items() if w == v), key=lambda j: (j[0] == "n", j[1])) == k
        if first and not longer:
            out.append((k[1] if k[0] == "c" else None, len(v), "".join(v)))
    return sorted(out, key=str)


def collapse(spark, turns):
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, piece string, n_turns int")
    return sorted((tuple(r) for r in chat.collapse(df).collect()), key=str)


def test_chat_against_brute_force(spark):
    rnd = random.Random(3)
    turns = []
    for c in range(80):
        say = [("user" if t % 2 == 0 else "assistant", rnd.choice("ab")) for t in range(rnd.randint(1, 5))]
        turns += [(c, t, r, x) for t, (r, x) in enumerate(say)]
    turns += [(None, 0, "user", "a"), (None, 3, "user", "a"), (None, 0, "user", "zz"), (200, None, None, None), (201, 1, "user", "q"), (201, 1, "user", "p"), (201, 1, "user", "p")]
    rnd.shuffle(turns)
    assert collapse(spark, turns) == brute_chat(turns)
    assert collapse(spark, []) == []


def test_chat_snapshots(spark):
    say = ["hi", "hello " * 20_000, "how", "fine"]
    turns = [(n, t, "user" if t % 2 == 0 else "assistant", say[t]) for n in range(1, 5) for t in range(n)]
    ((conv, n, text),) = collapse(spark, turns)
    assert (conv, n) == (4, 4) and text.count("<|im_start|>") == 4
