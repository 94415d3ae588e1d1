import numpy as np

from radmine.llm import neighbours


def brute(vectors):
    x = np.array(list(vectors.values()), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, link = list(vectors), (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = dict(zip(ids, ids, strict=True))
    while True:
        new = {i: min([label[i], *(label[ids[k]] for k in np.flatnonzero(link[n]))]) for n, i in enumerate(ids)}
        if new == label:
            return {i: (int(link[n].sum()), label[i]) for n, i in enumerate(ids)}
        label = new


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int, v string")
    return neighbours.near_vectors(df, **options).collect()


def test_against_brute_force(spark):
    rng, vectors = np.random.default_rng(2), {}
    for size in (1, 2, 2, 5, 40, 300):
        base = rng.standard_normal(32)
        for _ in range(size):
            vectors[len(vectors) * 2 + 5] = (base + rng.standard_normal(32) * rng.choice([0.0, 0.15, 0.32])).tolist()
    for _ in range(150):
        vectors[len(vectors) * 2 + 5] = rng.standard_normal(32).tolist()
    got = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, [(i, v, 1, "x") for i, v in vectors.items()])}
    assert got == brute(vectors)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1e-200, 0.0]),
        (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (11, [0.0, 1.0]), (None, [1.0, 0.0]),
    ]
    got = sorted((tuple(r)[:4] for r in run(spark, [(*r, 1, "x") for r in rows])), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11, 11)] + [(7, 2, 7, True), (8, 2, 7, False), (9, 2, 7, False), (None, 0, None, None)]
    assert got == sorted(want, key=str)
    assert run(spark, []) == []


def test_audit_reports_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    rows = [(2 * i + j, (b + 0.05 * rng.standard_normal(16)).tolist(), 1, "x") for i, b in enumerate(base) for j in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int, v string")
    v = neighbours.unit_vectors(df, "vec_id", "embedding")
    lists, _, scores = neighbours.neighbour_graph(v)
    assert scores[-1]["recall"] >= 0.999 and scores[-1]["links"] > 100 and scores[-1]["simulated"] > 0.99999
    assert lists.where("cos >= 0.9").count() >= 600


def test_simulated_pairs_meet():
    rng = np.random.default_rng(8)
    t = neighbours.Tables(5000, 0.9)
    x = rng.standard_normal((3000, t.deep, t.wide))
    y = 0.9 * x + np.sqrt(1 - 0.81) * rng.standard_normal(x.shape)
    at = lambda z: np.abs(z).argmax(2) * 2 + (np.take_along_axis(z, np.abs(z).argmax(2)[..., None], 2)[..., 0] > 0)
    assert abs((at(x) == at(y)).all(1).mean() - t.met) < 0.04


def test_rare_links_among_many_vectors(spark):
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x)
    rows = [unit(rng.standard_normal(256)) for _ in range(9000)]
    for _ in range(20):
        x = unit(rng.standard_normal(256))
        rows += [x, 0.91 * x + np.sqrt(1 - 0.91**2) * unit((y := rng.standard_normal(256)) - (y @ x) * x)]
    vectors = {i: v.tolist() for i, v in enumerate(rows)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, [(i, v, 1, "x") for i, v in vectors.items()])}
    assert got == brute(vectors) and sum(n for n, _ in got.values()) == 40


def test_a_chain_and_a_bridge(spark):
    """A long chain of neighbours, and two large groups that one pair links."""
    rng = np.random.default_rng(13)
    rows = [np.array([np.cos(a), np.sin(a), 0.2, *0.01 * rng.standard_normal(13)]) for a in np.linspace(0, 3, 900)]
    u = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    turn = lambda deg: np.cos(np.radians(deg)) * u[0] + np.sin(np.radians(deg)) * u[1]
    for centre in (turn(0), turn(36)):
        rows += [centre + 0.012 * rng.standard_normal(16) for _ in range(400)]
    rows += [turn(6), turn(31)]
    vectors = {i: v.tolist() for i, v in enumerate(rows)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, [(i, v, 1, "x") for i, v in vectors.items()])}
    assert got == brute(vectors)


def test_comparing_all_where_recall_is_not_reached(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((200, 32))
    vectors = {2 * i + j: (b + 0.05 * j * rng.standard_normal(32)).tolist() for i, b in enumerate(base) for j in (0, 1)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, [(i, v, 1, "x") for i, v in vectors.items()], max_rounds=1, miss=0.9, recall=1.1)}
    assert got == brute(vectors)


def test_groups_with_full_lists_are_linked(spark):
    rng, rows = np.random.default_rng(5), []
    near = lambda base, cos: cos * base + np.sqrt(1 - cos**2) * (lambda x: x / np.linalg.norm(x))((x := rng.standard_normal(64)) - (x @ base) * base)
    for _ in range(4):
        first = near(np.eye(64)[0], 0.0)
        for centre in (first, near(first, 0.93)):
            rows += [near(centre, 0.998).tolist() for _ in range(130)]
    vectors = dict(enumerate(rows))
    got = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, [(i, v, 1, "x") for i, v in vectors.items()])}
    assert got == brute(vectors)


def test_pairs_beside_a_large_group_are_linked(spark):
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x)
    base = unit(rng.standard_normal(64))
    rows = [unit(base + 0.02 * rng.standard_normal(64)) for _ in range(600)]
    for _ in range(300):
        x = unit(rng.standard_normal(64))
        rows += [x, 0.92 * x + np.sqrt(1 - 0.92**2) * unit((y := rng.standard_normal(64)) - (y @ x) * x)]
    vectors = {i: v.tolist() for i, v in enumerate(rows)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, [(i, v, 1, "x") for i, v in vectors.items()])}
    assert got == brute(vectors)
