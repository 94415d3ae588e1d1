"""Near-duplicate embeddings by NN-descent.

A neighbour graph is started from vectors that share a bucket: cross-polytope hashes in as many tables as leave a pair at
the threshold apart in all of them with probability MISS. The neighbours of a vector's neighbours then meet in local joins,
which compare what is new, and the closest are kept; a list that is full of links is saturated and is enlarged. Every
comparison also reports which of its vectors are linked, whether or not they fit a list, so lists never decide what is
connected. Buckets that are too large for one block are split, and completed once components are known: what meets a large
component in such a bucket is compared with all of its members unless a bound on angles excludes a link.

Recall is audited on vectors of the whole input and of small groups against all rows, and by simulated pairs at the
threshold; while it is below RECALL more tables follow, and after the last round all vectors are compared in blocks.
Links are counted inside components, exactly, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, join_small, stored, table

#: Neighbours of a list, and of a saturated one; tables whose buckets start lists of unlinked neighbours as well.
THRESHOLD, K, K_MAX, START = 0.9, 6, 48, 4
#: Probability that a pair at the threshold meets in no table; recall asked for; rounds; rows of a block.
MISS, RECALL, MAX_ROUNDS, BLOCK = 1e-6, 0.999, 3, 256
#: Audited vectors of each kind: AUDIT and twice the root of the rows. Bytes of vectors in a block of the exact comparison.
AUDIT, PACK = 128, 1 << 20
#: Products of vectors that were rounded to single precision differ by less.
SLACK = 1e-6
_PAIR = "a long, b long, cos double, kind int"
LISTED, LINKED, UNSURE = 0, 1, 2


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): float64 bytes of unit length; rows without an id and unusable vectors are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            ids, out = [], []
            for i, v in zip(df["id"], df["v"], strict=True):
                if v is None or i is None or pd.isna(i):
                    continue
                x = np.asarray(v, np.float64)  # null components become NaN
                top = np.abs(x).max() if len(x) else 0.0
                if not np.isfinite(x).all() or top == 0:
                    continue
                x = x / top  # no overflow or underflow of the squares
                ids.append(int(i))
                out.append((x / np.sqrt((x * x).sum()) + 0.0).tobytes())
            yield pd.DataFrame({"id": np.array(ids, np.int64), "v": out})

    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInPandas(run, "id long, v binary")


class Tables:
    """Cross-polytope hashing: of `wide` random projections the largest in size, with its sign, `deep` times a table."""

    def __init__(self, rows: int, threshold: float, seed: int = 1, miss: float = MISS) -> None:
        bits = 0 if rows <= BLOCK else min(27, max(4, math.ceil(math.log2(rows)) - 3))
        self.seed, self.deep = seed, max(1, -(-bits // 8))
        self.wide = max(1, round(2 ** (bits / self.deep) / 2))
        self.met = 1.0 if bits == 0 else self._simulate(threshold)
        self.count = 1 if bits == 0 else max(START, min(4095, math.ceil(math.log(miss) / math.log1p(-min(self.met, 0.999)))))
        self.trivial = bits == 0

    def _simulate(self, threshold: float, pairs: int = 4000) -> float:
        """The share of pairs at the threshold that meet in a table: projections of two such vectors are normal numbers with
        this correlation, whatever the dimension."""
        rng, same = np.random.default_rng(self.seed), np.ones(pairs, bool)
        for _ in range(self.deep):
            x = rng.standard_normal((pairs, self.wide))
            y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * rng.standard_normal((pairs, self.wide))
            i, j = np.abs(x).argmax(1), np.abs(y).argmax(1)
            r = np.arange(pairs)
            same &= (i == j) & (np.sign(x[r, i]) == np.sign(y[r, j]))
        return max(float(same.mean()), 1 / pairs)

    @property
    def recall(self) -> float:
        return 1.0 if self.trivial else 1 - (1 - self.met) ** self.count

    def codes(self, vectors: DataFrame) -> DataFrame:
        """(code, id, start) of (id, v): a row per table; start says that the table is one of the first."""
        seed, deep, wide, count = self.seed, self.deep, self.wide, 1 if self.trivial else self.count
        trivial = self.trivial

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            planes: dict[int, np.ndarray] = {}
            for df in frames:
                for size, part in df.groupby(df["v"].str.len()):
                    if trivial:
                        yield pd.DataFrame({"code": size << 40, "id": part["id"], "start": True})
                        continue
                    p = planes.setdefault(size, np.random.default_rng([seed, size]).standard_normal((size // 8, count * deep * wide), np.float32))
                    for i in range(0, len(part), 512):
                        x = part.iloc[i : i + 512]
                        y = (_matrix(x["v"]).astype(np.float32) @ p).reshape(len(x), count, deep, wide)
                        at = np.abs(y).argmax(3)
                        digit = 2 * at + (np.take_along_axis(y, at[..., None], 3)[..., 0] > 0)
                        code = (digit.astype(np.int64) * (2 * wide) ** np.arange(deep)).sum(2) + (np.arange(count) << 28) + (size << 40)
                        yield pd.DataFrame({"code": code.ravel(), "id": np.repeat(x["id"].to_numpy(), count), "start": np.tile(np.arange(count) < START, len(x))})

        return vectors.mapInPandas(run, "code long, id long, start boolean")


def _whole_groups(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, starts of groups): batches of sorted rows that end where a group does."""
    held: list[pd.DataFrame] = []
    for df in frames:
        if not len(df):
            continue
        held.append(df)
        if sum(map(len, held)) < 4 * BLOCK:
            continue
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else df
        change = _changes(rows, key)
        if len(change) > 1:
            last = change[-1]
            yield rows.iloc[:last], change[:-1]
            held = [rows.iloc[last:].reset_index(drop=True)]
        else:
            held = [rows]
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield rows, _changes(rows, key)


def _changes(rows: pd.DataFrame, key: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in key:
        x = rows[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _compare(threshold: float, k: int, key: list[str]) -> Callable:
    """Local joins of (key..., id, floor, fresh, w), sorted by key, w being float32 bytes of one length in a group.

    Yields for each vector up to k closest others of its group nearer than its floor (LISTED); for linked vectors an edge to
    one of those they are connected with (LINKED); pairs too near to the threshold to tell, if they matter (UNSURE). Pairs
    of vectors that aren't fresh are not listed: they have met before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _whole_groups(frames, key):
            sizes = np.diff(np.append(starts, len(rows)))
            ids, floor, fresh = rows["id"].to_numpy(), rows["floor"].to_numpy(), rows["fresh"].to_numpy()
            length = rows["w"].str.len().to_numpy()[starts]
            level = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
            for n, at in {(a, b) for a, b in zip(length.tolist(), level.tolist(), strict=True)}:
                chosen = starts[(length == n) & (level == at) & (sizes > 1)]
                count = sizes[(length == n) & (level == at) & (sizes > 1)]
                if not len(chosen):
                    continue
                wide = int(count.max())
                step = max(1, (4 << 20) // (wide * max(wide, n // 4)))
                for i in range(0, len(chosen), step):
                    place = np.minimum(chosen[i : i + step, None] + np.arange(wide), len(rows) - 1)
                    there = np.arange(wide) < count[i : i + step, None]
                    flat = rows["w"].to_numpy()[place.ravel()]
                    x = np.frombuffer(b"".join(flat), np.float32).reshape(*place.shape, -1) if len({len(f) for f in flat}) == 1 else np.stack([np.frombuffer(f, np.float32) if len(f) == n else np.zeros(n // 4, np.float32) for f in flat]).reshape(*place.shape, -1)
                    x = x.astype(np.float64)
                    s = x @ x.transpose(0, 2, 1)
                    s[~(there[:, :, None] & there[:, None, :])] = -2.0
                    own = ids[place]
                    s[own[:, :, None] == own[:, None, :]] = -2.0
                    yield from _links(s, own, threshold)
                    s = np.where(fresh[place][:, :, None] | fresh[place][:, None, :], s, -2.0)
                    m = min(k, wide - 1)
                    near = np.argpartition(-s, m - 1, axis=2)[:, :, :m] if m < wide - 1 else np.broadcast_to(np.arange(wide), s.shape)
                    cos = np.take_along_axis(s, near, 2)
                    g, r, c = np.nonzero((cos > floor[place][:, :, None]) & (cos > -1.5))
                    if len(g):
                        yield pd.DataFrame({"a": own[g, r], "b": own[g, near[g, r, c]], "cos": cos[g, r, c], "kind": LISTED})

    return run


def _links(s: np.ndarray, ids: np.ndarray, threshold: float) -> Iterator[pd.DataFrame]:
    """Edges that connect what is linked in each of several groups, and pairs that single precision doesn't decide."""
    some = np.flatnonzero((s >= threshold - SLACK).any(axis=(1, 2)))
    if not len(some):
        return
    s, ids = s[some], ids[some]
    link = s >= threshold + SLACK
    label = np.broadcast_to(np.arange(s.shape[1]), s.shape[:2]).copy()
    while True:
        best = np.minimum(label, np.where(link, label[:, None, :], s.shape[1]).min(2))
        best = np.take_along_axis(best, best, 1)
        if (best == label).all():
            break
        label = best
    g, r = np.nonzero(label != np.arange(s.shape[1]))
    if len(g):
        yield pd.DataFrame({"a": ids[g, r], "b": ids[g, label[g, r]], "cos": 1.0, "kind": LINKED})
    g, r, c = np.nonzero((np.abs(s - threshold) < SLACK) & (label[:, :, None] < label[:, None, :]))
    if len(g):
        yield pd.DataFrame({"a": ids[g, r], "b": ids[g, c], "cos": s[g, r, c], "kind": UNSURE})


def _joined(rows: DataFrame, key: list[str], threshold: float, k: int, n_rows: int, width: int) -> DataFrame:
    """Local joins of rows (key..., id, floor, fresh, w), stored; tasks get some 16 MB each."""
    spark = rows.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, n_rows * (width + 40) >> 24)
    return stored(rows.repartition(tasks, *key).sortWithinPartitions(*key).mapInPandas(_compare(threshold, k, key), _PAIR), "compared")


def _closest(edges: DataFrame, threshold: float, k: int, k_max: int) -> DataFrame:
    """The k best distinct neighbours of each vector, as (a, b, cos); of a list that is full of links (saturated) up to k_max."""
    one = edges.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("cos", "b")), asc=False), 1, k_max)
    top = one.groupBy("a").agg(best.alias("n")).select("a", F.filter("n", lambda x, i: (i < k) | (x["cos"] >= threshold)).alias("n"))
    return top.select("a", F.explode("n").alias("n")).select("a", "n.b", "n.cos")


def _exact(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs with a cosine of at least the threshold, in double precision."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                same = df["x"].str.len() == df["y"].str.len()
                df = df[same]
                cos = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) for x, y in zip(df["x"], df["y"], strict=True)]
                yield df[["a", "b"]][np.array(cos, np.float64) >= threshold]

    x, y = (vectors.select(F.col("id").alias(c), F.col("v").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").distinct().join(x, "a").join(y, "b").mapInPandas(run, "a long, b long")


def _audit(vectors: DataFrame, group: DataFrame, threshold: float, size: int) -> tuple[float, int]:
    """(recall, links): the share of audited vectors with links whose links all lie in their component, the lower of two
    kinds (any vector; vectors of small components), and how many links they have. Vectors are chosen by hash and compared
    with all rows, in blocks of a matrix product."""
    placed = vectors.join(group.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = stored(placed, "placed-vectors")
    small = placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n").between(2, 16)).select("component")
    order = F.xxhash64(F.lit("audit"), "id")
    pick = lambda df, kind: df.select("id", "v", "component", F.lit(kind).alias("kind")).orderBy(order).limit(size)
    chosen = pick(placed, 0).unionByName(pick(placed.join(small, "component", "left_semi"), 1)).toPandas()
    shared = vectors.sparkSession.sparkContext.broadcast((chosen["id"].to_numpy(), chosen["component"].to_numpy(), list(chosen["v"])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, comps, vs = shared.value
        by_size = {n: np.array([i for i, v in enumerate(vs) if len(v) == n]) for n in {len(v) for v in vs}}
        for df in frames:
            for n, part in df.groupby(df["v"].str.len()):
                if n in by_size:
                    q, own, where = by_size[n], part["id"].to_numpy(), part["component"].to_numpy()
                    x = np.frombuffer(b"".join(vs[i] for i in q), np.float64).reshape(len(q), -1)
                    for a in range(0, len(part), 2048):
                        link = x @ _matrix(part["v"].iloc[a : a + 2048]).T >= threshold
                        link &= ids[q][:, None] != own[None, a : a + 2048]
                        apart = link & (comps[q][:, None] != where[None, a : a + 2048])
                        yield pd.DataFrame({"q": q, "links": link.sum(1), "lost": apart.sum(1)})

    found = placed.mapInPandas(run, "q int, links long, lost long").groupBy("q").agg(F.sum("links").alias("links"), F.sum("lost").alias("lost")).where("links > 0").toPandas()
    if not len(found):
        return 1.0, 0
    kind = chosen["kind"].to_numpy()[found["q"]]
    recall = min(float((found["lost"][kind == c] == 0).mean()) for c in set(kind.tolist()))
    return recall, int(found["links"].sum())


def neighbour_graph(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K, k_max: int = K_MAX, miss: float = MISS, recall: float = RECALL, max_rounds: int = MAX_ROUNDS, audit: int = AUDIT) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(lists (a, b, cos), components (node, component) of the links, what each round's audit found: tables, recall, links,
    simulated) of (id, v) with distinct v. Where the last audit is below `recall`, components come from comparing all."""
    n = vectors.count()
    width = (vectors.agg(F.max(F.length("v"))).first()[0] or 0) // 2

    def single(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"id": df["id"], "w": [np.frombuffer(v, np.float64).astype(np.float32).tobytes() for v in df["v"]]})

    narrow = stored(vectors.select("id", "v").mapInPandas(single, "id long, w binary"), "single-precision")
    lists = links = unsure = group = None
    scores: list[dict] = []
    for round_ in range(max_rounds):
        tables = Tables(n, threshold, 1 + round_, miss)
        coded = stored(tables.codes(vectors.select("id", "v")), "codes")
        sizes = cut(coded.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("code", F.ceil(F.col("n") / BLOCK).alias("parts")))
        placed = join_small(coded, sizes, ["code"], "left", salt=F.col("id"))
        part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("code", "id"), F.col("parts"))).cast("int")
        floor = F.when(F.col("start"), F.lit(-1.0)).otherwise(F.lit(float(threshold)))
        rows = placed.select("code", part.alias("part"), "id", floor.alias("floor"), F.lit(True).alias("fresh")).join(narrow, "id")
        met = _joined(rows, ["code", "part"], threshold, k, n * tables.count, width)
        add = lambda old, new: new if old is None else old.unionByName(new)
        listed = met.where(F.col("kind") == LISTED).select("a", "b", "cos")
        before, lists = lists, cut(_closest(add(lists, listed), threshold, k, k_max))

        # NN-descent: around each vector its neighbours meet, and those whose neighbour it is (a sample if many)
        old = lists.withColumn("fresh", F.lit(True)) if before is None else lists.join(before.select("a", "b", F.lit(False).alias("fresh")), ["a", "b"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(True)))
        indegree = lists.groupBy(F.col("b").alias("u")).agg(F.count("*").alias("m"))
        forth = old.select(F.col("a").alias("u"), F.col("b").alias("id"), "fresh")
        back = old.select(F.col("b").alias("u"), F.col("a").alias("id"), "fresh").join(indegree, "u").where(F.pmod(F.xxhash64(F.lit(round_), "u", "id"), F.col("m")) < 2 * k).drop("m")
        meet = forth.unionByName(back).groupBy("u", "id").agg(F.bool_or("fresh").alias("fresh"))
        full = lists.groupBy(F.col("a").alias("id")).agg(F.when(F.count("*") >= k, F.min("cos")).alias("kth"))
        known = narrow.join(full, "id", "left").select("id", "w", F.coalesce("kth", F.lit(-1.0)).alias("floor"))
        met2 = _joined(meet.join(known, "id"), ["u"], threshold, k, n * 3 * k, width)
        lists = cut(_closest(lists.unionByName(met2.where(F.col("kind") == LISTED).select("a", "b", "cos")), threshold, k, k_max))

        both = met.unionByName(met2)
        links = add(links, both.where(F.col("kind") == LINKED).select("a", "b"))
        unsure = add(unsure, both.where(F.col("kind") == UNSURE).select("a", "b"))
        links = cut(links.unionByName(_exact(unsure, vectors, threshold)).distinct())
        group = components(links)
        more = _completed(vectors, narrow, coded, sizes, group, threshold, k, width)
        if more is not None:
            links = cut(links.unionByName(more))
            group = components(links)
        group = cut(group)
        found, audited = _audit(vectors, group, threshold, audit + 2 * math.isqrt(n))
        scores.append({"tables": tables.count, "recall": found, "links": audited, "simulated": tables.recall})
        if found >= recall:
            return lists, group, scores
    group = united(vectors, group, threshold)
    scores.append({"tables": 0, "recall": 1.0, "links": scores[-1]["links"], "simulated": 1.0})
    return lists, group, scores


def _centres(member: DataFrame, by: list[str]) -> DataFrame:
    """(by..., centre): the mean direction of the vectors v of each group, summed before they meet."""
    kinds = ", ".join(f"{c} {member.schema[c].dataType.simpleString()}" for c in by)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(*(k if isinstance(k, tuple) else (k,)), _matrix(part["v"]).sum(0).tobytes()) for k, part in df.groupby(by)]
            yield pd.DataFrame(rows, columns=[*by, "v"])

    def mean(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(df["v"]).sum(0)
        return pd.DataFrame([(*key, (m / max(np.sqrt((m * m).sum()), 1e-300)).tobytes())], columns=[*by, "centre"])

    return member.select(*by, "v").mapInPandas(add, f"{kinds}, v binary").groupBy(*by).applyInPandas(mean, f"{kinds}, centre binary")


@F.pandas_udf(T.DoubleType())
def _angle(v: pd.Series, centre: pd.Series) -> pd.Series:
    """Between two unit vectors; straight for vectors of different lengths."""
    dot = [np.frombuffer(a, np.float64) @ np.frombuffer(b, np.float64) if len(a) == len(b) else -1.0 for a, b in zip(v, centre, strict=True)]
    return pd.Series(np.arccos(np.clip(np.array(dot, np.float64), -1, 1)))


def _any_link(threshold: float):
    """Edges between the rows of two blocks that are linked: for each left row one."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        link = _matrix(left["v"]) @ _matrix(right["v"]).T >= threshold
        hit = link.any(1)
        return pd.DataFrame({"a": left["id"].to_numpy()[hit], "b": right["id"].to_numpy()[link.argmax(1)[hit]]})

    return run


def _completed(vectors: DataFrame, narrow: DataFrame, coded: DataFrame, sizes: DataFrame, group: DataFrame, threshold: float, k: int, width: int) -> DataFrame | None:
    """(a, b): links between components that share a split bucket; None where no bucket was split.

    A component of at least BLOCK vectors is compared with each other vector that meets it in such a bucket, unless their
    angle to its centre exceeds the threshold's and its radius. The vectors of smaller components meet in blocks, pair by
    pair of blocks."""
    if sizes.isEmpty():
        return None
    named = group.withColumnRenamed("node", "id")
    crowded = join_small(coded.select("code", "id"), sizes.select("code"), ["code"], salt=F.col("id")).join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    crowded = stored(crowded.select("code", "id", "component"), "crowded")
    large = cut(named.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= BLOCK))
    inside = stored(vectors.join(join_small(named, large.select("component"), ["component"], salt=F.col("id")), "id"), "large-components")
    centres = cut(_centres(inside, ["component"]))
    reach = join_small(inside, centres, ["component"], salt=F.col("id")).groupBy("component").agg(F.max(_angle("v", "centre")).alias("radius"))
    balls = cut(centres.join(reach, "component").join(large, "component"))

    # vectors beside a large component
    at = join_small(crowded.select("code", "component").distinct(), large.select("component"), ["component"], "left_semi").withColumnRenamed("component", "ball")
    beside = crowded.join(at, "code").where("component <> ball").select("id", "component", "ball").distinct()
    near = beside.join(vectors, "id").join(balls.withColumnsRenamed({"component": "ball"}), "ball").where(_angle("v", "centre") <= F.col("radius") + math.acos(min(1.0, threshold)) + SLACK)
    near = stored(near.select("id", "v", "ball", "size"), "beside")
    few = near.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("p"), F.ceil(F.max("size") / BLOCK).cast("int").alias("q"))
    few = cut(few)
    deal = lambda n: F.pmod(F.xxhash64(F.lit("deal"), "id"), F.col(n)).cast("int")
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    left = join_small(near, few, ["ball"], salt=F.col("id")).select("ball", "id", "v", deal("p").alias("i"), spread("q", "j"))
    right = join_small(inside.withColumnRenamed("component", "ball"), few, ["ball"], salt=F.col("id")).select("ball", "id", "v", deal("q").alias("j"), spread("p", "i"))
    key = ["ball", "i", "j"]
    one = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_any_link(threshold), "a long, b long")

    # vectors of smaller components, among themselves
    pool = join_small(crowded, large.select("component"), ["component"], "left_anti").select("code", "id")
    parts = cut(pool.groupBy("code").agg(F.ceil(F.count("*") / (BLOCK // 2)).cast("int").alias("p"), F.count("*").alias("n")).where("n > 1"))
    dealt = join_small(pool, parts.select("code", "p"), ["code"], salt=F.col("id")).withColumn("i", deal("p"))
    other = F.explode(F.when(F.col("p") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("p") - 1), lambda j: j != F.col("i"))))
    dealt = dealt.select("code", "id", "i", other.alias("o")).select("code", F.least("i", "o").alias("x"), F.greatest("i", "o").alias("y"), "id", F.lit(2.0).cast("double").alias("floor"), F.lit(False).alias("fresh"))
    rows = parts.agg(F.sum(F.col("n") * F.col("p"))).first()[0] or 0
    two = _joined(dealt.join(narrow, "id"), ["code", "x", "y"], threshold, k, rows, width)
    sure = two.where(F.col("kind") == LINKED).select("a", "b")
    return one.unionByName(sure).unionByName(_exact(two.where(F.col("kind") == UNSURE), vectors, threshold))


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, size, components, x) of (id, v, component): up to PACK bytes of vectors of one length, in order of component."""

    def block(rows: list[tuple]) -> tuple:
        rows = sorted(rows, key=lambda r: r[2])
        return rows[0][0], len(rows[0][1]), np.array([r[2] for r in rows], np.int64).tobytes(), b"".join(r[1] for r in rows)

    names, held = ["block", "size", "components", "x"], {}
    for df in frames:
        for row in zip(df["id"], df["v"], df["component"], strict=True):
            rows = held.setdefault(len(row[1]), [])
            rows.append(row)
            if len(rows) * len(row[1]) >= PACK:
                yield pd.DataFrame([block(held.pop(len(row[1])))], columns=names)
    for rows in held.values():
        yield pd.DataFrame([block(rows)], columns=names)


def _between(threshold: float):
    """(a, b): the pairs of components with a link between two blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for size, ca, xa, cb, xb in zip(df["size"], df["ca"], df["xa"], df["cb"], df["xb"], strict=True):
                (a, i), (b, j) = (np.unique(np.frombuffer(c, np.int64), return_index=True) for c in (ca, cb))
                if len(a) == len(b) == 1 and a[0] == b[0]:
                    continue
                x, y = (np.frombuffer(m, np.float64).reshape(-1, size // 8) for m in (xa, xb))
                link = np.logical_or.reduceat(np.logical_or.reduceat(x @ y.T >= threshold, i, axis=0), j, axis=1)
                p, q = np.nonzero(link)
                other = a[p] != b[q]
                yield pd.DataFrame({"a": a[p[other]], "b": b[q[other]]})

    return run


def united(vectors: DataFrame, group: DataFrame, threshold: float) -> DataFrame:
    """group (node, component) with components united that have any link between them, exactly: every vector is compared
    with all of its length in blocks of a matrix product. Vectors that no list links are components of their own."""
    placed = vectors.join(group.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    n_blocks = vectors.agg(F.ceil(F.sum(F.length("v")) / PACK)).first()[0] or 1
    blocks = stored(placed.select("id", "v", "component").repartition(n_blocks).mapInPandas(_packed, "block long, size int, components binary, x binary"), "blocks")
    a, b = (blocks.select(F.col("block").alias(f"i{n}"), F.col("size").alias(f"size{n}"), F.col("components").alias(f"c{n}"), F.col("x").alias(f"x{n}")) for n in "ab")
    # each pair of blocks once, in an order by hash: tasks on either side of the diagonal have the same work
    once = (F.col("ia") == F.col("ib")) | ((F.col("ia") < F.col("ib")) == (F.pmod(F.xxhash64(F.least("ia", "ib"), F.greatest("ia", "ib")), F.lit(2)) == 0))
    pairs = a.crossJoin(b).where((F.col("sizea") == F.col("sizeb")) & once)
    links = cut(pairs.select(F.col("sizea").alias("size"), "ca", "xa", "cb", "xb").mapInPandas(_between(threshold), "a long, b long").distinct())
    if links.isEmpty():
        return group
    joined = components(links).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    alone = joined.select(F.col("component").alias("node"), "component").join(group, "node", "left_anti")
    return cut(group.unionByName(alone).join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))


def _count_blocks(threshold: float):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, x, n = left["id"].to_numpy(), _matrix(left["v"]), np.zeros(len(left), np.int64)
        if not len(left):
            return pd.DataFrame({"id": a, "n": n})
        for i in range(0, len(right), 1024):
            r = right.iloc[i : i + 1024]
            n += (((x @ _matrix(r["v"]).T) >= threshold) & (a[:, None] != r["id"].to_numpy()[None, :])) @ r["n"].to_numpy()
        return pd.DataFrame({"id": a, "n": n})

    return run


def link_counts(classes: DataFrame, group: DataFrame, threshold: float) -> DataFrame:
    """(id, n) per class in a component of two or more: vectors of other classes within the threshold, by their copies.
    Vectors without links have no row; an empty table gives none.

    classes: (id, v, n), n copies. Members within half the threshold's angle (less a margin) of their component's mean
    all link with each other (angles add up): they are counted as one number. The others are compared with their component
    in blocks of some BLOCK rows: cells of the component, cut by random planes through its mean. Pairs of cells whose
    centres are too far apart for their radii to hold a link are left out, so that a long chain is compared with what is
    near.
    """
    member = stored(classes.join(group.withColumnRenamed("node", "id"), "id"), "members")
    theta = math.acos(min(1.0, threshold))
    centres = cut(_centres(member, ["component"]))
    core = _angle("v", "centre") <= theta / 2 - 1e-6
    placed = stored(join_small(member, centres, ["component"], salt=F.col("id")).withColumn("core", core), "placed")
    cores = placed.where("core").groupBy("component").agg(F.sum("n").alias("all"))
    inner = placed.where("core").select("id", "n", "component").join(cores, "component").select("id", (F.col("all") - F.col("n")).alias("n"))
    outside = placed.where("not core").groupBy("component").agg(F.count("*").alias("m"))
    sizes = cut(placed.groupBy("component").agg(F.count("*").alias("size")).join(outside, "component").select("component", F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / BLOCK))).cast("int").alias("bits")))
    mixed = join_small(placed, sizes, ["component"], salt=F.col("id"))

    @F.pandas_udf("long")
    def pattern(v: pd.Series, centre: pd.Series, bits: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int64)
        for (size, n), at in pd.Series(range(len(v))).groupby([v.str.len().to_numpy(), bits.to_numpy()]):
            if n:
                n = min(int(n), 40)
                planes = np.random.default_rng([7, size]).standard_normal((size // 8, 40))[:, :n]
                side = (_matrix(v.iloc[at]) - _matrix(centre.iloc[at])) @ planes > 0
                out[at] = (side << np.arange(n)).sum(1)
        return pd.Series(out)

    mixed = stored(mixed.withColumn("cell", pattern("v", "centre", "bits")).drop("centre", "bits"), "cells")
    crowd = cut(mixed.groupBy("component", "core", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1"))
    split = join_small(mixed, crowd, ["component", "core", "cell"], "left", salt=F.col("id"))
    mixed = stored(split.withColumn("part", F.coalesce(F.pmod(F.xxhash64(F.lit("part"), "id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts"), "parted")
    key = ["component", "core", "cell", "part"]
    middle = stored(_centres(mixed, key), "cell-centres")
    reach = mixed.join(middle, key).groupBy(*key).agg(F.max(_angle("v", "centre")).alias("radius"))
    balls = stored(middle.join(reach, key).withColumn("ball", F.xxhash64(*key)), "balls")
    x = balls.where("not core").select("component", F.col("ball").alias("i"), F.col("centre").alias("cx"), F.col("radius").alias("rx"))
    y = balls.select("component", F.col("ball").alias("j"), F.col("centre").alias("cy"), F.col("radius").alias("ry"), F.col("core").alias("cored"))
    pairs = stored(x.join(y, "component").where(_angle("cx", "cy") <= F.col("rx") + F.col("ry") + theta + 1e-6).select("i", "j", "cored"), "cell-pairs")
    rows = mixed.withColumn("ball", F.xxhash64(*key)).select("ball", "id", "v", "n")
    own = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  columns of its own: both sides come from one table
    left = own(pairs.select("i", "j").join(rows.withColumnRenamed("ball", "i"), "i"))
    right = pairs.select("i", "j").join(rows.withColumnRenamed("ball", "j"), "j")
    count = _count_blocks(threshold)
    of_few = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(count, "id long, n long")
    cored = right.join(pairs.where("cored").select("i", "j"), ["i", "j"], "left_semi")
    of_core = cored.groupBy("i", "j").cogroup(own(left).groupBy("i", "j")).applyInPandas(count, "id long, n long")
    return of_few.unionByName(of_core).unionByName(inner).groupBy("id").agg(F.sum("n").alias("n"))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, **options: float) -> DataFrame:
    """One row (id, n_links, component_id, kept, audited_recall) per input row; the last is the recall of the final audit.

    Links: pairs with cosine >= threshold in double precision. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id, link with nothing. Vectors of different lengths don't link. Vectors
    with equal directions are one class and link with each other; rows that repeat an id are one vector (of the
    differing vectors of an id the smallest in bytes counts). Empty tables give no rows; other columns are not read.
    """
    vectors = stored(unit_vectors(rows, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    classes = stored(vectors.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "vector-classes")
    _, group, scores = neighbour_graph(classes.select("id", "v"), threshold, **options)
    counts = link_counts(classes, group, threshold)
    of_class = classes.select(F.col("id").alias("c"), "v", F.col("n").alias("copies")).join(group.withColumnRenamed("node", "c"), "c", "left").join(counts.withColumnsRenamed({"id": "c", "n": "others"}), "c", "left")
    of_class = of_class.select("v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("component_id"))
    found = vectors.join(of_class, "v").drop("v")
    out = rows.select(F.col(id_col).cast("long").alias("id")).join(found, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"), F.lit(scores[-1]["recall"]).alias("audited_recall"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("audited_recall")


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v WHERE len(e) > 0 AND list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
