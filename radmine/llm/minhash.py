"""Near-duplicate documents by DartMinHash signatures and banded joins.

Darts are thrown by hashing into the regions (weight x rank) of each weighted shingle; a document keeps those below its
shingles' weights and below a rank that leaves about k ln k + 2k of them, and the earliest dart of each of k coordinates
is its signature (Christiani, 2020). Equal signature bands make candidates, exact weighted Jaccard decides.

Documents with equal shingle weights are one class from the start. Within a band bucket all classes are compared with one,
that which meets most others over all bands (the centre of a group of copies); components of the links so far follow; only members of different components of a bucket are then
compared with each other, by an exact prefix join over their shingles, the rarest first. Links inside a component cannot change it, so none that counts is lost, and a group of copies costs a number of pairs
proportional to its size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, frugal, join_small, stored, table, trim
from .shingles import mix, shingle_arrays

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 5
#: Rank axis: [0, FIRST), doubling up to STEP, then steps of STEP.
FIRST, STEP = 0.25, 8.0
_G, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _region(j: int) -> tuple[float, float]:
    doublings = int(math.log2(STEP / FIRST))
    if j <= doublings:
        return (0.0 if j == 0 else FIRST * 2.0 ** (j - 1)), FIRST * 2.0**j
    return STEP * (j - doublings), STEP * (j - doublings + 1)


def _poisson_cdf(mean: float) -> np.ndarray:
    p, out, total, i = math.exp(-mean), [], 0.0, 0
    while total < 1 - 1e-15 and i < 100:
        total += p
        out.append(total)
        i += 1
        p *= mean / i
    return np.array(out)


_cdfs: dict[float, np.ndarray] = {}


def _throw(cells: np.ndarray, room: np.ndarray, doc: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, rank, hash) of the darts kept: cells are unit weight cells, room the weight that is in each."""
    found, j = [], 0
    limit = theta[doc]
    while True:
        low, high = _region(j)
        on = np.flatnonzero(limit > low)
        if not len(on):
            break
        cdf = _cdfs.setdefault(high - low, _poisson_cdf(high - low))
        h = mix(cells[on] + np.full(1, j + 1, np.uint64) * _A)
        n = np.searchsorted(cdf, _unit(h), side="right")
        who = np.repeat(on, n)
        nth = (np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        d = mix(np.repeat(h, n) + (nth + np.uint64(1)) * _G)
        rank = low + (high - low) * _unit(mix(d ^ _A))
        keep = (rank < limit[who]) & (_unit(mix(d ^ _B)) < room[who])
        found.append((doc[who[keep]], rank[keep], d[keep]))
        j += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """(len(sets), k) uint64 signatures of (hashes, weights); P(equal coordinate) is the weighted Jaccard similarity.
    Sets must not be empty. Time is linear in the sum of weights."""
    sig, rank = np.zeros((len(sets), k), np.uint64), np.full((len(sets), k), np.inf)
    theta = np.array([(k * math.log(k) + 2 * k) / w.sum() for _, w in sets])
    todo = np.arange(len(sets))
    while len(todo):
        cells, rooms, docs = [], [], []
        for i in todo:
            h, w = sets[i]
            n = np.ceil(w).astype(np.int64)
            if n.max() == 1:
                cells.append(mix(h + _G))
                rooms.append(w.astype(np.float64))
            else:
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cells.append(mix(np.repeat(h, n) + (nth.astype(np.uint64) + np.uint64(1)) * _G))
                rooms.append(np.minimum(1.0, np.repeat(w, n) - nth))
            docs.append(np.full(len(cells[-1]), i))
        doc, r, d = _throw(np.concatenate(cells), np.concatenate(rooms), np.concatenate(docs), theta)
        at = doc * k + (d % np.uint64(k)).astype(np.int64)
        order = np.argsort(-r, kind="stable")  # of several assignments to a place the last, the earliest dart, holds
        sig.reshape(-1)[at[order]], rank.reshape(-1)[at[order]] = d[order], r[order]
        todo = todo[np.isinf(rank[todo]).any(axis=1)]
        theta[todo] *= 2
    return sig


def weighted(h: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.unique(h, return_counts=True)
    return u, (n.astype(np.float64) if weights == "count" else np.ones(len(u)))


def _key(u: np.ndarray, w: np.ndarray) -> bytes:
    return hashlib.md5(u.tobytes() + (b"" if (w == 1).all() else w.tobytes())).digest()


def jaccard(a: tuple, b: tuple) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def row_id(id_col: Column, text: Column) -> Column:
    """Key of a row: its id and a hash of its text, so that null and repeated ids don't mix up different texts."""
    return F.concat_ws(":", id_col.cast("string"), F.hex(F.xxhash64(text)))


def _sign(width: int, weights: str, bands: int, rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            ids, texts = df["rid"].to_numpy(), list(df["text"])
            batch, size, at = [], 0, 0
            for h in shingle_arrays(texts, width):
                if len(h):
                    batch.append((ids[at], *weighted(h, weights)))
                    size += len(h)
                at += 1
                if batch and (size > 100_000 or len(batch) >= 256 or at == len(texts)):
                    sig = signatures([(u, w) for _, u, w in batch], bands * rows)
                    out = []
                    for s, (rid, u, w) in zip(sig.reshape(len(batch), bands, rows), batch, strict=True):
                        band = np.arange(bands, dtype=np.uint64) * _G
                        for c in range(rows):
                            band = mix(band + s[:, c] * _B)
                        out.append((rid, _key(u, w), int(w.sum()), band.view(np.int64)))
                    yield pd.DataFrame(out, columns=["rid", "c", "n", "bands"])
                    batch, size = [], 0
        trim()

    return run


def _sets(width: int, weights: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for h in shingle_arrays(list(df["text"]), width):
                if len(h):
                    u, w = weighted(h, weights)
                    out.append((_key(u, w), u.tobytes(), b"" if weights == "set" else w.astype(np.uint32).tobytes()))
                if len(out) >= 200:
                    yield pd.DataFrame(out, columns=["c", "u", "w"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["c", "u", "w"])

    return run


def _load(u: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(u, np.uint64)
    return h, (np.frombuffer(w, np.uint32).astype(np.float64) if w else np.ones(len(h)))


def _spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        for c, u, w in zip(df["c"], df["u"], df["w"], strict=True):
            h, weight = _load(u, w)
            yield pd.DataFrame({"h": h.view(np.int64), "c": [c] * len(h), "w": weight})


def _prefix(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for c, n, component, h, often, w in zip(*(df[x] for x in ("c", "n", "component", "h", "df", "w")), strict=True):
                h, first = np.unique(np.asarray(h), return_index=True)  # repeated rows gave their shingles again
                often, w = np.asarray(often)[first], np.asarray(w)[first]
                order = np.lexsort((h, often))
                h, often, w = h[order], often[order], w[order]
                left = n - (np.cumsum(w) - w)  # weight from this shingle on
                keep = (left >= threshold * n - 1e-6) & (often > 1)
                if keep.any():
                    k = int(keep.sum())
                    yield pd.DataFrame({"c": [c] * k, "n": n, "component": [component] * k, "h": h[keep], "left": left[keep]})

    return run


def _verify(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            sims = [jaccard(_load(ua, wa), _load(ub, wb)) for ua, wa, ub, wb in zip(df["ua"], df["wa"], df["ub"], df["wb"], strict=True)]
            yield df[["a", "b"]][np.array(sims) >= threshold]

    return run


def classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int, weights: str, bands: int, rows: int) -> DataFrame:
    """(rid, id, component, class_id, kept), one row per input row: see near_duplicates; component is null where there are no words."""
    frugal(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), row_id(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    signed = stored(own.select("rid", "text").mapInPandas(_sign(width, weights, bands, rows), "rid string, c binary, n long, bands array<long>"), "signatures")
    classes = stored(signed.groupBy("c").agg(F.min("rid").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select(F.explode("bands").alias("band"), "c", "n")
    sizes = buckets.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    meeting = stored(buckets.join(sizes, "band"), "meeting")
    # the class that meets most others over all its bands is nearest to a group's centre
    meets = meeting.groupBy("c").agg(F.sum("m").alias("meets"))
    ranked = stored(meeting.select("band", "c", "n").join(meets, "c"), "ranked")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("meets", "c", "n")).alias("hub"))
    shared = stored(ranked.drop("meets").join(hubs, "band"), "buckets")

    close = lambda a, b: F.least(a, b) >= F.greatest(a, b) * threshold  # noqa: E731  else the similarity is below
    first = cut(shared.where("c <> hub.c").where(close(F.col("n"), F.col("hub.n"))).select(F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b")).distinct())
    wanted = cut(shared.select("c").distinct().join(classes.select("c", "rep"), "c").select(F.col("rep").alias("rid")))
    sets = stored(join_small(own.select("rid", "text"), wanted.distinct(), ["rid"], "left_semi").select("text").mapInPandas(_sets(width, weights), "c binary, u binary, w binary"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("c").alias(x), F.col("u").alias(f"u{x}"), F.col("w").alias(f"w{x}")) for x in "ab")
        return cut(pairs.join(b, "b").join(a, "a").mapInPandas(_verify(threshold), "a binary, b binary"))

    links = verified(first)
    group = components(links)
    member = shared.join(group.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    split = member.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
    rest = member.join(split, "band", "left_semi")
    # an exact join by rare shingles (prefix and positions): in the order of their frequency here, the first shingle that two
    # classes share leaves each of them no more than the weight from there on in common
    nodes = cut(rest.select("c", "n", "component").distinct())
    spread = sets.join(nodes.select("c"), "c", "left_semi").mapInPandas(_spread, "h long, c binary, w double")
    known = spread.join(spread.groupBy("h").agg(F.count("*").alias("df")), "h")
    listed = known.groupBy("c").agg(*[F.collect_list(x).alias(x) for x in ("h", "df", "w")]).join(nodes, "c")
    first_ones = stored(listed.select("c", "n", "component", "h", "df", "w").mapInPandas(_prefix(threshold), "c binary, n long, component binary, h long, left double"), "prefixes")
    a, b = first_ones, first_ones.select("h", *[F.col(x).alias(f"{x}2") for x in ("c", "n", "component", "left")])
    needed = (F.col("n") + F.col("n2")) * (threshold / (1 + threshold)) - 1e-6
    second = a.join(b, "h").where((F.col("component") < F.col("component2")) & (F.least("left", "left2") >= needed))
    second = second.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b")).distinct()
    second = cut(second.join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        group = components(links.unionByName(verified(second)))
    of_class = classes.select("c").join(group.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("component", "c").alias("component"))
    rows_of = own.select("id", "rid").join(signed.select("rid", "c").distinct().join(of_class, "c"), "rid", "left")
    known = cut(rows_of)
    smallest = known.where("component is not null").groupBy("component").agg(F.min("id").alias("class_id"))
    out = known.join(smallest, "component", "left").select("rid", "id", "component", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("class_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, weights: str = "set", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row (id, class_id, kept) per input row: classes are the components of links with (weighted) Jaccard similarity
    of `width`-word shingles >= threshold; class_id is the smallest id of a class, kept says id = class_id.

    weights: 'set' (every shingle weighs 1) or 'count' (its occurrences). A pair at 0.8 is missed by all 32 bands of 5
    with probability 3e-6. Null, empty and wordless texts link with nothing: their class is their own id. Rows that
    repeat an id and text are one document; other texts of an id are classed by themselves. Null ids: class_id is the smallest known id of their class, or null; such a
    row is kept if its class has no known id. Empty tables give no rows; other columns are not read.
    """
    out = classified(docs, id_col, text_col, threshold, width, weights, bands, rows)
    return out.select(F.col("id").alias(id_col), "class_id", "kept")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(docs: DataFrame) -> DataFrame:
    """One row of each class of near-duplicates stays: of the smallest id (null ids last), then of the smallest hash of the
    text, and of equal rows one. Null, empty and wordless texts are in no class and stay, repeated ones too. An empty table
    gives an empty one; columns keep their values, whatever their names."""
    found = classified(docs.select("doc_id", "text"), "doc_id", "text", THRESHOLD, WIDTH, "set", BANDS, ROWS)
    grouped = found.where("component is not null").groupBy("component", "rid").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("first"))
    marked = cut(grouped.join(first, "component").select("rid", (F.col("rid") == F.col("first.rid")).alias("stays"), "n"))
    names = docs.columns
    own = docs.select(F.struct(*names).alias("row"), row_id(F.col("doc_id"), F.col("text")).alias("rid"))
    left = join_small(own, marked.where("not stays").select("rid"), ["rid"], "left_anti")
    again = cut(marked.where("stays and n > 1").select("rid"))
    n = again.count()
    if n:  # equal rows: one of each
        once = join_small(left, again, ["rid"], rows=n).groupBy("rid").agg(F.first("row").alias("row")).select("row")
        left = join_small(left, again, ["rid"], "left_anti", rows=n).select("row").unionByName(once)
    return left.select("row.*")
