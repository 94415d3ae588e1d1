"""SentencePiece encoding and decoding by a relational lattice.

Texts (with their spaces written as U+2581) are cut where no piece of the model spans two neighbouring characters, so no
merge and no best path crosses a cut. The distinct units between cuts explode into their substrings of bounded length, an
equi-join to the piece table turns these into lattice edges, edges are grouped by unit and a higher-order aggregate folds
them into the unit's pieces: Viterbi for unigram models; for BPE models, whose scores are merge ranks rather than
log-probabilities, merging the best-ranked neighbouring edges, which is what such a model defines.

Every distinct unit of the corpus goes through the lattice once. Workers put the pieces of each text together: from a
packed dictionary of the units met in most tasks, broadcast up to DICTIONARY units, and, where there are more, from the
text's own other units, joined back by a digest of the text. Word occurrences are never shuffled.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, frugal, stored, table, trim
from .shingles import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units that the workers' dictionary holds (about 24 bytes each); characters of a unit that is folded relationally (longer
#: ones, whose fold takes the square of their length, are folded by a heap); units a task of the lattice; rows of a batch.
DICTIONARY, UNIT_CHARS, LATTICE_ROWS, OUT_ROWS = 1 << 22, 64, 16_384, 256
#: Characters that are worked on at once; units that a worker remembers to have reported.
BLOCK, SEEN = 1 << 18, 1 << 20
# Kinds of pieces and algorithms in model files.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
ALGORITHMS = {1: "unigram", 2: "bpe"}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """Pieces by id: (text, score, kind); and how texts are cut."""

    pieces: list[tuple[str, float, int]]
    algorithm: str = "unigram"
    dummy_prefix: bool = True
    ids: dict[str, tuple[int, float]] = field(default_factory=dict)
    _cutter: tuple | None = None

    def __post_init__(self) -> None:
        self.ids = {p: (i, s) for i, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.ranks = {p: -s for p, (_, s) in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.lowest = min((s for _, s in self.ids.values()), default=0.0) - 10
        # no piece spans other neighbours, so no merge and no best path does: texts may be cut there
        self.neighbours = {pair for p in self.ids for pair in zip(p, p[1:])}  # noqa: B905
        self.shown = ["" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else p.replace(SPACE, " ") for p, _, kind in self.pieces]

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        pieces = []
        for k, x in top:
            if k == 1:
                p = dict(_fields(x))
                pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, NORMAL)))
        trainer = {k: v for n, x in top if n == 2 for k, v in _fields(x)}
        normal = {k: v for n, x in top if n == 3 for k, v in _fields(x)}
        algorithm = ALGORITHMS.get(trainer.get(3, 1))
        if algorithm is None or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only unigram and BPE models without text normalization are supported")
        return cls(pieces, algorithm, bool(normal.get(3, 1)))

    def escape(self, text: str) -> str:
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def fallback(self, char: str) -> list[int]:
        """Ids of a character without a piece: its bytes, or the unknown piece."""
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if len(self.bytes) == 256 else [self.unknown]

    def blocks(self, texts: list[str]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
        """(first text, characters, starts, owners): the units of these texts, some BLOCK characters at a time. A unit goes
        from its start to the next one's, and belongs to text first + owner. A longer text comes in several pieces."""
        if self._cutter is None:
            kinds = np.zeros(0x110000, np.uint16)
            inner = sorted({c for pair in self.neighbours for c in pair})
            kinds[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
            joined = np.zeros((len(inner) + 1, len(inner) + 1), bool)
            for a, b in self.neighbours:
                joined[kinds[ord(a)], kinds[ord(b)]] = True
            self._cutter = kinds, joined
        kinds, joined = self._cutter

        def block(first: int, parts: list[str]) -> tuple[int, str, np.ndarray, np.ndarray]:
            chars = "".join(parts)
            kind = kinds[np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)]
            ends = np.cumsum([len(p) for p in parts])
            start = np.ones(len(chars), bool)
            start[1:] = ~joined[kind[:-1], kind[1:]]
            start[ends[:-1][ends[:-1] < len(chars)]] = True
            starts = np.flatnonzero(start)
            return first, chars, starts, np.searchsorted(ends, starts, side="right")

        held, size, first = [], 0, 0
        for i, text in enumerate(texts):
            s = self.escape(text)
            if held and size + len(s) > BLOCK:
                yield block(first, held)
                held, size = [], 0
            first = first if held else i
            if len(s) <= BLOCK:
                held.append(s)
                size += len(s)
                continue
            a = 0
            while a < len(s):
                b = end = min(len(s), a + BLOCK)
                while b < len(s) and (s[b - 1], s[b]) in self.neighbours:
                    b -= 1
                    if b == a:  # a unit of more than a block
                        b = end
                        while b < len(s) and (s[b - 1], s[b]) in self.neighbours:
                            b += 1
                        break
                yield block(i, [s[a:b]])
                a = b
        if held:
            yield block(first, held)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one unit (or several: the result is the same), without a lattice."""
        return self._viterbi(word) if self.algorithm == "unigram" else self._merge(word)

    def _viterbi(self, word: str) -> list[int]:
        best: list[tuple[float, int, list[int]] | None] = [(0.0, 0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - self.longest), e):
                hit = self.ids.get(word[s:e])
                i, score = ([hit[0]], hit[1]) if hit else (self.fallback(word[s:e]), self.lowest) if e - s == 1 else (None, 0)
                if i is not None and (best[e] is None or best[s][0] + score > best[e][0]):
                    best[e] = (best[s][0] + score, s, i)
        out, e = [], len(word)
        while e:
            out.append(best[e][2])
            e = best[e][1]
        return [i for part in reversed(out) for i in part]

    def _merge(self, word: str) -> list[int]:
        n, ids = len(word), self.ids
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts here
        queue: list[tuple[float, int, int]] = []

        def offer(s: int) -> None:
            m = end[s]
            if m < n and (hit := ids.get(word[s : end[m]])):
                heapq.heappush(queue, (-hit[1], s, end[m]))

        for s in range(n - 1):
            offer(s)
        while queue:
            _, s, e = heapq.heappop(queue)
            m = end[s]
            if m == 0 or m >= n or end[m] != e:
                continue  # one of the two was merged meanwhile
            end[s], end[m] = e, 0
            if e < n:
                before[e] = s
            offer(s)
            if before[s] >= 0:
                offer(before[s])
        out, s = [], 0
        while s < n:
            hit = ids.get(word[s : end[s]])
            out += [hit[0]] if hit else self.fallback(word[s : end[s]])
            s = end[s]
        return out

    def decoder(self):
        """ids of many texts, one after another, and their numbers -> texts. Byte pieces are joined to UTF-8 (wrong sequences
        become U+FFFD), control pieces are silent."""
        spelt = [self.byte_of[i] if i in self.byte_of else s.encode("utf-8", "surrogatepass") for i, s in enumerate(self.shown)]
        size = np.array([len(b) for b in spelt], np.int64)
        at, data = np.cumsum(size) - size, np.frombuffer(b"".join(spelt), np.uint8)

        def run(ids: np.ndarray, counts: np.ndarray) -> list[str]:
            n = size[ids]
            out = data[_ranges(at[ids], n)].tobytes()
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
            texts = [out[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            return [t[1:] if self.dummy_prefix and t.startswith(" ") else t for t in texts]

        return run

    def decode(self, ids: list[int]) -> str:
        return self.decoder()(np.array(ids, np.int64), np.array([len(ids)]))[0]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), and so on."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def unit_hashes(chars: str, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the units that go from each start to the next (the last one to the end)."""
    x = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(x)
    if not _powers or len(_powers[0]) < n:
        one = np.ones(1, np.uint64)
        _powers[:] = [np.multiply.accumulate(np.concatenate([one, np.full(max(n, BLOCK), base)])) for base in (_BASE, _INVERSE)]
    x += np.uint64(1)
    x *= _powers[0][:n]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return mix((sums[np.append(starts[1:], n)] - sums[starts]) * _powers[1][starts])


@dataclass
class Dictionary:
    """Ids of units by hash: sorted hashes, their places in ids, and how many each has."""

    keys: np.ndarray
    first: np.ndarray
    count: np.ndarray
    ids: np.ndarray
    index: np.ndarray

    @classmethod
    def pack(cls, parts: list[tuple[bytes, bytes, bytes]]) -> Dictionary:
        """From (hashes, counts, ids) of disjoint sets of units; the numbers are kept as small as they are."""
        join = lambda k, kind: np.frombuffer(b"".join(p[k] for p in parts), kind)
        keys, count = join(0, np.uint64), join(1, np.uint16)
        ids = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(p[2], np.uint16 if len(p[2]) == 2 * int(np.frombuffer(p[1], np.uint16).sum(dtype=np.int64)) else np.int32) for p in parts)])
        first = np.zeros(len(keys), np.int64 if len(ids) >> 31 else np.int32)
        np.cumsum(count[:-1], out=first[1:])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        # where the keys with each value of the topmost bits begin: one or two keys a value
        bits = max(1, len(keys).bit_length() - 1)
        index = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        return cls(keys, first[order], count[order], ids, np.append(index, np.int32(len(keys))))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that aren't there."""
        top = (keys >> np.uint64(65 - len(self.index).bit_length())).astype(np.int64)
        at, end, found = self.index[top], self.index[top + 1], np.full(len(keys), -1)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.keys[at[live]] == keys[live]
            found[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return found


def _encoder(m: Model, words: Dictionary):
    """(texts, own units of each) -> (ids of all, number of ids of each text)."""

    def run(texts: list[str], own: list[dict | None]) -> tuple[np.ndarray, np.ndarray]:
        out, counts = [], np.zeros(len(texts), np.int64)
        for first, chars, starts, owners in m.blocks(texts):
            at = words.find(unit_hashes(chars, starts))
            n = np.where(at >= 0, words.count[at] if len(words.keys) else 0, 0).astype(np.int64)
            missing = np.flatnonzero(at < 0)
            if len(missing):
                ends = np.append(starts[1:], len(chars))
                found = [own[first + owners[i]][chars[starts[i] : ends[i]]] for i in missing]
                n[missing] = [len(f) for f in found]
            place = np.cumsum(n) - n
            ids = np.zeros(int(n.sum()), np.int32)
            known = at >= 0
            ids[_ranges(place[known], n[known])] = words.ids[_ranges(words.first[at[known]].astype(np.int64), n[known])]
            for k, i in enumerate(missing):
                ids[place[i] : place[i] + n[i]] = found[k]
            out.append(ids)
            counts += np.bincount(owners + first, weights=n, minlength=len(texts)).astype(np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts

    return run


def text_units(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(unit, n): the distinct units of all texts, and how often workers reported them, which is once for each task (or for
    each SEEN other units of it): a measure of how widespread a unit is."""
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.algorithm, model.dummy_prefix))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, seen = Model(*shared.value), np.zeros(0, np.uint64)
        for df in frames:
            for _, chars, starts, _ in m.blocks([t for t in df["text"] if isinstance(t, str)]):
                keys, at = np.unique(unit_hashes(chars, starts), return_index=True)
                if len(seen):
                    is_new = seen[np.minimum(np.searchsorted(seen, keys), len(seen) - 1)] != keys
                    keys, at = keys[is_new], at[is_new]
                ends = np.append(starts[1:], len(chars))
                if len(at):
                    yield pd.DataFrame({"unit": [chars[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]})
                seen = keys if len(seen) + len(keys) > SEEN else np.sort(np.concatenate([seen, keys]), kind="stable")  # merges two sorted runs
        trim()

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "unit string").groupBy("unit").agg(F.count("*").alias("n"))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: expressions are trees, and lambdas and merged projections repeat their parts."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_words(words: DataFrame, model: Model, col: str = "word") -> DataFrame:
    """(word, ids): distinct words of up to UNIT_CHARS characters, with spaces as U+2581, by the relational lattice
    (DataFrame functions only). The other columns are dropped; words must be distinct.

    The piece table, of model size, is broadcast. Every character has an edge: its piece, else a fallback one (id null)
    that is spelt out at the end. Null and empty words give no row.
    """
    spark = words.sparkSession
    order = {s: k for k, s in enumerate(sorted({s for _, s in model.ids.values()}, reverse=True))}
    pieces = spark.createDataFrame([(p, i, float(s), order[s]) for p, (i, s) in model.ids.items()], "piece string, own int, score double, nth long")
    # the join's key is a number, which is looked up faster than text; the texts are compared as well
    pieces = pieces.withColumn("key", F.xxhash64("piece"))
    w = words.select(F.col(col).alias("word")).where(F.length("word").between(1, UNIT_CHARS))
    n = F.length("word")
    starts = w.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + model.longest, n))).alias("e"))
    spans = spans.select("word", "s", "e", F.substring(F.col("word"), F.col("s") + 1, F.col("e") - F.col("s")).alias("sub"))
    edges = spans.withColumn("key", F.xxhash64("sub")).join(F.broadcast(pieces), "key", "left").withColumn("id", F.when(F.col("piece") == F.col("sub"), F.col("own")))
    edges = edges.where((F.col("id").isNotNull()) | (F.col("e") - F.col("s") == 1)).select("word", "s", "e", "id", F.when(F.col("id").isNotNull(), F.col("score")).alias("score"), F.when(F.col("id").isNotNull(), F.col("nth")).alias("nth"))
    place = lambda s, e: s * (2 * UNIT_CHARS) + e
    if model.algorithm == "unigram":
        edge = F.struct("e", "s", F.coalesce("score", F.lit(model.lowest)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
        lattice = edges.groupBy("word").agg(F.collect_list(edge).alias("edges"))
        # state: for each end up to now, the best score and the path there (start, id)
        start = F.array(F.struct(F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<s:int,e:int,id:int>>)").alias("path")))

        def step(state, e):
            ways = F.transform(F.filter("edges", lambda x: x["e"] == e), lambda x: F.struct((F.get(state, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).alias("s"), x["id"].alias("id")))
            grow = lambda b: F.struct(b["score"].alias("score"), F.concat(F.get(state, -b["s"])["path"], F.array(F.struct((-b["s"]).alias("s"), e.alias("e"), b["id"].alias("id")))).alias("path"))
            return F.concat(state, F.transform(F.array(F.array_max(ways)), grow))

        path = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda state: F.get(state, n)["path"])
    else:
        # an edge as one number: its place, its rank, and its id + 1 (0 for a character without a piece)
        packed = F.shiftleft(place(F.col("s"), F.col("e")).cast("long"), 48) + F.shiftleft(F.coalesce("nth", F.lit(0)).cast("long"), 24) + F.coalesce(F.col("id") + 1, F.lit(0))
        lattice = edges.groupBy("word").agg(F.collect_list(packed).alias("edges"))
        entry = lambda x: F.struct(F.shiftright(x, 48).cast("int").alias("k"), x.bitwiseAND(F.lit((1 << 48) - 1)).alias("v"))

        def bounds(edge):
            # state: where symbols begin, and the end; each step merges the best-ranked neighbours, the first of equals
            def step(state, _):
                offers = F.transform(F.slice(state, F.lit(1), F.greatest(F.size(state) - 2, F.lit(0))), lambda s, i: F.shiftright(F.try_element_at(edge, place(s, F.get(state, i + 2))), 24) * UNIT_CHARS + i)
                return _once(F.array_min(offers), lambda best: F.when(best.isNull(), state).otherwise(F.filter(state, lambda s, i: i != best % UNIT_CHARS + 1)))

            return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)

        def symbols(at, edge):
            end = lambda i: F.get(at, i + 1)
            own = lambda s, i: F.try_element_at(edge, place(s, end(i))).bitwiseAND(F.lit((1 << 24) - 1)).cast("int") - 1
            return F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda s, i: F.struct(s.alias("s"), end(i).alias("e"), own(s, i).alias("id")))

        path = _once(F.map_from_entries(F.transform("edges", entry)), lambda edge: _once(bounds(edge), lambda at: symbols(at, edge)))
    if len(model.bytes) == 256:
        table_of = F.array(*[F.lit(model.bytes[b]) for b in range(256)])
        spelt = lambda sub: F.transform(F.filter(F.split(F.regexp_replace(F.hex(sub.cast("binary")), "(..)", "$1 "), " "), lambda h: h != ""), lambda h: F.get(table_of, F.conv(h, 16, 10).cast("int")))
    else:
        spelt = lambda sub: F.array(F.lit(model.unknown))

    def ids(path):
        each = F.transform(path, lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(spelt(F.substring(F.col("word"), x["s"] + 1, x["e"] - x["s"]))))
        return F.when(F.exists(path, lambda x: x["id"] < 0), F.flatten(each)).otherwise(F.transform(path, lambda x: x["id"]))

    return lattice.select("word", _once(path, ids).alias("ids"))


def unit_table(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(unit, n), (unit, ids) and their number, stored: all distinct units, through the lattice but for those of more than
    UNIT_CHARS characters."""
    spark = docs.sparkSession
    units = stored(text_units(docs, model, text_col), "units")
    total = units.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // LATTICE_ROWS))
    found = encode_words(units.repartition(tasks, "unit"), model, "unit").withColumnRenamed("word", "unit")
    shared = spark.sparkContext.broadcast((model.pieces, model.algorithm, model.dummy_prefix))

    def long_ones(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for df in frames:
            for unit in df["unit"]:
                yield pd.DataFrame({"unit": [unit], "ids": [np.array(m.encode_word(unit), np.int32)]})

    rest = units.where(F.length("unit") > UNIT_CHARS).select("unit").mapInPandas(long_ones, "unit string, ids array<int>")
    return units, stored(found.unionByName(rest), "unit-ids"), total


def dictionary(units: DataFrame, coded: DataFrame, total: int, limit: int = DICTIONARY) -> tuple[Dictionary, DataFrame | None]:
    """(the most widespread units, packed; the others' (unit, ids), or None if all are in). About `limit` units at most:
    whole classes of like n, and of the class that exceeds it the share that fits, by hash."""
    chosen = None
    if total > limit:
        level, held, least, share = F.floor(F.log2("n")).cast("int"), 0, 64, 0.0
        for r in units.groupBy(level.alias("level")).agg(F.count("*").alias("m")).orderBy(F.desc("level")).collect():
            least, share = r["level"], min(1.0, 0.98 * (limit - held) / r["m"])
            if held + r["m"] > limit:
                break
            held += r["m"]
        chosen = (level > least) | ((level == least) & (F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) < share * (1 << 20)))
        coded = coded.join(units, "unit")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            names = list(df["unit"])
            starts = np.cumsum([0, *(len(u) for u in names)])
            keys = unit_hashes("".join(names), starts[:-1]) if names else np.zeros(0, np.uint64)
            ids = [np.asarray(x, np.int32) for x in df["ids"]]
            every = np.concatenate([np.zeros(0, np.int32), *ids])
            every = every.astype(np.uint16) if not len(every) or every.max() < 1 << 16 else every
            yield pd.DataFrame([(keys.tobytes(), np.array([len(x) for x in ids], np.uint16).tobytes(), every.tobytes())], columns=["keys", "counts", "ids"])

    parts = (coded if chosen is None else coded.where(chosen)).select("unit", "ids").mapInPandas(pack, "keys binary, counts binary, ids binary").collect()
    words = Dictionary.pack([tuple(r) for r in parts])
    del parts
    trim()
    if len(words.keys) > 1 and (words.keys[1:] == words.keys[:-1]).any():
        raise RuntimeError("two units have one hash")  # of 4 million: once in 2 million runs
    return words, None if chosen is None else coded.where(~chosen).select("unit", "ids")


def encode(docs: DataFrame, model: Model, text_col: str = "text", limit: int = DICTIONARY) -> DataFrame:
    """docs with ids (array<int>) and decoded (the text back from the ids), which replace columns of these names.

    Null texts have no ids and decode to an empty text, as empty ones do. U+2581 in a text decodes to a space, as the
    format has it. Lone surrogates are spelt in bytes. Very long texts are worked on in blocks. Other columns and repeated
    rows stay as they are; an empty table gives an empty one. limit bounds the units that are broadcast, not the result.
    """
    spark = docs.sparkSession
    frugal(spark)
    base = docs.drop("ids", "decoded")
    names = base.columns
    words, others = dictionary(*unit_table(base, model, text_col), limit)
    shared = spark.sparkContext.broadcast((words, model.pieces, model.algorithm, model.dummy_prefix))
    own, with_others = fresh("own", *names), others is not None
    if with_others:
        key = fresh("key", *names)

        def lacking(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, *rest = shared.value
            m = Model(*rest)
            for df in frames:
                texts, keys = list(df["text"]), list(df["key"])
                for first, chars, starts, owners in m.blocks(texts):
                    at = np.flatnonzero(known.find(unit_hashes(chars, starts)) < 0)
                    ends = np.append(starts[1:], len(chars))
                    pairs = {(keys[first + owners[i]], chars[starts[i] : ends[i]]) for i in at}
                    if pairs:
                        yield pd.DataFrame(list(pairs), columns=["key", "unit"])

        digest = F.md5(F.col(text_col).cast("binary"))
        wanted = base.where(F.col(text_col).isNotNull()).select(digest.alias("key"), F.col(text_col).alias("text")).mapInPandas(lacking, "key string, unit string").distinct()
        extra = wanted.join(others, "unit").groupBy("key").agg(F.collect_list(F.struct("unit", "ids")).alias(own)).withColumnRenamed("key", key)
        base = base.withColumn(key, digest).join(extra, key, "left").select(*names, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *rest = shared.value
        m = Model(*rest)
        to_ids, to_texts = _encoder(m, known), m.decoder()
        for whole in batches:
            for i in range(0, len(whole), OUT_ROWS):
                part = whole.slice(i, OUT_ROWS)
                extra = [x and {u["unit"]: u["ids"] for u in x} for x in part.column(own).to_pylist()] if with_others else [None] * len(part)
                ids, counts = to_ids([t or "" for t in part.column(text_col).to_pylist()], extra)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists, pa.array(to_texts(ids, counts), pa.string())], names=[*names, "ids", "decoded"])
        del known, m, to_ids, to_texts
        trim()

    schema = T.StructType([*base.select(*names).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return base.mapInArrow(run, schema)


def digests(encoded: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_hash (xxhash64 of the ids), decoded_md5, round_trip."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.md5(F.col("decoded").cast("binary")).alias("decoded_md5"),
        (F.col("decoded") == F.coalesce(F.col(text_col), F.lit(""))).alias("round_trip"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), Model.load()))


def stage(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the ids of each document, and whether they decode to its text (null texts: to an empty one).
    One row per row, repeated ones too; an empty table gives an empty one."""
    return encode(docs.select("doc_id", "lang", "source", "text"), Model.load()).select("doc_id", "lang", "source", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
