"""Edit-aware token counts.

A document's pre-tokens are kept in blocks under a segment tree of character and token sums; trees are a table that is
stored beside the corpus. An edit finds its blocks by the sums, re-splits only from a little before its start until the
split falls on an old boundary again, re-encodes those pre-tokens and updates the sums on the paths of the blocks it
touched. Other blocks stay packed.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, stored, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Whether a pre-token ends where it does depends on no more than so many characters after it.
LOOK = 2
BLOCK, CACHE, OUT_ROWS = 64, 200_000, 500


class Counter:
    """Pre-tokens of a text and their token counts, by a cache of bounded size."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.cache = regex.compile(PATTERN), {}

    def count(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) < 100:
                self.cache[piece] = n
        return n

    def split(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(lengths, counts) of the text's pre-tokens, in blocks."""
        pieces: list[str] = []
        for m in self.pattern.finditer(text) if len(text) > 1 << 20 else self.pattern.findall(text):
            pieces.append(m if isinstance(m, str) else m[0])
            if len(pieces) == BLOCK:
                yield self.block(pieces)
                pieces = []
        if pieces:
            yield self.block(pieces)

    def block(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        get, count = self.cache.get, self.count
        return np.array([len(p) for p in pieces], np.int64), np.array([get(p) or count(p) for p in pieces], np.int64)


def pack(lengths: np.ndarray, counts: np.ndarray) -> bytes:
    """A block's bytes: the width of its numbers, lengths, counts."""
    width = 1 if not len(lengths) or max(lengths.max(), counts.max()) < 256 else 4
    kind = np.uint8 if width == 1 else np.uint32
    return bytes([width]) + lengths.astype(kind).tobytes() + counts.astype(kind).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint8 if data[0] == 1 else np.uint32, offset=1).astype(np.int64)
    return x[: len(x) // 2], x[len(x) // 2 :]


@dataclass
class Block:
    """Characters, tokens and pre-tokens of a block, and its lengths and counts, packed until they are needed."""

    chars: int
    tokens: int
    size: int
    data: bytes | tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, lengths: np.ndarray, counts: np.ndarray) -> Block:
        return cls(int(lengths.sum()), int(counts.sum()), len(lengths), (lengths, counts))


class TokenTree:
    """Token count of a text under edits. `encoded`, `read`: pre-tokens encoded and unpacked by edits so far."""

    def __init__(self, counter: Counter, text: str, blocks: list[Block] | None = None) -> None:
        """From the text, or from the blocks that were kept of it, which are not split again."""
        self.counter, self.text, self.encoded, self.read = counter, text, 0, 0
        self._build([Block.of(*b) for b in counter.split(text)] if blocks is None else blocks)

    def _build(self, blocks: list[Block]) -> None:
        self.blocks = blocks
        self.base = 1 << max(0, len(blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, b in enumerate(blocks):
            self.chars[self.base + i], self.tokens[self.base + i] = b.chars, b.tokens
        for i in range(self.base - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.blocks[i]
        if isinstance(b.data, bytes):
            b.data = unpack(b.data)
            self.read += b.size
        return b.data

    def kept(self) -> list[Block]:
        """Blocks to keep; those that no edit has touched are as they were."""
        return [b if isinstance(b.data, bytes) else Block(b.chars, b.tokens, b.size, pack(*b.data)) for b in self.blocks if b.size]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return sum(b.size for b in self.blocks)

    def _find(self, at: int) -> tuple[int, int]:
        """(block, its start) that holds the character at this offset; the last block for the text's end."""
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.base, start

    def _put(self, i: int, block: Block) -> None:
        self.blocks[i] = block
        i += self.base
        self.chars[i], self.tokens[i] = block.chars, block.tokens
        while i := i // 2:
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, a: int, b: int, new: str) -> int:
        """Put `new` in place of text[a:b] and return the new count; offsets are clamped to the text."""
        a = min(max(a, 0), len(self.text))
        b = min(max(b, a), len(self.text))
        self.text = self.text[:a] + new + self.text[b:]
        if not self.blocks:
            self._build([Block.of(*x) for x in self.counter.split(self.text)])
            self.encoded += self.n_pretokens
            return self.n_tokens
        # the first pre-token whose end can depend on what changes
        i, start = self._find(max(0, a - LOOK - 1))
        ends = start + np.cumsum(self._block(i)[0])
        k = int(np.searchsorted(ends, a - LOOK, side="right"))
        while k == len(ends) and i + 1 < len(self.blocks):
            i, start = i + 1, int(ends[-1]) if len(ends) else start
            ends = start + np.cumsum(self._block(i)[0])
            k = int(np.searchsorted(ends, a - LOOK, side="right"))
        k = min(k, max(0, len(ends) - 1))
        at = start + int(self._block(i)[0][:k].sum())
        # split anew until an old boundary at or after b comes up
        j, j_start = i, start
        bounds = j_start + np.concatenate([[0], np.cumsum(self._block(j)[0])])
        shift, pieces, pos = len(new) - (b - a), [], at
        done, m = False, 0
        while True:
            was = pos - shift
            if was >= b and pos >= a + len(new):
                while was > bounds[-1] and j + 1 < len(self.blocks):
                    j_start, j = int(bounds[-1]), j + 1
                    bounds = j_start + np.concatenate([[0], np.cumsum(self._block(j)[0])])
                m = int(np.searchsorted(bounds, was))
                if m < len(bounds) and bounds[m] == was:
                    done = True
                    break
            found = self.counter.pattern.match(self.text, pos)
            if found is None or found.end() == pos:
                break
            pieces.append(found[0])
            pos = found.end()
        if not done:
            j, m = len(self.blocks) - 1, self.blocks[-1].size
        lengths, counts = self.counter.block(pieces) if pieces else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.encoded += len(pieces)
        block = (np.concatenate([self._block(i)[0][:k], lengths, self._block(j)[0][m:]]), np.concatenate([self._block(i)[1][:k], counts, self._block(j)[1][m:]]))
        if len(block[0]) > 4 * BLOCK:  # too large: deal the blocks anew
            cut = [Block.of(block[0][x : x + BLOCK], block[1][x : x + BLOCK]) for x in range(0, len(block[0]), BLOCK)]
            self._build([x for x in [*self.blocks[:i], *cut, *self.blocks[j + 1 :]] if x.size])
            return self.n_tokens
        self._put(i, Block.of(*block))
        for x in range(i + 1, j + 1):
            self._put(x, Block.of(np.zeros(0, np.int64), np.zeros(0, np.int64)))
        return self.n_tokens


#: A document's kept tree: its text and blocks. Block sums are read whole, lengths and counts where an edit needs them.
TREE = "doc_id long, text string, chars array<int>, tokens array<int>, sizes array<int>, blocks array<binary>"
_COUNTS = "n_tokens long, n_tokens_edited long, n_encoded long, n_read long, n_pretokens long"


def _rows(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})


def _kept(tree: TokenTree) -> tuple:
    blocks = tree.kept()
    return tree.text, [b.chars for b in blocks], [b.tokens for b in blocks], [b.size for b in blocks], [b.data for b in blocks]


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The tree of each document, as a table (TREE) to be written and kept beside the corpus: a row per row.

    Null ids stay null; null texts are empty and have no blocks; repeated rows repeat; an empty table gives no rows; other
    columns are not read. The vocabulary file must exist on every executor."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(vocabulary)
        for df in frames:
            for i in range(0, len(df), OUT_ROWS):
                part = df.iloc[i : i + OUT_ROWS]
                yield _rows([(doc, *_kept(TokenTree(counter, text if isinstance(text, str) else ""))) for doc, text in zip(part["id"], part["text"], strict=True)], TREE)

    frugal(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, TREE)


def apply_edits(trees: DataFrame, edits: str = "edits", keep: bool = True, vocabulary: str = VOCABULARY) -> DataFrame:
    """Kept trees (TREE, with a column of edits) after their edits, with counts: n_tokens before and n_tokens_edited after,
    n_encoded pre-tokens that were encoded anew, n_read that were unpacked, of n_pretokens. keep=False leaves the trees out.

    `edits`: array<struct<start int, end int, text string>>, applied in order, each to the text the ones before it left;
    null arrays are empty, null entries skipped, null offsets 0, offsets beyond the text its end, a null replacement empty.
    Rows of null text or blocks are empty documents; repeated rows repeat; an empty table gives no rows. No text is split
    or encoded but around its edits."""
    schema = f"{TREE}, {_COUNTS}" if keep else f"doc_id long, {_COUNTS}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(vocabulary)
        for df in frames:
            rows = []
            for doc, text, chars, tokens, sizes, blocks, own in zip(*(df[c] for c in ("doc_id", "text", "chars", "tokens", "sizes", "blocks", "edits")), strict=True):
                known = [] if blocks is None or text is None else [Block(int(c), int(t), int(n), bytes(b)) for c, t, n, b in zip(chars, tokens, sizes, blocks, strict=True)]
                tree = TokenTree(counter, text if known else "", known)
                before, pieces = tree.n_tokens, tree.n_pretokens
                for e in own if own is not None else []:
                    if e is not None:
                        tree.edit(int(e["start"] or 0), int(e["end"] or 0), e["text"] or "")
                rows.append((doc, *(_kept(tree) if keep else ()), before, tree.n_tokens, tree.encoded, tree.read, pieces))
                if len(rows) >= OUT_ROWS:
                    yield _rows(rows, schema)
                    rows = []
            yield _rows(rows, schema)

    frugal(trees.sparkSession)
    return trees.select(*[x.split()[0] for x in TREE.split(", ")], F.col(edits).alias("edits")).mapInPandas(run, schema)


def count_edited(docs: DataFrame, edits: str = "edits", text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, counts as of apply_edits) of documents with a column of edits whose trees were not kept: they are built,
    stored, and edited from the store. Rows are paired with their edits by carrying both; nulls and repeated rows as there."""
    both = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(edits).alias("edits"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(vocabulary)
        for df in frames:
            for i in range(0, len(df), OUT_ROWS):
                part = df.iloc[i : i + OUT_ROWS]
                rows = [(doc, *_kept(TokenTree(counter, text if isinstance(text, str) else ""))) for doc, text in zip(part["id"], part["text"], strict=True)]
                yield _rows(rows, TREE).assign(edits=part["edits"].to_numpy())

    frugal(docs.sparkSession)
    schema = T.StructType([*docs.sparkSession.createDataFrame([], TREE).schema.fields, T.StructField("edits", both.schema["edits"].dataType)])
    trees = stored(both.mapInPandas(run, schema), "token-trees", compression="zstd", **{"parquet.block.size": str(16 << 20)})
    return apply_edits(trees, keep=False, vocabulary=vocabulary)


def sample_edits(docs: DataFrame, text_col: str = "text", name: str = "edits") -> DataFrame:
    """docs with three edits of each text: a deletion in its second quarter, an insertion at its middle, and a sentence
    at its end; for measuring and tests."""
    n = F.coalesce(F.length(text_col), F.lit(0))
    quarter, half = F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int")
    e = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(t).alias("text"))
    return docs.withColumn(name, F.array(e(quarter, quarter + 12, ""), e(half, half, " inserted words, and 1234"), e(n * 2, n * 2, " The end.")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents are built and stored; edits are then applied to the stored trees."""
    trees = stored(token_trees(table(spark, sf_dir, "documents").select("doc_id", "text")), "token-trees", compression="zstd", **{"parquet.block.size": str(16 << 20)})
    return apply_edits(sample_edits(trees), keep=False)
