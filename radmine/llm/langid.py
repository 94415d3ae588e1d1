"""Language identification with bit-sliced Bloom filters.

One Bloom filter row is a mask with a bit per language, so one look-up of an n-gram (the AND of its rows) returns all
languages that contain it. A text's n-grams are looked up, set bits are counted per language, and the counts are
corrected by each language's measured false-positive rate.

N-grams are trigrams centred at a letter: lower-cased code points, everything but letters being one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, frugal, join_small, stored, table

#: Bounds of training: documents of a language in the sample (expected), n-grams of a language, filter rows (2**), hashes.
SAMPLE_DOCS, GRAMS, LOG_ROWS, HASHES = 3000, 20000, 20, 3
#: A language contains an n-gram if its share there is at least this part of its largest share in any language.
RATIO = 0.25
#: Code points that are worked on at once.
BLOCK = 1 << 18
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, codes, bounds): the n-grams of these texts, those of text first + j being
    codes[bounds[j]:bounds[j + 1]]. A text over BLOCK characters comes in several pieces, each with its neighbours."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < BLOCK):
            size += len(texts[j]) + 1
            j += 1
        lower = [t.lower() for t in texts[i:j]]
        for a in range(0, max(1, len(lower[0])), BLOCK) if j == i + 1 else [None]:
            parts = lower if a is None else [lower[0][max(0, a - 1) : a + BLOCK + 1]]
            x = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            is_letter = letters()[x]
            x = np.where(is_letter, x, np.uint64(32))
            if a is not None:  # neighbours only give context
                is_letter = is_letter.copy()
                is_letter[1] &= a == 0
                if len(lower[0]) > a + BLOCK:
                    is_letter[-2] = False
            at = np.flatnonzero(is_letter)
            codes = x[at - 1] << np.uint64(42) | x[at] << np.uint64(21) | x[at + 1]
            starts = np.cumsum([1, *(len(t) + 1 for t in parts)])
            yield i, j - i, codes, np.searchsorted(at, starts)
        i = j


def rows_of(codes: np.ndarray, log_rows: int, hashes: int) -> list[np.ndarray]:
    z = codes * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return [(z >> np.uint64(log_rows * k % 44)) & np.uint64((1 << log_rows) - 1) for k in range(hashes)]


@dataclass
class Model:
    """masks: (words, rows) uint64, bit l % 64 of word l // 64 for language l; rates: false-positive rate of each."""

    langs: list[str]
    masks: np.ndarray
    rates: np.ndarray
    log_rows: int = LOG_ROWS
    hashes: int = HASHES

    @classmethod
    def build(cls, langs: list[str], lang_of: np.ndarray, codes: np.ndarray, log_rows: int = LOG_ROWS, hashes: int = HASHES) -> Model:
        masks = np.zeros((max(1, -(-len(langs) // 64)), 1 << log_rows), np.uint64)
        for r in rows_of(codes.astype(np.uint64), log_rows, hashes):
            for word in range(len(masks)):
                own = lang_of // 64 == word
                np.bitwise_or.at(masks[word], r[own], np.uint64(1) << (lang_of[own] % 64).astype(np.uint64))
        fill = np.array([np.count_nonzero(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(langs))]) / (1 << log_rows)
        return cls(langs, masks, fill**hashes, log_rows, hashes)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and those found per language."""
        n, found = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)), np.int64)
        for first, many, codes, bounds in grams(texts):
            n[first : first + many] += np.diff(bounds)
            rows = rows_of(codes, self.log_rows, self.hashes)
            for word, masks in enumerate(self.masks):
                hit = masks[rows[0]]
                for r in rows[1:]:
                    hit &= masks[r]
                for k in range(64 * word, min(64 * word + 64, len(self.langs))):
                    total = np.concatenate([[0], np.cumsum(hit >> np.uint64(k % 64) & np.uint64(1), dtype=np.int64)])
                    found[first : first + many, k] += np.diff(total[bounds])
        return n, found

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score: the corrected share of a text's n-grams that its language has; ties go to the first."""
        n, found = self.counts(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        true = np.maximum(found - n[:, None] * self.rates, 0) / (1 - self.rates)
        best = true.argmax(1)
        score = np.clip(true[np.arange(len(texts)), best] / np.maximum(n, 1), 0, 1)
        return [self.langs[b] if k else "und" for b, k in zip(best, n, strict=True)], np.where(n > 0, score, 0.0)


def fold(id_col: Column) -> Column:
    """crc32 of the id's text modulo 3 (a null id as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, n_grams: int = GRAMS) -> Model:
    """Fit on rows with text and language: about sample_docs whole texts of each language, chosen by a hash of id and text,
    and of them the up to n_grams most frequent n-grams that are not RATIO times rarer than elsewhere (of n-grams that are
    equally frequent all or none are in). What reaches the driver is bounded by languages * n_grams.

    Null ids count as an id, null texts and languages are left out, repeated rows are drawn together. An empty table gives a
    model without languages. Languages are counted, joined and cut in aggregates, however many there are."""
    frugal(docs.sparkSession)
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("langid"), F.col(id_col), F.col(text_col)).alias("h")).where("text is not null and lang is not null")
    sizes = cut(known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.count("*")).alias("share")))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for lang, texts in df.groupby("lang")["text"]:
                for _, _, codes, _ in grams(list(texts)):
                    c, n = np.unique(codes, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": c.astype(np.int64), "n": n})

    picked = join_small(known, sizes, ["lang"], salt=F.col("h")).where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    total = cut(picked.select("lang", "text").mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    everything = cut(total.groupBy("lang").agg(F.sum("n").alias("all")))
    shares = join_small(total, everything, ["lang"]).withColumn("share", F.col("n") / F.col("all"))
    own = stored(shares.join(shares.groupBy("code").agg(F.max("share").alias("most")), "code").where(F.col("share") >= RATIO * F.col("most")).select("lang", "code", "n"), "n-grams")
    # the least count that keeps no more than n_grams: from the numbers of n-grams by count
    by_count = own.groupBy("lang", "n").agg(F.count("*").alias("m"))
    upto = by_count.withColumn("upto", F.sum("m").over(W.partitionBy("lang").orderBy(F.desc("n"))))
    least = cut(upto.where(F.col("upto") <= n_grams).groupBy("lang").agg(F.min("n").alias("least")))
    top = join_small(own, least, ["lang"]).where(F.col("n") >= F.col("least")).select("lang", "code").toPandas()
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())
    index = {x: k for k, x in enumerate(langs)}
    return Model.build(langs, top["lang"].map(index).to_numpy(np.int64), top["code"].to_numpy(np.int64))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (replacing columns of these names); 'und' with score 0 where the text is null or has no
    letter, or nothing was learned. No other column is looked at. Ties go to the language that is first in code point order.
    Very long texts are read whole, in blocks; repeated rows get equal values; an empty table gives an empty one. The filter
    (2**LOG_ROWS * 8 bytes for each 64 languages) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    base = docs.drop("lang_pred", "score")
    cols = base.columns
    found = fresh("found", *cols)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        lang, score = Model(**shared.value).predict([x if isinstance(x, str) else "" for x in text])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return base.withColumn(found, predict(F.col(text_col))).select(*cols, f"{found}.lang_pred", f"{found}.score")


def fit(docs: DataFrame) -> Model:
    return train(docs.where(fold(F.col("doc_id")) != 1))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


#: Documents whose language has less than this share of their n-grams are rejected by the pipeline.
MIN_SCORE = 0.2


def stage(docs: DataFrame) -> DataFrame:
    """Documents in a language that the filters know; null, letterless and unrecognizable texts go. Repeated rows stay
    repeated, an empty table empty; columns keep their values, whatever their names."""
    out = identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), fit(docs.select("doc_id", "text", "lang")))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")
