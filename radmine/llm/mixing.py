"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every row gets a 60-bit hash of its id and text. Words are summed by source and hash bucket; the bucket in which a source's
cumulative sum crosses its budget is the only one that is refined, by the next bits, until the crossing bucket holds one
hash. Rows are then kept by comparing their hash with their source's threshold: no sort, one narrow table re-read per level.
Thresholds of smaller budgets lie below those of larger ones, so mixes are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_small, table

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS, HASH_BITS = 10, 60


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id_col: Column, text: Column, seed: str = "") -> Column:
    """60 bits of md5 of the id and the text's md5; a null id counts as 'null', a null text as empty."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cap: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes: (src, source_size) per source, src null allowed. Adds w and `target`.

    Weights repeat `cycle` over the sources in code point order, null last. The targets share the sum of all sizes by
    weight; a target stops at `cap` times its source's size and the excess is reshared by weight, which is the water
    level L at which sum(min(cap * size, L * weight)) equals the sum. Sources may be many (domains): they are numbered by
    ranges, and the level is raised by one aggregate for each time that sources reach their cap. An empty table gives an
    empty one.
    """
    order = [F.col("src").isNull(), F.col("src")]
    ranged = cut(sizes.repartitionByRange(*order).select("src", "source_size", F.spark_partition_id().alias("part")))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    offsets = cut(counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset")))
    nth = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + F.col("offset")
    cyc = F.array(*[F.lit(float(x)) for x in cycle])
    w = ranged.join(F.broadcast(offsets), "part").select("src", "source_size", F.element_at(cyc, (nth % len(cycle) + 1).cast("int")).alias("w"))
    w = cut(w.withColumn("cap", F.col("source_size") * F.lit(float(cap))))
    total, level = w.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        capped = F.col("cap") < level * F.col("w")
        held, free = w.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w")))).first()
        raised = (total - (held or 0.0)) / free if free else level
        if raised <= level:
            break
        level = raised
    return w.select("src", "source_size", "w", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def source_key(source: Column) -> Column:
    """A key that is never null: sources with an s before them, n for none."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def measured(rows: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(id, src, key, size, h), checkpointed."""
    return cut(rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), source_key(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col), seed).alias("h")))


def thresholds(narrow: DataFrame, cap: float, cycle: tuple[int, ...]) -> tuple[DataFrame, int]:
    """(key, source_size, target, whole, cut_at) of each source, checkpointed, and their number: rows of a source are taken
    `whole` times, and once more if their hash is below cut_at."""
    sizes = narrow.groupBy("key", "src").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, cap, cycle).withColumn("key", source_key(F.col("src")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = cut(plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    n_sources = plan.count()

    # (key, lo): the crossing bucket starts at hash lo; `below`: words under lo; `cut_at`: rows below it are taken
    state, shift, done = plan.select("key", "rest", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("below")), HASH_BITS, None
    while True:
        width, shift = shift, shift - LEVEL_BITS
        inside = narrow if width == HASH_BITS else join_small(narrow, state.select("key", "lo"), ["key"], salt=F.col("h"), rows=n_sources).where(F.shiftright("h", width) == F.shiftright("lo", width))
        buckets = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        run = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        found = (
            join_small(buckets.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))), state.select("key", "rest", "below"), ["key"], rows=n_sources)
            .withColumn("before", F.col("before") + F.col("below"))
            .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        )
        found = cut(found.select("key", "rest", F.shiftleft("bucket", shift).alias("lo"), F.col("before").alias("below"), "words", (F.col("h0") == F.col("h1")).alias("single"), "h0"))
        ended = found.where(F.col("single") | F.lit(shift <= 0)).select("key", (F.when(F.col("rest") - F.col("below") >= F.col("words") / 2, F.col("h0") + 1).otherwise(F.col("h0"))).alias("cut_at"))
        done = ended if done is None else done.unionByName(ended)
        state = found.where(~F.col("single"))
        if shift <= 0 or state.isEmpty():
            break
    # sources in which nothing crosses have rest = 0 or no words: no further copy
    final = cut(plan.join(done, "key", "left").select("key", "source_size", "target", "whole", F.coalesce("cut_at", F.lit(0)).cast("long").alias("cut_at")))
    return final, n_sources


def mix(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3), seed: str = "") -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken.

    A source whose target is q times its size gives floor(q) whole copies of every row, and one more of the rows whose
    hash is below its threshold; the crossing hash is in if that comes nearer to the target. `taken` = size * copies.

    Null text: size 0. Null source: a source of its own, ordered last. Repeated rows (one id and text) share a hash: they
    are taken together. Sources without words: target 0, taken 0. Empty table: no rows. Other columns are
    not read.
    """
    narrow = measured(rows, id_col, text_col, source_col, seed)
    final, n_sources = thresholds(narrow, cap, cycle)
    out = join_small(narrow, final, ["key"], salt=F.col("h"), rows=n_sources)
    copies = (F.col("whole") + F.when(F.col("h") < F.col("cut_at"), 1).otherwise(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def stage(docs: DataFrame, cap: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Every row as many times as the mix takes it: rows are filtered and repeated by their source's threshold. In sources
    without words every row stays once. Null ids, texts and sources as in mix(); repeated rows are taken together; an empty
    table gives an empty one; columns keep their values, whatever their names."""
    final, n = thresholds(measured(docs, "doc_id", "text", "source", ""), cap, cycle)
    own = docs.select(F.struct(*docs.columns).alias("row"), source_key(F.col("source")).alias("key"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    out = join_small(own, final, ["key"], salt=F.col("h"), rows=n)
    copies = F.when(F.col("source_size") == 0, 1).otherwise(F.col("whole") + F.when(F.col("h") < F.col("cut_at"), 1).otherwise(0)).cast("int")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS lv FROM l),
p AS (SELECT source, source_size, least(cap, coalesce(lv * w, cap))::DOUBLE AS target FROM m),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM p),
r AS (SELECT d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, h) AS here
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= rest OR (upto - here <= rest AND rest - (upto - here) >= here / 2) THEN CASE WHEN rest > 0 THEN 1 ELSE 0 END ELSE 0 END))::BIGINT AS taken
FROM r
"""
