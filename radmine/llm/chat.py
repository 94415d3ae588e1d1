"""Collapse of cumulative conversation snapshots, and rendering (DataFrame functions only).

A logged conversation often exists again in every later, longer log. Each turn is hashed once, prefixes get rolling
hashes, and an anti-join against the distinct proper prefixes leaves the maximal conversations; only these are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

START, END = "<|im_start|>", "<|im_end|>\n"


def piece(role: Column, text: Column, start: str = START, end: str = END) -> Column:
    """One rendered turn; a null role renders as unknown, a null text as nothing."""
    return F.concat(F.lit(start), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(end))


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", start: str = START, end: str = END) -> DataFrame:
    """One row (conv id, n_turns, text) per maximal conversation.

    Turns are ordered by (turn, rendered piece), null turns first. A conversation goes if its rendered turns are a proper
    prefix of another's, or equal those of one with a smaller id. Turns with a null id are conversations of one turn
    each, equal ones being one; against others they count as having the largest id. Repeated rows are repeated turns.
    Empty tables give no rows; other columns are not read. A conversation is one row of the result, so the turns of one
    conversation meet in one task; copies of a conversation, turn or prefix do not.
    """
    p = piece(F.col(role_col), F.col(text_col), start, end)
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), p.alias("piece")).withColumn("h", F.md5(F.col("piece").cast("binary")))
    t = t.withColumn("key", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.concat(F.lit("n"), F.col("h"))))
    single = F.col("conv").isNull()
    known = t.where(~single).groupBy("key", "conv").agg(F.array_sort(F.collect_list(F.struct("turn", "h"))).alias("turns"))
    unknown = t.where(single).groupBy("key", "conv").agg(F.min(F.struct("turn", "h")).alias("x")).select("key", "conv", F.array("x").alias("turns"))
    rolled = F.aggregate("turns", F.expr("cast(array() as array<string>)"), lambda acc, x: F.concat(acc, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), x["h"]).cast("binary")))))
    convs = cut(known.unionByName(unknown).select("key", "conv", rolled.alias("prefixes")))
    whole = convs.groupBy(F.element_at("prefixes", -1).alias("h")).agg(F.min(F.struct(F.col("conv").isNull().alias("no_id"), "conv", "key")).alias("first"))
    proper = convs.where(F.size("prefixes") > 1).select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("h")).distinct()
    keep = whole.join(proper, "h", "left_anti").select("first.key")
    kept = t.join(keep, "key").drop("h")
    one = kept.where(single).groupBy("key", "conv").agg(F.first("piece").alias("text")).select("conv", F.lit(1).cast("long").alias("n_turns"), "text")
    many = kept.where(~single).groupBy("key", "conv").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("turns"))
    # equal turn numbers are ordered by the hash, as the prefixes were
    many = many.select("conv", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.transform("turns", lambda x: F.struct(x["turn"].alias("turn"), F.md5(x["piece"].cast("binary")).alias("h"), x["piece"].alias("piece")))), lambda x: x["piece"]), "").alias("text"))
    return many.unionByName(one).select(F.col("conv").alias(conv_col), "n_turns", "text")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH t AS (SELECT conv_id, turn, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS p FROM conversations),
x AS (SELECT conv_id, row_number() OVER w AS i, string_agg(p, '') OVER w AS pre, count(*) OVER (PARTITION BY conv_id) AS n
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(p) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT min(conv_id) AS conv_id, n AS n_turns, pre AS text FROM x WHERE i = n GROUP BY pre, n)
SELECT conv_id, n_turns::BIGINT AS n_turns, text FROM f WHERE text NOT IN (SELECT pre FROM x WHERE i < n)
"""
