"""Facts, reports and documents in the shapes of the engine, from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.facts import normalized, normalized_once

# Fixed values of the test view: raw texts by key.
HEADS = (
    "Effusions", "opacity", "opacities", "pneumothoraces", "within normal limits", "hyperinflated", "atelectasis", "nodules", "Consolidation",
    "endotracheal tube", "catheters", "lines", "picc", "rib fractures", "deformity", "calcified", "scoliosis", "clear", "pleural effusion", "edema",
    "masses", "mass", "cardiomegaly", "focal opacities", "degenerative changes", "nipple shadows", "pneumonia", "infiltrates",
    "emphysematous  changes", "normal", "bronchiectasis", "",
)
PLACES = (
    "left pleural", "left lower lobe", "right upper lobe", "bilateral airspace", "lungs bilaterally", "heart size", "mediastinal contours",
    "left - sided", "right - sided pleural", "left costophrenic angle", "osseous structures", "left basilar", "bibasilar", "pulmonary venous",
    "bony thorax", "thoracic spine", "chest wall", "hila", "stomach", "", "midline", "basal", "Left and right lung", "unilateral  apex",
    "cardiopulmonary", "RIGHT Middle Lobe", "apical", "svc tip", " segment 1", "1 lobe 2", "  ",
)
MODIFIERS = ("remote", "chronic", "old", "mild", "acute", "stable", "", "Focal", "small", " 0 grade 1 ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))).cast("int"))


def _some(*values: tuple[Column, Column], kind: str) -> Column:
    """Those values whose conditions hold."""
    return F.concat(*[F.when(test, F.array(v)).otherwise(F.expr(f"cast(array() as array<{kind}>)")) for test, v in values])


def fact_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat facts: an order is a record, a line a fact; lines 1 to 3 are findings, the others impressions."""
    line = table(spark, sf_dir, "lineitem")
    part, supp, edge = F.col("l_partkey"), F.col("l_suppkey"), "struct<head:string,finding:string,assertion:string>"
    null = F.lit(None).cast("string")
    bucket = F.when(F.col("l_quantity") < 3, "other").when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "N", "negative").otherwise("uncertain")
    said = F.when(F.col("l_returnflag") == "A", "definitely present").when(F.col("l_returnflag") == "N", "Definitely Absent").otherwise("uncertain")
    said = F.when(F.col("l_discount") == 0, "").otherwise(F.concat(F.when(F.col("l_linestatus") == "F", "measurement::").otherwise(""), said))
    first = F.struct(null.alias("head"), _pick(HEADS, part * 7).alias("finding"), F.when(F.col("l_discount") > 0.05, "uncertain").otherwise("present").alias("assertion"))
    second = F.struct(_pick(HEADS, part * 11 + supp).alias("head"), null.alias("finding"), F.lit("absent").alias("assertion"))
    section = F.when(F.col("l_linenumber") <= 3, "finding").otherwise("impression")
    bucket_ord = F.when(F.col("bucket") == "positive", 0).when(F.col("bucket") == "negative", 1).when(F.col("bucket") == "uncertain", 2).otherwise(3)
    # the window is partitioned by the record alone: what follows by record needs no other exchange; texts are made after it
    line = line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    order = [F.when(F.col("l_linenumber") <= 3, 0).otherwise(1), F.when(F.col("l_quantity") < 3, 3).when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)]
    at = W.partitionBy("l_orderkey").orderBy(*order, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = line.withColumn("pos", F.row_number().over(at)).select(
        F.col("l_orderkey").alias("record_id"), section.alias("section"), bucket.alias("bucket"), "pos", _pick(HEADS, part).alias("raw_head"), said.alias("raw_assertion"),
        _some((part % 3 != 0, _pick(PLACES, supp)), (F.col("l_linenumber") % 2 == 0, _pick(PLACES, part)), kind="string").alias("locations"),
        _some((F.col("l_quantity") > 25, _pick(MODIFIERS, supp)), (F.col("l_quantity") > 40, _pick(MODIFIERS, part)), kind="string").alias("modifiers"),
        _some((F.col("l_tax") > 0.04, first), (F.col("l_tax") > 0.06, second), kind=edge).alias("suggestive_of"),
    ).withColumn("bucket_ord", bucket_ord)
    return rows.select("record_id", "section", "bucket", "bucket_ord", "pos", "raw_head", "raw_assertion", "locations", "modifiers", "suggestive_of")


def facts(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """once: texts that recur are normalized once, which takes a look at all of them before."""
    f = fact_view(spark, sf_dir)
    return normalized_once(f) if once else normalized(f)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(did, tokens): lower-case runs of a-z and 0-9."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("did"), words(F.col("text")).alias("tokens"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a conversation is a report; user turns are findings, assistant turns impressions."""
    t = table(spark, sf_dir, "conversations")
    label = F.when(F.col("role") == "user", "FINDINGS: ").when(F.col("role") == "assistant", "IMPRESSION: ").otherwise("NOTE: ")
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(label, "text").alias("line")))).alias("x"))
    path = F.concat(F.lit("files/p1/p"), F.col("conv_id") % 97, F.lit("/s"), "conv_id", F.lit(".txt"))
    return g.select(path.alias("path"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))
