"""Multiset F1 of predicted against gold facts, location errors, and recall of the knowledge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import norm, render
from . import knowledge
from .facts import edge_heads

LEVELS = ("head", "ha", "hal", "exact")


def fact_keys(facts: DataFrame, small: bool = False) -> DataFrame:
    """(record_id, keys: map level -> text) of normalized facts. Places are a set of sorted parts; the exact key adds sorted
    modifiers and edges, or (small) only whether the first edge names a finding."""
    place = lambda x: F.array_join(F.array_sort(F.split(render.place(x), " ")), " ")
    locs = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("loc", place), lambda x: x != ""))), ";")
    if small:
        extra = F.when(F.coalesce(F.get(edge_heads(F.col("suggestive_of")), F.lit(0)), F.lit("")) != "", "1").otherwise("0")
    else:
        none = F.array().cast("array<string>")
        mods = F.array_sort(F.transform(F.filter(F.coalesce("modifiers", none), lambda m: m != ""), lambda m: norm.head(m)))
        targets = edge_heads(F.col("suggestive_of"), "head")
        said = F.transform("suggestive_of", lambda e: norm.assertion(e["assertion"]))
        edges = F.array_sort(F.transform(F.filter(F.arrays_zip(targets.alias("h"), said.alias("a")), lambda x: x["h"] != ""), lambda x: F.concat_ws("=", x["h"], x["a"])))
        extra = F.concat_ws("|", F.array_join(mods, ";"), F.array_join(F.coalesce(edges, none), ";"))
    ha = F.concat_ws("|", "head", "assertion")
    hal = F.concat_ws("|", ha, locs)
    return facts.select("record_id", F.create_map(F.lit("head"), F.col("head"), F.lit("ha"), ha, F.lit("hal"), hal, F.lit("exact"), F.concat_ws("|", hal, extra)).alias("keys"))


def matches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(record_id, level, tp, n_pred, n_gold) for all records on either side; tp counts equal keys with multiplicity."""
    side = lambda df, p: df.select("record_id", F.explode("keys").alias("level", "key"), F.lit(p).alias("p"))
    n = side(predicted, 1).unionByName(side(gold, 0)).groupBy("record_id", "level", "key").agg(F.sum("p").alias("n_pred"), (F.count("*") - F.sum("p")).alias("n_gold"))
    return n.groupBy("record_id", "level").agg(F.sum(F.least("n_pred", "n_gold")).alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"))


def record_metrics(predicted: DataFrame, gold: DataFrame, records: DataFrame) -> DataFrame:
    """Per row of records (record_id): the F1 of each level and location_error_rate. An empty side has precision or recall
    1: both empty is 1, one empty 0."""
    of = lambda v, c, to: F.sum(F.when(F.col("level") == v, F.col(c))).alias(f"{v}_{to}")
    m = matches(predicted, gold).groupBy("record_id").agg(*[of(v, c, to) for v in LEVELS for c, to in (("tp", "tp"), ("n_pred", "p"), ("n_gold", "g"))])
    x = records.join(m, "record_id", "left").fillna(0)

    def f1(level: str):
        tp, p, g = (F.col(f"{level}_{c}") for c in ("tp", "p", "g"))
        # 2pr/(p+r) of tp/p and tp/g is 2tp/(p+g)
        return F.when((p == 0) & (g == 0), 1.0).when((p == 0) | (g == 0), 0.0).otherwise(2 * tp / F.greatest(p + g, F.lit(1)))

    wrong = F.when(F.col("ha_tp") > 0, (F.col("ha_tp") - F.col("hal_tp")) / F.greatest("ha_tp", F.lit(1))).otherwise(0.0)
    return x.select("record_id", *[f1(v).alias(f"{v}_f1") for v in LEVELS], wrong.alias("location_error_rate"))


def macro(per_record: DataFrame) -> DataFrame:
    """One row: number of records and the mean of each metric."""
    cols = [c for c in per_record.columns if c != "record_id"]
    return per_record.agg(F.count("*").alias("n_records"), *[F.round(F.avg(c), 6).alias(c) for c in cols])


def knowledge_ranks(facts: DataFrame, edges: DataFrame, min_count: int = 3) -> DataFrame:
    """(record_id, gold, head, rank): for each emergent gold head (in the impression, or what it suggests, but not in the
    findings) and finding head of a record, the best rank of gold among that head's candidates; null if it is none."""
    heads = facts.where("head <> ''")
    found = heads.where("section = 'finding'").select("record_id", "head").distinct()
    own = heads.where("section = 'impression'").select("record_id", F.col("head").alias("gold"))
    led = facts.where("section = 'impression'").select("record_id", F.explode(edge_heads(F.col("suggestive_of"))).alias("gold")).where("gold <> ''")
    emergent = own.unionByName(led).distinct().join(found.withColumnRenamed("head", "gold"), ["record_id", "gold"], "left_anti")
    fired = knowledge.no_acute(facts)
    # candidates depend on the head and on whether the rule holds, not on the record: rank each such case once
    kind = found.join(fired.select("record_id", F.lit(True).alias("f")), "record_id", "left").select("record_id", "head", F.coalesce("f", F.lit(False)).alias("f"))
    cases = kind.select("head", "f").distinct().select(F.struct("head", "f").alias("query_id"), "head", F.lit(None).cast("string").alias("assertion"), F.col("f").cast("string").alias("record_id"))
    rule = cases.select("record_id").where("record_id = 'true'").distinct()
    ranked = knowledge.candidates(cases, edges, rule, min_count=min_count).groupBy("query_id.head", "query_id.f", F.col("target_head").alias("gold")).agg(F.min("rank").alias("rank"))
    return emergent.join(kind, "record_id").join(ranked, ["head", "f", "gold"], "left").select("record_id", "gold", "head", "rank")


def knowledge_recall(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), compat: bool = False) -> DataFrame:
    """(k, n_correct, n_pairs): gold heads that some finding head ranks within k, of all; 'all' for any rank.

    compat: as the reference has it: a rank beyond the largest k at any finding head counts as correct at every k, and
    'all' counts only such gold heads; which of a gold head's finding heads is met last is not defined there, here a rank
    beyond the largest k wins over any other.
    """
    g = ranks.groupBy("record_id", "gold").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"))
    last = max(ks)
    hit = lambda k: (F.col("best") <= k) | ((F.col("worst") > last) if compat else F.lit(False))
    total = F.col("worst") > last if compat else F.col("best").isNotNull()
    one = g.agg(*[F.count_if(hit(k)).alias(f"k{k}") for k in ks], F.count_if(total).alias("kall"), F.count("*").alias("n"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(str(k)).alias("k"), F.col(f"k{k}").alias("n_correct"), F.col("n").alias("n_pairs")) for k in (*ks, "all")])).alias("r")).select("r.*")


def knowledge_by_head(ranks: DataFrame, min_support: int = 50) -> DataFrame:
    """(head, n, n_top1, n_top5) of finding heads asked for at least min_support gold heads."""
    return ranks.groupBy("head").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 1).alias("n_top1"), F.count_if(F.col("rank") <= 5).alias("n_top5")).where(F.col("n") >= min_support)
