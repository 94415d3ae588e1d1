"""Normalized facts, and what whole sections say: tokens, texts, sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import norm, render


def normalized(facts: DataFrame, compat: bool = True) -> DataFrame:
    """facts with head, assertion and loc (normalized locations)."""
    return facts.withColumns({"head": norm.head(F.col("raw_head"), compat), "assertion": norm.assertion(F.col("raw_assertion")), "loc": norm.locations(F.col("locations"))})


#: Distinct texts or lists of texts (some 200 bytes each) up to which what is made of them is broadcast.
BROADCAST_TEXTS = 100_000


def by_text(facts: DataFrame, **values: tuple[str, Callable[[Column], Column]]) -> DataFrame:
    """facts with name=(column, value): value(column), made once for each distinct value of the column and joined to the facts
    that have it. Where there are too many to broadcast (estimated within a few hundredths), each fact's own is made."""
    n = facts.agg(*[F.approx_count_distinct(raw).alias(name) for name, (raw, _) in values.items()]).first()
    out = facts
    for name, (raw, value) in values.items():
        if n[name] > BROADCAST_TEXTS:
            out = out.withColumn(name, value(F.col(raw)))
            continue
        known = facts.select(raw).where(F.col(raw).isNotNull()).distinct().select(F.col(raw).alias("_raw"), value(F.col(raw)).alias("_known"))
        nothing = value(F.lit(None).cast(facts.schema[raw].dataType))
        out = out.join(F.broadcast(known), F.col(raw) == F.col("_raw"), "left").withColumn(name, F.when(F.col(raw).isNull(), nothing).otherwise(F.col("_known"))).drop("_raw", "_known")
    return out


def normalized_once(facts: DataFrame, compat: bool = True) -> DataFrame:
    """normalized() for texts that recur: each distinct head and each distinct list of locations is normalized once."""
    out = by_text(facts, head=("raw_head", lambda c: norm.head(c, compat)), loc=("locations", norm.locations))
    return out.select(*facts.columns, "head", norm.assertion(F.col("raw_assertion")).alias("assertion"), "loc")


def _in_order(value, name: str):
    """The values of a group in fact order, nulls left out."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("bucket_ord", "pos", value.alias("v"))))), lambda x: x["v"]).alias(name)


def case_tokens(facts: DataFrame) -> DataFrame:
    """(record_id, tokens) of the finding sections, in fact order; records without tokens have no row."""
    t = facts.where("section = 'finding'").withColumn("t", render.fact_tokens(F.col("head"), F.col("raw_assertion"), F.col("loc")))
    return t.groupBy("record_id").agg(F.flatten(_in_order(F.col("t"), "tokens")).alias("tokens")).where(F.size("tokens") > 0)


def edge_heads(edges, key: str = "finding", compat: bool = True):
    """Normalized targets of edges: by their finding only, or by finding else head ('any'), or head else finding ('head')."""
    pick = {"finding": lambda e: e["finding"], "any": lambda e: F.coalesce(F.nullif(e["finding"], F.lit("")), e["head"]), "head": lambda e: F.coalesce(F.nullif(e["head"], F.lit("")), e["finding"])}[key]
    return F.transform(F.coalesce(edges, F.array().cast("array<struct<head:string,finding:string,assertion:string>>")), lambda e: norm.head(pick(e), compat))


def case_texts(facts: DataFrame) -> DataFrame:
    """(record_id, finding_text, impression_text): one line per fact with a head."""
    line = F.when(F.col("section") == "finding", render.finding_line(F.col("head"), F.col("raw_assertion"), F.col("loc"))).otherwise(render.impression_line(F.col("head"), F.col("raw_assertion"), edge_heads(F.col("suggestive_of"))))
    t = facts.withColumn("line", F.when(F.col("head") != "", line))
    part = lambda s: F.array_join(_in_order(F.when(F.col("section") == s, F.col("line")), s), "\n").alias(f"{s}_text")
    return t.groupBy("record_id").agg(part("finding"), part("impression"))


def told(facts: DataFrame, section: str = "impression", strict: bool = False) -> DataFrame:
    """(record_id, text, sentences, n_facts): a section in sentences; facts that can't be told are left out of the text but
    counted, or raise with strict."""
    s = facts.where(F.col("section") == section).withColumn("s", render.sentence(F.col("raw_head"), F.col("raw_assertion"), F.col("modifiers"), F.col("locations"), F.col("suggestive_of"), strict))
    g = s.groupBy("record_id").agg(_in_order(F.col("s"), "sentences"), F.count("*").alias("n_facts"))
    return g.select("record_id", F.array_join("sentences", " ").alias("text"), "sentences", "n_facts")


def repacked(parsed: DataFrame, column: str = "facts") -> DataFrame:
    """parsed with graph: an array of facts dealt into buckets by assertion (present, absent, anything else uncertain)."""
    pick = lambda test: F.filter(column, test)
    return parsed.withColumn("graph", F.struct(pick(lambda f: f["assertion"] == "present").alias("positive"), pick(lambda f: f["assertion"] == "absent").alias("negative"), pick(lambda f: ~F.coalesce(f["assertion"], F.lit("")).isin("present", "absent")).alias("uncertain"), F.filter(column, lambda f: F.lit(False)).alias("other")))


def flipped(facts: DataFrame, section: str = "impression") -> DataFrame:
    """facts with left and right swapped in the section's raw locations: planted errors."""
    swapped = F.transform("locations", lambda x: F.when(x.isNotNull(), norm.flip_side(x)))
    return facts.withColumn("locations", F.when(F.col("section") == section, swapped).otherwise(F.col("locations")))


def norm_stats(facts: DataFrame) -> DataFrame:
    """(kind, key, n): distinct heads and locations before and after normalization; regions, sides and reviews over
    distinct raw locations."""
    heads = facts.groupBy("raw_head").agg(F.first("head").alias("head")).agg(F.countDistinct("raw_head").alias("head_raw"), F.countDistinct("head").alias("head_normalized"))
    raw = facts.select(F.explode("locations").alias("raw")).where("trim(raw) <> ''").distinct().withColumn("x", norm.location(F.col("raw")))
    x = raw.agg(F.count("*").alias("location_raw"), F.countDistinct("x.laterality", "x.region", "x.lobe").alias("location_normalized"), F.count_if("x.needs_review").alias("needs_review"))
    wide = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit("count").alias("kind"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in df.columns])).alias("r")).select("r.*")
    by = lambda c: raw.groupBy(F.lit(c).alias("kind"), F.col(f"x.{c}").alias("key")).agg(F.count("*").alias("n"))
    return wide(heads).unionByName(wide(x)).unionByName(by("region")).unionByName(by("laterality"))


def unplaced(facts: DataFrame, limit: int = 40) -> DataFrame:
    """The most frequent raw locations without a region: (raw, n)."""
    raw = facts.select(F.explode("locations").alias("raw")).where("trim(raw) <> ''").groupBy("raw").agg(F.count("*").alias("n"))
    return raw.where(norm.location(F.col("raw"))["region"] == "other").orderBy(F.desc("n"), "raw").limit(limit)


def head_map(facts: DataFrame) -> DataFrame:
    """(raw, canonical) of the distinct heads; a null head counts as an empty text."""
    return facts.select(F.coalesce("raw_head", F.lit("")).alias("raw")).distinct().withColumn("canonical", norm.head(F.col("raw")))


def location_map(facts: DataFrame) -> DataFrame:
    """(raw, laterality, region, lobe, needs_review) of the distinct locations that aren't blank."""
    raw = facts.select(F.explode("locations").alias("raw")).where("trim(raw) <> ''").distinct()
    return raw.withColumn("x", norm.location(F.col("raw"))).select("raw", "x.laterality", "x.region", "x.lobe", "x.needs_review")
